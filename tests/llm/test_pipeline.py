import corpus_pipeline
from kinweave.llm.pieces import Pieces


def test_stages_keep_clean_documents(spark, tmp_path, texts):
    rows = [(i, t, lang, f"s{i % 3}", len(t)) for i, t, lang in texts]
    rows += [(500, texts[0][1], texts[0][2], "s0", 1), (501, None, "en", "s1", 0), (502, "!!! 12", "en", "s1", 6), (503, texts[5][1] + " " + texts[7][1], texts[5][2], None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns
        seen = spark.createDataFrame(seen.collect(), docs.schema)
    kept = {r.doc_id for r in seen.collect()}
    assert not kept & {500, 501, 502}
    first = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert {r.doc_id for r in first.collect()} >= {i for i, _, _ in texts}
    second = corpus_pipeline.near_dedup(spark, first, str(tmp_path))
    assert {r.doc_id for r in second.collect()} == {i for i, _, _ in texts} | {503}
    third = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, second, str(tmp_path)).collect()}
    assert len(third.get(503, "")) < 100 and third[3] == texts[3][1]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = Pieces.load()
    assert all(r.exact for r in out) and sorted(r.doc_id for r in out) == sorted(r.doc_id for r in seen.collect())
    assert all(model.encode(third[r.doc_id]) == r.ids for r in out)
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_clashing_columns_and_repeated_ids(spark, texts):
    rows = [(i % 40, t, lang, f"s{i % 3}", len(t), "x", 0.5, i, "k", i, i, "h", "c", {"a": 1}) for i, t, lang in texts]
    rows += [(None, texts[3][1] + " other words", "en", "s0", 1, "x", 0.5, 1, "k", 1, 1, "h", "c", None), rows[0], rows[1], (*rows[2][:5], "y", *rows[2][6:])]
    names = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, n_removed long, kept_text string, n_bytes long, n_spans long, kept_sha256 string, carry_0 string, cut_n_removed map<string,int>"
    docs = spark.createDataFrame(rows, names)
    seen, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, "")
        assert seen.columns == docs.columns
        seen = spark.createDataFrame(seen.collect(), docs.schema).repartition(3)
        sizes.append(seen.count())
    # Equal ids with different texts stay; equal texts under one id go.
    assert sizes[0] == len(rows) and sizes[1] == len(texts)
    assert {r.lang_pred for r in seen.collect()} <= {"x", "y"}
    out = corpus_pipeline.STAGES[-1][1](spark, seen, "").collect()
    assert len(out) == sizes[-1] and all(r.exact for r in out)
