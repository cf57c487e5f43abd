import duckdb
import pytest

from kinweave.llm import licenses, mixing, pieces

TEXTS = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.\nmore", "cc by CC-BY cc  by", "GNU General\nPublic License and mit license mit license", None, "", "mit Lizenz K İ apache licenses", "a " * 5000 + "cc by", "we may under the License, Version 2.0 apache"]


def _oracle(sql, docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    rel = con.sql(sql)
    return rel.columns, sorted(rel.fetchall(), key=repr)


@pytest.fixture(scope="module")
def docs():
    sources = ["b", "a", None, "c", "é", "Z"]
    rows = [(i, t, sources[i % 2]) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, "w " * (i % 17), sources[i % 6] if i % 3 else "a") for i in range(200)] + [(5, "same id", "b"), (5, "same id", "b"), (None, "no id here", None)]
    return rows


def test_licenses_and_mix_match_sql(spark, docs):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, size int, labels string")
    for frame, sql in ((licenses.scan_licenses(df), licenses.oracle_sql()), (mixing.mix_sources(df), mixing.SQL)):
        columns, want = _oracle(sql, docs)
        assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr) == want


def test_license_labels(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).where("doc_id < 9").collect()}
    assert (got[0].base_labels, got[0].labels, got[0].n_base) == ("apache", "Apache-2.0,apache", 1)
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (3, 0, 4)
    assert got[3].base_labels == "gpl,mit" and got[3].n_base == 3
    assert (got[4].n_words, got[4].labels, got[4].first_word, got[4].score) == (0, "", None, 0.0)
    assert got[8].base_labels == "" and got[8].labels == "Apache-2.0"
    blocks = licenses.scan_licenses(df, blocks=True).collect()
    assert {(r.doc_id, r.block, r.label) for r in blocks if r.doc_id == 1} == {(1, 0, "MIT")}
    none = df.where("false")
    assert licenses.scan_licenses(none).count() == 0 and mixing.mix_sources(none).count() == 0


NOTICES = [
    "# This program is free software: you can\n# redistribute it and/or modify it\n# under the terms of the GNU General\n# Public License as published",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY 4.0.",
    "licensed " + "word " * 40 + "under cc by 4 " + "more " * 40 + "0",
    "Permission is hereby granted, free of charge,\nto any person obtaining a copy\n\nof this software and associated documentation files",
    "This library is free software; you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License",
    "Licensed under the Apache License,\n   Version 2.0 (the License);",
]


def test_wrapped_and_similar_notices(spark):
    rows = [(i, t, "s") for i, t in enumerate(NOTICES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(df).collect()}
    own = [[x for x in got[i] if x and x[0].isupper()] for i in range(len(rows))]
    assert own == [["GPL-3.0"], ["CC-BY-NC-4.0"], ["CC-BY-SA-4.0"], ["CC-BY-4.0"], [], [], ["LGPL-3.0"], ["Apache-2.0"]]
    columns, want = _oracle(licenses.oracle_sql(), rows)
    assert sorted((tuple(r) for r in licenses.scan_licenses(df).select(*columns).collect()), key=repr) == want


def test_mix_meets_targets(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix_sources(df).collect()
    sources = {}
    for r, d in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(docs, key=lambda d: (d[0] is None, d[0])), strict=True):
        assert r.taken <= 3 * r.size
        s = sources.setdefault(d[2], [r.target, 0, r.source_size])
        s[1] += r.taken
    assert abs(sum(s[0] for s in sources.values()) - sum(r.size for r in rows)) < 1e-6 * sum(r.size for r in rows)
    for target, taken, size in sources.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= max(r.size for r in rows)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in rows)


@pytest.mark.parametrize("most", [100_000, 1])
def test_repeated_and_null_ids_meet_targets(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "SMALL_SOURCES", most)
    rows = [(None if i % 2 else 7, " ".join(["w"] * (1 + i % 9) + [f"t{i}"]), "big" if i % 3 else "small") for i in range(300)] + [(None, None, "empty"), (None, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    columns, want = _oracle(mixing.SQL, rows)
    got = mixing.mix_sources(df).select(*columns).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    for size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10
    assert sum(len((r.text or "").split()) for r in mixing.mixed(df).collect()) == sum(r.taken for r in got)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load()


def test_trie_finds_all_words():
    words = [b"a", b"ab", b"abc", b"b", "é".encode(), "éa".encode(), b"zz"]
    base, check, value = pieces.double_array(words)
    for i, w in enumerate(words):
        state = 0
        for c in w:
            nxt = base[state] + c
            assert check[nxt] == state
            state = nxt
        assert value[state] == i


def test_viterbi_against_all_segmentations():
    import itertools

    names = ["<u>", *[f"<0x{i:02X}>" for i in range(256)], "▁", "a", "b", "ab", "ba", "aba", "▁a", "bb"]
    scores = [0.0] * 257 + [-3.0, -2.0, -2.5, -3.1, -4.0, -5.2, -4.1, -6.0]
    p = pieces.Pieces(names, scores, [2] + [1] * 256 + [0] * 8)
    table = dict(zip(names[257:], scores[257:], strict=True))
    for n in range(1, 7):
        for letters in itertools.product("ab", repeat=n):
            text = "▁" + "".join(letters)
            best = max(sum(table[text[i:j]] for i, j in zip((0, *cut), (*cut, len(text)), strict=True)) for k in range(len(text)) for cut in itertools.combinations(range(1, len(text)), k) if all(text[i:j] in table for i, j in zip((0, *cut), (*cut, len(text)), strict=True)))
            assert abs(sum(scores[i] for i in p.encode("".join(letters))) - best) < 1e-9


def test_round_trip_and_edges(spark, model):
    texts = ["", " ", "  two  spaces ", "Hello world\n\ttab", "漢字 é \u0000 𠀀", "a▁b ▁", "▁", "x" * 5000, "word " * 3000]
    for t in texts:
        assert model.decode(model.encode(t)) == t
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(99, None, None), (0, "", None)], "doc_id long, text string, ids array<int>")
    got = pieces.encode_texts(docs, model).collect()
    assert len(got) == len(texts) + 2
    assert all(r.exact for r in got if r.doc_id != 99)
    assert next(r for r in got if r.doc_id == 99).ids is None
    assert {r.doc_id: r.ids for r in got}[3] == model.encode(texts[3])
    assert pieces.encode_texts(docs.where("false"), model).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode_ids(pieces.encode_texts(docs.where("doc_id > 0"), model), model).collect()}
    assert back == {i: t for i, t in enumerate(texts) if i} | {99: None}


def test_words_together_are_the_words_alone(model, texts, monkeypatch):
    # Slices of a few bytes cut long texts in front of words; a memory of three words is emptied all the time.
    import pyarrow as pa

    rows = [*[t for _, t, _ in texts[:30]], None, "", " ", "  a▁ b ▁▁", "漢字漢字 é\u0301 𠀀𠀀", "y" * 300 + " z", "word  \n word " * 400, "\U0001f600" * 60]
    want = [None if t is None else model.best_path(b" " + t.encode()) if t else [] for t in rows]
    for size, memory, long in ((1 << 20, 1 << 20, 48), (64, 3, 4)):
        monkeypatch.setattr(pieces, "SLICE", size)
        monkeypatch.setattr(pieces, "MEMORY", memory)
        monkeypatch.setattr(pieces, "LONG", long)
        words = pieces.Words(model)
        got = [pieces.encode_batch(model, words, pa.array([t], pa.string())) for t in rows] + [pieces.encode_batch(model, words, pa.array(rows))]
        assert [g[0][0].as_py() for g in got[:-1]] == want == got[-1][0].to_pylist()
        assert got[-1][1].to_pylist() == [None if x is None else len(x) for x in want]
        assert got[-1][2].to_pylist() == [None if x is None else sum(model.kinds[i] == 1 for i in x) for x in want]
        assert got[-1][3].to_pylist() == [None if t is None else True for t in rows]


def test_same_paths_as_the_library(model, texts):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(pieces.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for q in proto.pieces:  # the file's placeholders of -1e9 drown the library's single-precision sums
        if q.type == 1 and q.score < -1e8:
            q.score = -60000.0
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    own = pieces.Pieces([q.piece for q in proto.pieces], [q.score for q in proto.pieces], model.kinds)
    for _, t, _ in texts[:40]:
        assert own.encode(t[:60]) == library.encode(t[:60])


def test_license_scan_reads_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)
    texts = ["Released under the MIT License", "plain words", None, "a\n\nLicensed under CC BY-NC 4.0\n\nb"]

    def rows(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").mapInArrow(rows, "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()}
    assert got == {0: "MIT,mit", 1: "", 2: "", 3: "CC-BY-NC-4.0,cc-by"}
    assert seen.value == len(texts)
