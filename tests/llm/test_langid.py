import numpy as np

from kinweave.llm import langid


def test_backpropagation_matches_differences():
    net = langid.ByteBiGru(["a", "b"], hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    x, y, w = rng.integers(97, 123, (4, 6)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((4, 6))

    def loss():
        return net.step(x, y, w)[0]

    _, grads = net.step(x, y, w)
    for name in ("fWz", "fUr", "bUn", "bWn", "fV", "c", "bUz"):
        flat = net.p[name].reshape(-1)
        i = int(np.abs(grads[name].reshape(-1)).argmax())
        old, eps = flat[i], 1e-4
        flat[i] = old + eps
        up = loss()
        flat[i] = old - eps
        down = loss()
        flat[i] = old
        assert abs((up - down) / (2 * eps) - grads[name].reshape(-1)[i]) < 2e-4


def test_fast_forward_matches_the_plain_one():
    net = langid.ByteBiGru(["a", "b", "c"], seed=3)
    x = np.random.default_rng(1).integers(97, 123, (5, 40)).astype(np.uint8)
    logits = net._logits(x)[2]
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    assert np.allclose(net.pooled(x), p.sum(0), atol=0.2)
    v = np.linspace(-6, 6, 1000, dtype=np.float32)
    t, a, b = v.copy(), np.empty_like(v), np.empty_like(v)
    langid.fast_tanh(t, a, b)
    assert np.abs(t - np.tanh(v)).max() < 2e-3


def test_held_out_accuracy_and_edges(spark, texts):
    train = spark.createDataFrame([t for t in texts if t[0] % 3], "doc_id long, text string, lang string")
    net = langid.fit(train)
    held = [t for t in texts if t[0] % 3 == 0]
    odd = [(1000, None, "x"), (1001, "", "x"), (1002, "12 34 !?", "x"), (1003, held[0][1] * 40, "x"), (1003, held[0][1] * 40, "x"), (None, "the other thing was here with the nation", "x"), (1004, "—…", None)]
    docs = spark.createDataFrame([(*t, 0.5, "q") for t in held + odd], "doc_id long, text string, lang string, score double, t string")
    rows = langid.identify(docs, net, carry=("doc_id", "lang")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(held) + len(odd)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    for i in (1000, 1001, 1002, 1004):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1003].lang_pred == held[0][2] and 0 <= got[1003].score <= 1
    assert got[None].lang_pred == "en"
    empty = docs.where("false")
    assert langid.fit(empty) is None
    assert langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_windows_and_pooling_against_brute_force(texts, monkeypatch):
    import pyarrow as pa

    rows = [*[t for _, t, _ in texts[:6]], None, "", "12 34", "é" * 300, "ab " * 2000]
    net = langid.train([(t, lang) for _, t, lang in texts[:60]])

    def brute(text):
        raw = (text or "").encode()
        total, count = np.zeros(len(net.labels)), 0
        for i in range(0, len(raw), langid.WINDOW):
            w = raw[i : i + langid.WINDOW]
            x = np.zeros((1, langid.WINDOW), np.uint8)
            x[0, : len(w)] = list(w)
            letters = np.array([[b >= 128 or chr(b).isalpha() for b in w] + [False] * (langid.WINDOW - len(w))])
            if letters.any():  # a window without letters is not read
                total += net.pooled(x)[0]
                count += letters.sum()
        return total / max(count, 1)

    for size, piece in ((1 << 20, 9216), (300, 2)):
        monkeypatch.setattr(langid, "SLICE", size)
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid, "PART", piece * langid.WINDOW)
        names, score = langid.predict_batch(net, pa.array(rows, pa.string()))
        for text, name, got in zip(rows, names, score, strict=True):
            if not langid.has_letter(text):
                assert (name, got) == ("und", 0.0)
                continue
            want = brute(text)
            assert name == net.labels[int(want.argmax())] and abs(got - want.max()) < 0.02, text


def test_sample_is_of_rows(spark):
    rows = [(1, f"text number {i}", "en") for i in range(50)] + [(2, "same", "fr")] * 30 + [(None, "ohne", "de"), (3, None, "de"), (4, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.bounded_sample(df, "doc_id", "text", "lang", 10)
    assert sorted(x for _, x in got) == ["de"] + ["en"] * 10 + ["fr"]
    assert got == langid.bounded_sample(df.repartition(7), "doc_id", "text", "lang", 10)
