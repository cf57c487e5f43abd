import os
import random
import re
import zlib

import numpy as np
import pytest

from kinweave.llm import toxicity


def _rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["stupid", "idiot", "qrtz" + rng.choice(["an", "em", "os", "ul"])])
        elif rng.random() < 0.2:
            words[3] = "idiot"
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_learns_and_separates(spark):
    rows = _rows(600, 1)
    docs = spark.createDataFrame([(*r, "en") for r in rows] + [(9000, None, 0, "x"), (9001, "", 0, "x"), (9001, "", 0, "x"), (9002, "!!! 12", 0, None)], "doc_id long, text string, score int, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(77777, 1), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, docs, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([(s >= 0.7) == bool(y) for s, y in held]) > 0.97
    assert got[9000] == got[9001] == got[9002] < 0.3
    assert all(0 <= s <= 1 for s in got.values())


def test_label_model_discounts_dependent_voters():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    speak = lambda p1, p0: np.where(rng.random(6000) < np.where(y, p1, p0), 1, 0)
    good, fair, weak = speak(0.7, 0.03), speak(0.6, 0.05), speak(0.5, 0.3)
    quiet = -speak(0.05, 0.6)
    m = toxicity.LabelModel(0.3).fit(np.stack([good, fair, weak, weak, weak, quiet], 1), np.array([0, 1, 2, 2, 2, 3]))
    assert m.evidence[0] > m.evidence[2] >= 0 >= m.evidence[5]
    # Three voters that always agree count as one.
    only = np.array([[0, 0, 1, 1, 1, 0], [0, 0, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0]])
    z = np.log(m.posterior(only) / (1 - m.posterior(only)))
    assert abs(z[0] - z[1] - m.evidence[2]) < 0.05 and z[2] > z[0] > z[1]
    post = m.posterior(np.stack([good, fair, weak, weak, weak, quiet], 1))
    assert np.mean((post >= np.quantile(post, 0.7)) == y) > 0.8


def test_posterior_against_brute_force():
    """The log odds of a row are the intercept that keeps the class balance, what each speaking voter adds, less what speaking neighbours say twice."""
    import math

    rng = np.random.default_rng(4)
    v = np.where(rng.random((300, 6)) < 0.4, np.array([1, 1, 1, 1, -1, -1]), 0)
    m = toxicity.LabelModel(0.2).fit(v)
    assert abs(m.posterior(v).mean() - 0.2) < 1e-6
    for row in v[:40]:
        z = m.intercept
        for j, x in enumerate(row):
            if x:
                z += m.evidence[j]
                if m.neighbour[j] >= 0 and row[m.neighbour[j]]:
                    z -= m.shared[j]
        assert abs(m.posterior(row[None])[0] - 1 / (1 + math.exp(-z))) < 1e-12


def test_votes_against_brute_force():
    hits = toxicity.Hits([("ab", 2), ("qrtz*", 1), ("qrtz*", 3)])
    texts = ["ab x ab", "ab", "qrtzum qrtzan qrtzon", "an Idiot and IDIOT, idiot", "qrtz", None, "", "12 ?", "ab ab " + "x " * 3000, "stupid " + "y " * 60 + "clown"]
    votes = hits.votes(*hits.table(texts))
    for text, row in zip(texts, votes, strict=True):
        words = [w.lower() for w in re.findall(r"[^\W\d_]+", text or "")]
        n = {f: sum(w == f or f.endswith("*") and len(w) > len(f) - 1 and w.startswith(f[:-1]) for w in words) for f, _ in hits.voters}
        real = [i for i, w in enumerate(words) if any(n[f] >= min(m for g, m in hits.voters if g == f) for f in toxicity.keys(w) if f in n)]
        dense = 100 * len(real) / (len(words) + 20)
        enough = dense >= toxicity.SPARSE
        want = [int(n[f] >= m and enough) for f, m in hits.voters]
        want += [int(len(real) >= 2 and enough), int(len(real) >= 3 and enough), int(len({words[i][:4] for i in real}) >= 2 and enough), int(any(b - a <= 40 for a, b in zip(real, real[1:], strict=False)) and enough), int(dense >= 0.8 and len(real) >= 2), -int(not enough), -int(len(real) <= 1), -int(not real)]
        assert row.tolist() == want, text


@pytest.mark.parametrize(("sf", "caught"), [("sf0.01", 0.88), ("sf0.1", 0.9)])
def test_held_out_recall(sf, caught):
    """Of the toxic documents held out; those missed hold no word that any training row could teach."""
    import pyarrow.parquet as pq

    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no driver tables")
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    rows = [(r["doc_id"], docs[r["doc_id"]], r["toxic"]) for r in pq.read_table(f"{d}/labels.parquet").to_pylist() if r["doc_id"] in docs]
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    scorer = toxicity.Scorer([(t or "", y) for i, t, y in rows if not out(i)])
    held = [(t, y) for i, t, y in rows if out(i)]
    marked = scorer.score([t for t, _ in held]) >= 0.7
    y = np.array([y for _, y in held])
    assert marked[y == 1].mean() > caught and marked[y == 0].mean() < 0.005
    assert len(scorer.hits.voters) > 30


def test_very_long_texts_and_few_hits():
    scorer = toxicity.Scorer([(t, y) for _, t, y in _rows(400, 2)])
    clean, toxic = "plain words here " * 50_000, "plain words idiot stupid " * 50_000
    a, b, c = scorer.score([clean, toxic, clean + "idiot stupid"])
    assert b > 0.9 and a < 0.3 and c < 0.3


def test_copies_count_once():
    base = "alpha beta gamma delta epsilon zeta eta theta"
    train = [(base + " oddword", 1)] * 10 + [(f"text number {i} with nothing", 0) for i in range(50)]
    assert "oddword" not in [k for k, _ in toxicity.mine(train)]
    kin = toxicity.families([t for t, _ in train])
    assert len(set(kin[:10])) == 1


def test_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "you stupid idiot and moron, stupid trash"), (2, "fine words")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, none, labels).collect()}
    assert got[1] >= got[2]
    assert toxicity.score_toxicity(none, none, labels).count() == 0
