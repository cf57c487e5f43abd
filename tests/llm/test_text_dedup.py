import hashlib
import random
import re
from collections import defaultdict

import pytest

from kinweave.llm import neardup, suffixes


def brute_repeats(rows, length=50):
    first = {}
    key = lambda d: 2**62 if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, key(d)), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key(d):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_groups(rows, words, percent):
    sets = defaultdict(list)
    for d, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[d].append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a is not None and b is not None and a < b and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {d: find(d) for d in sets if d is not None}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(90), text(25)
    out = [(i, text(rng.randint(5, 60))) for i in range(40)]
    out += [(100 + i, " ".join(w if rng.random() > 0.03 else word() for w in base.split())) for i in range(40)]
    out += [(200 + i, text(10) + " " + passage + text(8)) for i in range(15)]
    out += [(300, base), (301, base.upper()), (302, base), (400, None), (401, ""), (402, " \t\n"), (403, "two words"), (404, "Two Words"), (405, "a " * 3000), (406, "a " * 2000), (407, passage + passage), (None, base), (None, text(5))]
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats_match_brute_force(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_removed int")
    got = suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(rows)


def test_repeats_of_long_texts_and_edges(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 512)
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(5, long), (9, "x" + long[700:2900] + "yz"), (9, "short"), (7, long[:49]), (8, long[:50])]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    out = suffixes.remove_repeats(docs, keep_text=True, carry=("text",)).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute_repeats(rows)
    assert {r.text: r.kept_text for r in out}[rows[1][1]] == "xyz"
    assert suffixes.remove_repeats(docs.where("false")).count() == 0


def test_near_duplicates_match_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    for words, percent in ((4, 80), (5, 80)):
        sets, groups = brute_groups(rows, words, percent)
        got = neardup.near_duplicates(docs, words=words, percent=percent).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert r.n_shingles in [len(s) for s in sets[r.doc_id]]
                assert (r.component_id, r.kept) == (groups[r.doc_id], groups[r.doc_id] == r.doc_id), r
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_small_blocks_lose_no_link(spark, rows, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")
    _, groups = brute_groups([r for r in rows if r[0] is not None], 4, 80)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=4).collect()} == groups


def test_hot_keys_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 2)
    docs = spark.createDataFrame([r for r in rows if r[0] is not None] + [(600 + i, rows[0][1]) for i in range(30)], "doc_id long, text string")
    _, groups = brute_groups([tuple(r) for r in docs.collect()], 5, 80)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == groups


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 50), (100, 60)]
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and got[60] == got[100] == 50


def test_refused_likeliest_pairs_do_not_hide_a_link(spark):
    # Each cluster: 40 documents at J = 0.796 of each other, which the full sets refuse, and one pair at 0.801 whose ends have two likelier mates by the estimate.
    rows, pairs = [], []
    for c in (3, 6, 8, 9):
        core, extra = [f"c{c}w{i}" for i in range(780)], [f"c{c}e{i}" for i in range(3)]
        for m in range(42):
            shared = extra if m >= 40 else []
            rows.append((c * 100 + m, " ".join(core + shared + [f"c{c}m{m}u{i}" for i in range(100 - len(shared))])))
        pairs.append((c * 100 + 40, c * 100 + 41))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=1).collect()}
    assert got == {d: d for d, _ in rows} | {b: a for a, b in pairs}


def test_short_texts_at_the_threshold_are_linked(spark):
    # Sets of 5 and 4 words that share 4: J is 0.8 exactly.
    rows = [(2 * p + s, " ".join(f"p{p}w{i}" for i in range(5 - s))) for p in range(300) for s in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=1).collect()}
    assert [d for d in got if got[d] != d // 2 * 2] == []
