"""Toxicity by weak supervision.

Many weak voters look at a text, each saying "toxic" (+1), "clean" (-1) or
nothing: one for every word of an English lexicon, one for every word or stem
family mined from the labelled training rows together with the number of hits
it takes, and patterns over all hits (how many, of how many families, how close,
how dense, none at all).

A generative label model estimates, without using the labels again, how far
each voter can be trusted, and pairwise dependencies: each voter leans on one
other of its family, its neighbour in the tree that holds the most conditional
mutual information, so a voter that merely repeats its neighbour adds nothing. The
model gives every training text a posterior probability, and a linear
classifier over the votes and counts is trained on these posteriors; it alone
scores texts.

Mining: copies of a text count once. A family is taken if it favours toxic rows
by ``ODDS`` and chance would bring up less than ``FALSE`` families as one-sided
as it among all that occur in as many rows; so few rows give few but sound
voters, many rows many.

Labels are read only from the training rows that the caller passes, at most
``max_train_rows`` of them in the order of a hash of the row. Scoring reads the
text alone, whole.

Defined results: null or empty text, or text without words, gets the score of
a text without any hit. Without any labelled row of both kinds the mined
voters are empty and the lexicon alone votes. Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.textbytes import tidy

#: Common English insults, the lexicon voters.
LEXICON = ("clown", "disgusting", "filth", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
STEMS = (4, 6)
#: A mined voter speaks at this many hits of its family.
LEVELS = (1, 2, 3)
#: Hits in a hundred words below which voters say nothing.
SPARSE = 0.4
ODDS, FALSE, MOST = 30.0, 0.3, 300
WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def keys(word: str) -> tuple[str, ...]:
    """The families of a word: itself and, if longer, its stems."""
    return (word, *[word[:n] + "*" for n in STEMS if len(word) > n])


def families(texts: list[str], marks: int = 6, seed: int = 3) -> list[int]:
    """Group number of each text of the bounded sample: texts that share a minimum of hashed 3-word shingles are kin.

    Copies are one witness, not many: without this a word of a passage that was copied eight times looks like a voter.
    """
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 62, marks, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[tuple[int, int], int] = {}
    for i, text in enumerate(texts):
        w = tokens(text)
        if not w:
            continue
        h = np.fromiter((crc32(" ".join(w[j : j + 3]).encode()) for j in range(max(1, len(w) - 2))), np.uint64)
        for k, m in enumerate(((h[:, None] * a) >> np.uint64(20)).min(0).tolist()):
            j = first.setdefault((k, m), i)
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def _tail(a: int, n: int, rate: float) -> float:
    """Chance that at least a of n rows are toxic."""
    return sum(math.comb(n, k) * rate**k * (1 - rate) ** (n - k) for k in range(a, n + 1)) if n <= 1000 else math.exp(-n * _divergence(a / n, rate))


def _divergence(x: float, p: float) -> float:
    return (x * math.log(x / p) if x else 0.0) + ((1 - x) * math.log((1 - x) / (1 - p)) if x < 1 else 0.0) if x > p else 0.0


def mine(train: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """(family, hits) of the mined voters, the most one-sided first, whole texts counted."""
    kin = families([t for t, _ in train])
    train = list({(k, y): (t, y) for k, (t, y) in zip(kin, train, strict=True)}.values())
    n1 = sum(y for _, y in train)
    n0 = len(train) - n1
    if not n1 or not n0:
        return []
    rows: dict[tuple[str, int], list[int]] = {}
    for i, (text, _) in enumerate(train):
        count = Counter(k for w in tokens(text) for k in keys(w))
        for k, n in count.items():
            for m in LEVELS:
                if n >= m:
                    rows.setdefault((k, m), []).append(i)
    alike = Counter((m, len(x)) for (_, m), x in rows.items())
    rate, found, seen = n1 / (n0 + n1), [], set()
    for (k, m), x in rows.items():
        a = sum(train[i][1] for i in x)
        b = len(x) - a
        if a < 2 or (a / n1) < ODDS * (b + 0.5) / n0:
            continue
        false = alike[m, len(x)] * _tail(a, len(x), rate)
        if false <= FALSE:
            found.append((false, -a, len(k), k, m, tuple(x)))
    voters = []
    for _, _, _, k, m, x in sorted(found):
        if (m, x) not in seen:  # of families with the same rows the shortest speaks
            seen.add((m, x))
            voters.append((k, m))
    return voters[:MOST]


PATTERNS = ("two hits", "three hits", "two families", "near hits", "dense hits", "sparse hits", "few or no hits", "no hit")
SILENT = frozenset(PATTERNS[-3:])


class Hits:
    """Finds a text's hits once per distinct word (remembered up to a bound)."""

    def __init__(self, mined: list[tuple[str, int]]):
        self.voters = [(w, 1) for w in LEXICON] + [v for v in mined if v not in {(w, 1) for w in LEXICON}]
        self.family = {k: i for i, k in enumerate(dict.fromkeys(k for k, _ in self.voters))}
        self.of = np.array([self.family[k] for k, _ in self.voters])
        self.level = np.array([m for _, m in self.voters])
        # A family is a hit of its own once its voter of the fewest hits speaks.
        self.least = {i: int(self.level[self.of == i].min()) for i in self.family.values()}
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def kin(self) -> np.ndarray:
        """Voters with the same stem are kin, as are the patterns that speak for one label."""
        stems = [k[: STEMS[0]] for k, _ in self.voters] + [("", p in SILENT) for p in PATTERNS]
        number = {k: i for i, k in enumerate(dict.fromkeys(stems))}
        return np.array([number[k] for k in stems])

    def families_of(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[word] = tuple(self.family[k] for k in keys(word) if k in self.family)
        return found

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hits of each family; and hits, families, near pairs and density of those that count."""
        words = tokens(text)
        at = [(i, k) for i, k in enumerate(map(self.families_of, words)) if k]
        count = np.zeros(len(self.family), np.int64)
        if not at:
            return count, np.zeros(4)
        for _, k in at:
            for f in k:
                count[f] += 1
        real = [(i, k) for i, k in at if any(count[f] >= self.least[f] for f in k)]
        kinds = len({words[i][: STEMS[0]] for i, _ in real})
        near = sum(b[0] - a[0] <= 40 for a, b in zip(real, real[1:], strict=False))
        return count, np.array([len(real), kinds, near, len(real) / (len(words) + 20) * 100])

    def table(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.features(t) for t in texts]
        return np.array([c for c, _ in got]).reshape(len(got), -1), np.array([x for _, x in got]).reshape(len(got), 4)

    def votes(self, count: np.ndarray, x: np.ndarray) -> np.ndarray:
        """+1 toxic, -1 clean, 0 silent: a row for each text, a column for each voter and pattern."""
        n, kinds, near, dense = x.T
        enough = dense >= SPARSE  # a few hits in a long text are chance
        hits = ((count[:, self.of] >= self.level) & enough[:, None]).astype(np.int8)
        patterns = [(n >= 2) & enough, (n >= 3) & enough, (kinds >= 2) & enough, (near >= 1) & enough, (dense >= 0.8) & (n >= 2), -1 * ~enough, -1 * (n <= 1), -1 * (n == 0)]
        return np.column_stack([hits, *(np.asarray(p, np.int8) for p in patterns)])


class LabelModel:
    """Generative model of votes given a hidden label, fitted by EM.

    Every voter speaks for one label. ``evidence[j]`` is the log likelihood
    ratio of the labels when voter j speaks, from the posteriors of the rows
    where it does as voters of other families see them; it is assumed to be no worse than chance, without which the
    labels could change places. Dependencies are pairwise: the voters of one
    family and label form the tree that holds the most mutual information given the label
    (Chow and Liu), and ``shared[j]`` is what voter j and its neighbour say
    twice when both speak, from the rows where they do, so that the ratio of a
    row is that of a tree of pairs. A single silent voter is no evidence; what the
    silence of all tells is one intercept, found from the class balance.
    """

    def __init__(self, prior: float):
        self.prior = min(max(prior, 0.01), 0.5)
        self.base = math.log(self.prior / (1 - self.prior))

    def fit(self, v: np.ndarray, kin: np.ndarray | None = None, rounds: int = 30) -> LabelModel:
        """``kin``: number of each voter's family; a voter is judged by what voters of other families say."""
        spoke = (v != 0).astype(float)
        self.kin = np.eye(v.shape[1]) if kin is None else np.eye(int(kin.max()) + 1)[kin]
        self.side = np.sign(v.sum(0))
        # To begin with, the share of each side's voters that agree on a row stands for its label.
        says = v[:, -len(PATTERNS) :].sum(1) if v.shape[1] > len(PATTERNS) else v.sum(1)
        post = 1 / (1 + np.exp(-np.clip(1.5 * (says - 1), -4, 4)))
        others, self.intercept = post[:, None], self.base
        for i in range(rounds):
            if i % 5 == 0:
                self.neighbour, self.information = self._tree(spoke, post)
            self._weigh(spoke, others)
            self._balance(spoke)
            post, others = self._post(spoke), self._by_others(spoke)
        right = ((v > 0) * post[:, None] + (v < 0) * (1 - post[:, None])).sum(0)
        self.accuracy = (right + 0.5) / (spoke.sum(0) + 1.0)
        return self

    def _tree(self, spoke: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbour of each voter (-1 at the root), and mutual information of all pairs given the label."""
        k = spoke.shape[1]
        total = np.zeros((k, k))
        for w in (1 - post, post):
            m = w.sum() + 2.0
            both = (spoke * w[:, None]).T @ spoke + 0.5
            one = (spoke * w[:, None]).sum(0) + 1.0
            a, b = one[:, None], one[None, :]
            for p, q, r in ((both, a, b), (a - both, a, m - b), (b - both, m - a, b), (m - a - b + both, m - a, m - b)):
                p = np.maximum(p, 1e-9)
                total += p / len(post) * np.log(np.maximum(p * m / np.maximum(q * r, 1e-9), 1e-12))
        total[(self.side[:, None] != self.side) | (self.kin @ self.kin.T == 0)] = -np.inf
        np.fill_diagonal(total, -np.inf)
        neighbour = np.full(k, -1)
        best, of = total[0].copy(), np.zeros(k, int)
        out = np.ones(k, bool)
        out[0] = False
        while out.any():
            j = int(np.where(out, best, -np.inf).argmax()) if np.isfinite(best[out]).any() else int(out.argmax())
            if best[j] > 0:
                neighbour[j] = of[j]
            out[j] = False
            closer = out & (total[j] > best)
            best[closer], of[closer] = total[j][closer], j
        return neighbour, total

    def _beside(self, spoke: np.ndarray) -> np.ndarray:
        return np.where(self.neighbour >= 0, spoke[:, self.neighbour], 0.0)

    def _weigh(self, spoke: np.ndarray, others: np.ndarray) -> None:
        def ratio(where: np.ndarray) -> np.ndarray:
            """Log odds of the label of the rows that columns of ``where`` mark, against those of all; part of a row of each label is added."""
            n, one = where.sum(0), (others * where).sum(0)
            return np.log((one + 0.2) / (n - one + 0.2)) - self.base

        e = ratio(spoke)
        self.evidence = np.where(e * self.side > 0, e, 0.0)
        both = spoke * self._beside(spoke)
        other = self.evidence[self.neighbour]
        twice = self.evidence + other - ratio(both)
        # What two voters of one side say twice is at most what the weaker one says.
        most = np.minimum(np.abs(self.evidence), np.abs(other))
        self.shared = np.where(both.sum(0) > 0, np.clip(twice * self.side, 0, most) * self.side, 0.0)

    def _balance(self, spoke: np.ndarray) -> None:
        """What the silence of voters tells, in sum: the intercept at which as many rows are toxic as the class balance says."""
        self.intercept = 0.0
        z, low, high = self._odds(spoke), -40.0, 40.0
        for _ in range(50):
            self.intercept = (low + high) / 2
            over = (1 / (1 + np.exp(-np.clip(z + self.intercept, -30, 30)))).mean() > self.prior
            low, high = (low, self.intercept) if over else (self.intercept, high)

    def _odds(self, spoke: np.ndarray) -> np.ndarray:
        return self.intercept + spoke @ self.evidence - (spoke * self._beside(spoke)) @ self.shared

    def _by_others(self, spoke: np.ndarray) -> np.ndarray:
        """Posterior of each row (a column for each voter) without the voter's family, which else would only confirm itself."""
        twice = spoke * self._beside(spoke) * self.shared
        own = (spoke * self.evidence) @ self.kin - twice @ np.maximum(self.kin, self.kin[self.neighbour] * (self.neighbour >= 0)[:, None])
        z = self._odds(spoke)
        return (1 / (1 + np.exp(-np.clip(z[:, None] - own, -30, 30)))) @ self.kin.T

    def _post(self, spoke: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._odds(spoke), -30, 30)))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return self._post((v != 0).astype(float))


def design(votes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Features of the linear classifier: the votes, and saturating counts of hits where they are not sparse."""
    x = x * (x[:, 3:] >= SPARSE)
    n, kinds, near, dense = x.T
    return np.column_stack([np.ones(len(x)), votes, np.minimum(n, 6) / 6, np.minimum(kinds, 4) / 4, np.minimum(near, 4) / 4, np.minimum(dense, 5) / 5]).astype(float)


def logistic(a: np.ndarray, target: np.ndarray, ridge: float = 3e-4, rounds: int = 60) -> np.ndarray:
    """Newton's method on soft targets."""
    w = np.zeros(a.shape[1])
    n = len(a)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - target) / n + ridge * w
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a / n + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    def __init__(self, train: list[tuple[str, int]]):
        self.hits = Hits(mine(train))
        count, x = self.hits.table([t for t, _ in train] or [None])
        votes = self.hits.votes(count, x)
        self.model = LabelModel(float(np.mean([y for _, y in train])) if train else 0.1).fit(votes, self.hits.kin())
        self.weights = logistic(design(votes, x), self.model.posterior(votes))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        count, x = self.hits.table(texts)
        # Rounded, as products of different shapes differ in the last bits and equal rows get equal scores.
        return np.round(1 / (1 + np.exp(-np.clip(design(self.hits.votes(count, x), x) @ self.weights, -30, 30))), 12)


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_train_rows: int) -> list[tuple[str, int]]:
    """Bounded sample of labelled rows: the ``max_train_rows`` first by a hash of the row."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("i"), "i").limit(max_train_rows)
    # The ids are bounded by the parameter, 16 bytes each; so are the rows, even if one id has many.
    got = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(some), "i")
    got = got.orderBy(F.xxhash64("i"), F.xxhash64("t")).limit(max_train_rows)
    return sorted(((r.t or "", r.y) for r in got.select("t", "y").collect()))


def score_toxicity(docs: DataFrame, train_docs: DataFrame | None = None, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train_rows: int = 4000, scorer: Scorer | None = None) -> DataFrame:
    """``id_col`` and ``score`` of every row; learns from the rows of ``train_docs`` that ``labels`` marks, unless ``scorer`` is given."""
    if scorer is None:
        scorer = Scorer(training_rows(train_docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_train_rows=max_train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.record_batch([part.column(0), pa.array(scorer.score(part.column(1).to_pylist()))], names=[id_col, "score"])

    slim = docs.select(id_col, text_col)
    return slim.mapInArrow(tidy(run), f"`{id_col}` {slim.schema[0].dataType.simpleString()}, score double")
