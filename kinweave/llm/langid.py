"""Language identification: a bidirectional gated recurrent network over bytes.

A GRU reads every byte of a text from both sides, a linear layer labels every
position with a language, and a document's probabilities are the mean of its
positions' probabilities over bytes that can belong to letters (ASCII letters
and bytes from 0x80). Texts are cut into windows of ``WINDOW`` bytes, in each
of which both directions start anew, so a text of any length is read whole and
memory is bounded by the slice of a batch, not by the text.

The network is trained here, in numpy, by backpropagation through time, on a
bounded sample of the rows that the caller allows: at most
``docs_per_language`` documents of each language, taken in the order of a hash
of the id (so the sample is the same on every run), and windows drawn from all
over each of them.

Defined results
    null text, empty text, text without any letter (Unicode category L):
    ``und`` with score 0. No labelled row at all: every text is ``und``.
    Ties between languages: the smallest by code point. Repeated rows give
    repeated results. Extra columns are kept out of the way: only the named
    columns are read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.textbytes import row_slices, text_buffer, tidy

WINDOW = 128
HIDDEN = 8
SLICE = 1 << 20
PIECE = 9216  # windows at once
PART = PIECE * WINDOW
UND = "und"
#: Bytes that can belong to letters: a-z, A-Z, and all of longer UTF-8 sequences.
LETTER_BYTES = np.array([chr(b).isascii() and chr(b).isalpha() or b >= 128 for b in range(256)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fast_tanh(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """tanh in place by its [5/4] Pade approximant (off by less than 2e-3): no library call per element; a, b: buffers."""
    np.clip(x, -3.646, 3.646, out=x)
    np.multiply(x, x, out=a)
    np.add(a, 105, out=b)
    b *= a
    b += 945
    x *= b
    np.multiply(a, 15, out=b)
    b += 420
    b *= a
    b += 945
    x /= b


class ByteBiGru:
    """Parameters are float32; one dictionary per direction plus the label layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, n = hidden, len(labels)
        self.labels, self.hidden = labels, h
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            for g in "zrn":
                self.p[f"{d}W{g}"] = rng.normal(0, 0.3, (256, h)).astype(np.float32)
                self.p[f"{d}U{g}"] = rng.normal(0, 0.5 / np.sqrt(h), (h, h)).astype(np.float32)
            self.p[f"{d}V"] = rng.normal(0, 0.5 / np.sqrt(h), (h, n)).astype(np.float32)
        self.p["c"] = np.zeros(n, np.float32)

    # One direction over windows of bytes x (rows, steps); mask marks real bytes.
    def _scan(self, d: str, x: np.ndarray, keep: bool):
        p, (rows, steps), h = self.p, x.shape, self.hidden
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        state = np.zeros((rows, h), np.float32)
        outs = np.empty((steps, rows, h), np.float32)
        saved = []
        for t in order:
            b = x[:, t]
            z = _sigmoid(p[f"{d}Wz"][b] + state @ p[f"{d}Uz"])
            r = _sigmoid(p[f"{d}Wr"][b] + state @ p[f"{d}Ur"])
            rs = r * state
            n = np.tanh(p[f"{d}Wn"][b] + rs @ p[f"{d}Un"])
            new = state + z * (n - state)
            if keep:
                saved.append((t, state, z, r, rs, n))
            state = new
            outs[t] = new
        return outs, saved

    def _logits(self, x: np.ndarray, keep: bool = False):
        f, sf = self._scan("f", x, keep)
        b, sb = self._scan("b", x, keep)
        return f, b, f @ self.p["fV"] + b @ self.p["bV"] + self.p["c"], sf, sb

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
        p = self.p
        f, b, logits, sf, sb = self._logits(x, keep=True)
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        w = (weight.T / max(weight.sum(), 1)).astype(np.float32)
        rows = np.arange(x.shape[0])
        loss = float(-(np.log(prob[:, rows, y] + 1e-9) * w).sum())
        dl = prob
        dl[:, rows, y] -= 1
        dl *= w[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["c"] = dl.sum((0, 1))
        for d, outs, saved in (("f", f, sf), ("b", b, sb)):
            g[f"{d}V"] = np.einsum("trh,trk->hk", outs, dl, optimize=True)
            dh_out = dl @ p[f"{d}V"].T
            carry = np.zeros_like(outs[0])
            flat: dict[str, list[np.ndarray]] = {"z": [], "r": [], "n": []}
            bytes_at = []
            for t, s, z, r, rs, n in reversed(saved):
                dh = carry + dh_out[t]
                dn = dh * z * (1 - n * n)
                dz = dh * (n - s) * z * (1 - z)
                drs = dn @ p[f"{d}Un"].T
                dr = drs * s * r * (1 - r)
                carry = dh * (1 - z) + drs * r + dz @ p[f"{d}Uz"].T + dr @ p[f"{d}Ur"].T
                g[f"{d}Uz"] += s.T @ dz
                g[f"{d}Ur"] += s.T @ dr
                g[f"{d}Un"] += rs.T @ dn
                bytes_at.append(x[:, t])
                for k, v in (("z", dz), ("r", dr), ("n", dn)):
                    flat[k].append(v)
            at = np.concatenate(bytes_at)
            for k, v in flat.items():
                v = np.concatenate(v)
                g[f"{d}W{k}"] = np.stack([np.bincount(at, v[:, j], 256) for j in range(self.hidden)], 1).astype(np.float32)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 180, batch: int = 160, rate: float = 0.025, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        by_label = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        for i in range(1, steps + 1):
            at = np.concatenate([rng.choice(w, -(-batch // len(by_label))) for w in by_label])
            _, g = self.step(x[at], y[at], weight[at])
            lr = rate * (1 - 0.9 * i / steps)
            for k, d in g.items():
                np.clip(d, -1, 1, out=d)
                m[k] += 0.1 * (d - m[k])
                v2[k] += 0.01 * (d * d - v2[k])
                self.p[k] -= lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v2[k] / (1 - 0.99**i)) + 1e-8)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Labels every position of the windows x and returns the sums, (rows, labels), of the probabilities of their letter bytes.

        The same forward pass as in training with every buffer reused: halves
        of the sigmoids are folded into the weights, and a byte that is no
        letter gets logits so low that its probabilities vanish.
        """
        p, (rows, steps), h, k = self.p, x.shape, self.hidden, len(self.labels)
        xt = np.ascontiguousarray(x.T)
        bias = np.where(LETTER_BYTES[:, None], p["c"], np.float32(-80)).astype(np.float32)
        ones = np.ones((k, k), np.float32)
        forward = np.empty((steps, rows, k), np.float32)
        g, r, n, u, v, w = (np.empty((rows, h), np.float32) for _ in range(6))
        lo, den = np.empty((rows, k), np.float32), np.empty((rows, k), np.float32)
        total = np.zeros((rows, k), np.float32)
        for d in "fb":
            wz, wr, uz, ur = (p[f"{d}{m}"] * np.float32(0.5) for m in ("Wz", "Wr", "Uz", "Ur"))
            wn, un, out = p[f"{d}Wn"], p[f"{d}Un"], p[f"{d}V"]
            s = np.zeros((rows, h), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                b = xt[t]
                np.matmul(s, uz, out=g)
                np.take(wz, b, axis=0, out=u, mode="clip")
                g += u
                fast_tanh(g, v, w)
                g += 1
                np.matmul(s, ur, out=r)
                np.take(wr, b, axis=0, out=u, mode="clip")
                r += u
                fast_tanh(r, v, w)
                r += 1
                r *= s
                r *= np.float32(0.5)
                np.matmul(r, un, out=n)
                np.take(wn, b, axis=0, out=u, mode="clip")
                n += u
                fast_tanh(n, v, w)
                n -= s
                n *= g
                n *= np.float32(0.5)
                s += n
                np.matmul(s, out, out=lo)
                if d == "f":
                    np.take(bias, b, axis=0, out=forward[t], mode="clip")
                    forward[t] += lo
                    continue
                lo += forward[t]
                np.minimum(lo, 60, out=lo)
                np.exp(lo, out=lo)
                np.matmul(lo, ones, out=den)
                den += np.float32(1e-25)
                lo /= den
                total += lo
        return total


def cut(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a slice of texts as (rows, window) bytes, the text of each, and which bytes can belong to letters."""
    lengths = np.diff(offsets)
    parts = -(-lengths // window)
    doc = np.repeat(np.arange(len(lengths)), parts)
    first = np.cumsum(parts) - parts
    start = offsets[:-1][doc] + (np.arange(len(doc)) - first[doc]) * window
    if len(doc) == 0:
        return np.zeros((0, window), np.uint8), doc, np.zeros((0, window), bool)
    at = start[:, None] + np.arange(window)
    real = at < offsets[1:][doc][:, None]
    x = np.where(real, raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8)
    return x, doc, LETTER_BYTES[x]  # the filling, 0, is none


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def train(sample: list[tuple[str, str]], windows_per_doc: int = 8, seed: int = 5) -> ByteBiGru | None:
    """Fits the network on (text, language) rows; None without any usable row."""
    labels = sorted({lang for text, lang in sample if has_letter(text)})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    xs, ys, ws = [], [], []
    for text, lang in sample:
        if not has_letter(text):
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        x, _, mask = cut(raw, np.array([0, len(raw)]))
        some = rng.permutation(len(x))[:windows_per_doc]
        xs.append(x[some])
        ws.append(mask[some])
        ys.append(np.full(len(some), labels.index(lang)))
    net = ByteBiGru(labels)
    if len(labels) > 1:
        net.fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))
    return net


def predict_batch(net: ByteBiGru | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    raw, offsets = text_buffer(texts)
    n = len(texts)
    total = np.zeros((n, len(net.labels) if net else 1))
    count = np.zeros(n)
    if net:
        for a, b in row_slices(offsets, SLICE):
            whole, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            # A text longer than a slice stands alone and is read in parts of whole windows.
            parts = [(whole, at)] if b - a > 1 else [(whole[i : i + PART], np.array([0, len(whole[i : i + PART])])) for i in range(0, len(whole), PART)]
            for part, ends in parts:
                x, doc, mask = cut(part, ends)
                for i in range(0, len(x), PIECE):
                    m = mask[i : i + PIECE]
                    if not m.any():
                        continue
                    by_window = net.pooled(x[i : i + PIECE])
                    of = doc[i : i + PIECE] + a
                    for k in range(total.shape[1]):
                        total[:, k] += np.bincount(of, by_window[:, k], n)
                    count += np.bincount(of, m.sum(1), n)
    # Only texts without ASCII letters need a look at their characters.
    plain = np.zeros(n, bool)
    for a, b in row_slices(offsets, SLICE):
        low = raw[offsets[a] : offsets[b]] | 32
        seen = np.concatenate([np.zeros(1, np.int32), np.cumsum((low >= 97) & (low <= 122), dtype=np.int32)])
        at = offsets[a : b + 1] - offsets[a]
        plain[a:b] = seen[at[1:]] > seen[at[:-1]]
    ok = np.array([bool(plain[i]) or (count[i] > 0 and has_letter(texts[i].as_py())) for i in range(n)], bool) & (count > 0)
    score = total / np.maximum(count, 1)[:, None]
    best = score.argmax(1)
    names = [net.labels[k] if good else UND for k, good in zip(best, ok, strict=True)] if net else [UND] * n
    return names, np.where(ok, np.clip(score[np.arange(n), best], 0, 1), 0.0)


def bounded_sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int) -> list[tuple[str, str]]:
    """At most ``docs_per_language`` labelled rows of each language, in the order of a hash of the row.

    Rows, not ids, are chosen, by hashes of 16 bytes; what comes to the driver is bounded by the parameter even if ids repeat.
    """
    lang, text = F.col(lang_col), F.col(text_col)
    own = rows.where(lang.isNotNull() & text.isNotNull()).select(lang.alias("l"), F.xxhash64(F.col(id_col)).alias("h"), F.xxhash64(text).alias("g"), text.alias("t"))
    order = Window.partitionBy("l").orderBy("h", "g")
    # Equal rows are one; the limit on the row number cuts each task's rows before they are dealt by language.
    chosen = own.select("l", "h", "g").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_language).select("l", "h", "g")
    got = own.join(F.broadcast(chosen), ["l", "h", "g"]).select("l", "t").distinct()
    return sorted((r.t, r.l) for r in got.collect())


def fit(train_rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 200) -> ByteBiGru | None:
    return train(bounded_sample(train_rows, id_col, text_col, lang_col, docs_per_language))


def identify(docs: DataFrame, net: ByteBiGru | None, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns named in ``carry``, then the language and its score, named by ``results``, of every row of ``docs``."""
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = predict_batch(net, batch.column(0))
            yield pa.record_batch([*batch.columns[1:], pa.array(found, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    slim = docs.select(F.col(text_col).alias("t"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)])
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    out = slim.mapInArrow(tidy(run), f"{kept}, lang_pred string, score double")
    return out.select(*[F.col(n).alias(c) for n, c in zip((*names, "lang_pred", "score"), (*carry, *results), strict=True)])
