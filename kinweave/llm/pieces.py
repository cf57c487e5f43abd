"""SentencePiece encoding by unigram Viterbi, and decoding.

The pieces and log scores come from a public model file, never from training
here. They are laid out as a double-array trie over UTF-8 bytes (``base`` and
``check``: the child of state s by byte c is base[s] + c if check there is s).
Encoding finds the segmentation with the largest sum of log scores: from each
character's place the trie gives all pieces that start there; a character that
no single piece covers may stand for itself at the score of the worst piece
less 10, and is written as its bytes' pieces. Ties go to the segmentation
found first, places in order and pieces from short to long.

Spaces become the marker U+2581 and a marker is put in front. If no piece
holds a marker behind another character (checked when the model is read), the
best path never crosses the place in front of a marker run, so a text is
encoded word by word: the words of a slice are numbered by their bytes (an
Arrow dictionary), Viterbi runs on those not met before, at most ``MEMORY`` of
them and one slice more in a worker, and the ids of all rows are gathered by
number. Decoding is checked word by word, which is exact as it is a
concatenation. A marker character that stands in the text itself is written as
bytes, so that decoding gives back every text exactly.

Texts are encoded whole. Defined results: null text has null ids; empty text
has no ids; repeated rows give repeated results; only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.textbytes import row_slices, text_buffer, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MARK_BYTES = MARK.encode()
MEMORY = 120_000
SLICE = 1 << 20
LONG = 48
_LENGTH = [1] * 192 + [2] * 32 + [3] * 16 + [4] * 16
CHARACTER = np.array(_LENGTH, np.int64)


def double_array(words: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """base, check and value (number of the word that ends there, or -1) of a trie of distinct words."""
    order = sorted(range(len(words)), key=words.__getitem__)
    size = 1 << 12
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    free = 1
    # Ranges of words that share the first ``depth`` bytes, with their state.
    todo = [(0, len(order), 0, 0)]
    while todo:
        lo, hi, depth, state = todo.pop()
        if lo < hi and len(words[order[lo]]) == depth:
            value[state] = order[lo]
            lo += 1
        groups = []
        while lo < hi:
            c = words[order[lo]][depth]
            end = lo
            while end < hi and words[order[end]][depth] == c:
                end += 1
            groups.append((c, lo, end))
            lo = end
        if not groups:
            continue
        # Try places for the first child from the first that may be free; skip a stretch once it is nearly full.
        place, taken, began = free, 0, 0
        while True:
            if place + 600 > len(check):
                for a, x in ((base, 0), (check, -1), (value, -1)):
                    a.extend([x] * len(a))
            if check[place] >= 0:
                taken += 1
            else:
                if not began:
                    free = began = place
                at = place - groups[0][0]
                if at > 0 and all(check[at + c] < 0 for c, _, _ in groups):
                    break
                taken += len(groups) > 1
            place += 1
        if began and taken >= 0.9 * (place - began + 1) and place - began > 64:
            free = place
        base[state] = at
        for c, a, b in groups:
            check[at + c] = state
            todo.append((a, b, depth + 1, at + c))
    return base, check, value


class Pieces:
    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]):
        """kinds: 0 a normal piece, 1 a byte's piece, 2 one that stands for no text."""
        self.pieces, self.kinds = pieces, kinds
        normal = [i for i, k in enumerate(kinds) if k == 0 and pieces[i]]
        self.number = normal
        self.score = [scores[i] for i in normal]
        # In the trie a marker is the byte of a space, so a marker character of a text meets no piece.
        words = [pieces[i].encode().replace(MARK_BYTES, b" ") for i in normal]
        self.base, self.check, self.value = double_array(words)
        self.longest = max(map(len, words), default=0)
        self.byte_id = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == 1}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        self.alone = min(self.score, default=0.0) - 10
        # Pieces of ordinary score must have their markers in front for words to be independent.
        self.by_word = all(MARK not in pieces[i].lstrip(MARK) for i in normal)
        self.raw = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        kind = lambda i: 1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0
        return cls([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], [kind(i) for i in n])

    def best_path(self, b: bytes) -> list[int]:
        """Ids of the best segmentation of UTF-8 bytes in which spaces stand for markers."""
        n = len(b)
        base, check, value, score = self.base, self.check, self.value, self.score
        best = [-1e300] * (n + 1)
        best[0] = 0.0
        back = [(0, -1)] * (n + 1)
        at = 0
        while at < n:
            size = _LENGTH[b[at]]
            here = best[at]
            single = False
            state, k = 0, at
            while k < n:
                nxt = base[state] + b[k]
                if check[nxt] != state or nxt == 0:
                    break
                state = nxt
                k += 1
                v = value[state]
                if v >= 0:
                    s = here + score[v]
                    if s > best[k]:
                        best[k] = s
                        back[k] = (at, v)
                    single = single or k - at == size
            if not single:
                s = here + self.alone
                if s > best[at + size]:
                    best[at + size] = s
                    back[at + size] = (at, -1)
            at += size
        ids: list[int] = []
        while n:
            start, v = back[n]
            ids.extend((self.number[v],) if v >= 0 else [self.byte_id[x] for x in reversed(b[start:n])])
            n = start
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        return self.best_path(b" " + text.encode()) if text else []

    def raw_of(self, ids) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        text = self.raw_of(ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Words:
    """Paths of the words met so far in a worker: one flat array of ids, and for each word its place, length and count of byte pieces.

    Words are looked up by number, so a batch costs Python work only for its
    distinct words and Viterbi only for words not met before, all of them at
    once: place by place, the words that go on follow the trie together.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (pieces.base, pieces.check, pieces.value))
        self.score, self.number_of = np.array(pieces.score, np.float64), np.array(pieces.number, np.int32)
        self.byte_id = np.array([pieces.byte_id[i] for i in range(256)], np.int32)
        self.is_byte = np.array([k == 1 for k in pieces.kinds], np.int64)
        # Decoding is a concatenation, so a path is exact if its pieces' lengths and bytes are the word's.
        self.raw = np.frombuffer(b"".join(pieces.raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in pieces.raw])])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = [np.zeros(0, np.int32)]
        self.facts = [np.zeros((4, 0), np.int64)]  # place, length, byte pieces, whether decoding gives the word back
        self.used = 0

    def add(self, words: list[bytes]) -> None:
        ids, size = self.paths(words)
        at = np.concatenate([[0], np.cumsum(size)])
        low = np.concatenate([[0], np.cumsum(self.is_byte[ids])])[at]
        length = (self.raw_at[1:] - self.raw_at[:-1])[ids]
        back = self.raw[np.repeat(self.raw_at[ids] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        body = np.frombuffer(b"".join(words), np.uint8)
        upto = np.cumsum([len(w) for w in words])
        same = np.cumsum(length)[at[1:] - 1] == upto
        if len(back) == len(body):
            wrong = np.concatenate([[0], np.cumsum(back != body)])
            same &= np.diff(wrong[np.concatenate([[0], upto])]) == 0
        else:
            same[:] = [self.pieces.raw_of(ids[at[i] : at[i + 1]]) == w for i, w in enumerate(words)]
        self.facts.append(np.stack([at[:-1] + self.used, size, np.diff(low), same]))
        self.ids.append(ids)
        self.used += len(ids)
        n = len(self.number)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentations, one after the other, and the number of each; long words one by one."""
        size = np.array([len(w) for w in words], np.int64)
        short = np.flatnonzero(size <= LONG)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (word of each id, ids)
        for i in np.flatnonzero(size > LONG):
            path = self.pieces.best_path(words[i])
            found.append((np.full(len(path), i), np.array(path, np.int32)))
        if len(short):
            short = short[np.argsort(-size[short], kind="stable")]
            owner, ids = self._together([words[i] for i in short], size[short])
            found.append((short[owner], ids))
        owner, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _together(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of falling length: (word, id) of every id, in order within a word."""
        n, width = len(words), int(size[0])
        text = np.zeros((width + 1, n), np.uint8)  # a row for each place
        body = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(n), size)
        text[np.arange(len(body)) - np.repeat(np.cumsum(size) - size, size), owner] = body
        best = np.full((width + 1, n), -1e300)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)
        piece = np.full((width + 1, n), -1, np.int32)
        alive = n - np.searchsorted(size[::-1], np.arange(width), side="right")  # words longer than the place
        for at in range(width):
            m = int(alive[at])
            first = text[at, :m]
            go = np.flatnonzero((first & 0xC0) != 0x80)
            if not len(go):
                continue
            chars = CHARACTER[first[go]]
            single = np.zeros(len(go), bool)
            here = best[at, go]
            state, live = np.zeros(len(go), np.int32), np.arange(len(go))
            for k in range(at, min(width, at + self.pieces.longest)):
                nxt = self.base[state] + text[k, go[live]]
                ok = (self.check[nxt] == state) & (nxt != 0) & (k < size[go[live]])
                live, state = live[ok], nxt[ok]
                if not len(live):
                    break
                v = self.value[state]
                end = v >= 0
                i, v = live[end], v[end]
                single[i] |= chars[i] == k + 1 - at
                s = here[i] + self.score[v]
                w = go[i]
                better = s > best[k + 1, w]
                w = w[better]
                best[k + 1, w], back[k + 1, w], piece[k + 1, w] = s[better], at, v[better]
            for i in (np.flatnonzero(~single & (chars == c)) for c in (1, 2, 3, 4)):
                if len(i):
                    w, to = go[i], at + int(chars[i[0]])
                    s = here[i] + self.pieces.alone
                    better = s > best[to, w]
                    w = w[better]
                    best[to, w], back[to, w], piece[to, w] = s[better], at, -1
        steps, at, w = [], size.copy(), np.arange(n)
        while len(w):
            start, v = back[at, w], piece[at, w]
            steps.append((w, start, at, v))
            more = start > 0
            w, at = w[more], start[more].astype(np.int64)
        w, start, end, v = (np.concatenate(x) for x in zip(*steps, strict=True))
        o = np.argsort(w * (width + 1) + start)
        w, start, end, v = w[o], start[o], end[o], v[o]
        times = np.where(v >= 0, 1, end - start)
        step = np.repeat(np.arange(len(w)), times)
        place = start[step] + np.arange(len(step)) - (np.cumsum(times) - times)[step]
        ids = np.where(v[step] >= 0, self.number_of[v[step]], self.byte_id[text[place, w[step]]])
        return w[step], ids.astype(np.int32)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and for each row their number, the byte pieces and whether it decodes exactly.

        ``raw`` holds the rows with one space put in front of each; offsets are theirs.
        """
        space = raw == 32
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[offsets[:-1]] = True
        start = np.flatnonzero(head)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(raw)).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        if len(self.number) > MEMORY:
            self.clear()
        distinct = words.dictionary.to_pylist()
        known = self.number
        unseen = [w for w in distinct if w not in known]
        if unseen:
            self.add(unseen)
            self.ids, self.facts = [np.concatenate(self.ids)], [np.concatenate(self.facts, axis=1)]
        number = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        place, size, low, same = self.facts[0][:, number]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[0][np.repeat(place - upto[:-1], size) + np.arange(upto[-1])]
        at = np.searchsorted(start, offsets)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        return ids, np.diff(upto[at]), total(low), total(1 - same) == 0


def encode_batch(pieces: Pieces, words: Words, texts: pa.Array) -> tuple[pa.Array, ...]:
    """ids, n_tokens, n_byte_pieces and exact of every text of a slice."""
    null = np.asarray(texts.is_null())
    raw, offsets = text_buffer(texts)
    n = len(texts)
    count, low, exact = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    flat = np.zeros(0, np.int32)
    if len(raw):
        full = np.flatnonzero(np.diff(offsets))
        at = np.concatenate([[0], np.cumsum(np.diff(offsets)[full] + 1)])
        spaced = np.full(at[-1], 32, np.uint8)
        inside = np.ones(at[-1], bool)
        inside[at[:-1]] = False
        spaced[inside] = raw
        flat, count[full], low[full], exact[full] = _in_parts(pieces, words, spaced, at)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat), mask=pa.array(null) if null.any() else None)
    return (lists, *(pa.array(x, mask=null) for x in (count, low, exact)))


def _in_parts(pieces: Pieces, words: Words, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As Words.encode; a text longer than a slice is cut in front of a word, so memory does not grow with it but for its ids."""
    if not pieces.by_word:
        paths = [np.array(pieces.best_path(bytes(raw[a:b])), np.int32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        exact = [pieces.raw_of(x) == bytes(raw[a:b]) for x, a, b in zip(paths, offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate(paths), np.array([len(x) for x in paths]), np.array([words.is_byte[x].sum() for x in paths]), np.array(exact)
    if len(raw) <= 2 * SLICE or len(offsets) > 2:
        return words.encode(raw, offsets)
    found, a = [], 0
    while a < len(raw):
        b = min(a + SLICE, len(raw))
        while b < len(raw) and not (raw[b] == 32 and raw[b - 1] != 32):
            b += 1
        found.append(words.encode(raw[a:b], np.array([0, b - a])))
        a = b
    ids, count, low, exact = zip(*found, strict=True)
    return np.concatenate(ids), sum(count), sum(low), np.logical_and.reduce(exact)


def encode_texts(docs: DataFrame, pieces: Pieces | None = None, *, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, n_tokens, n_byte_pieces (ids that stand for a byte) and exact (decoding gives the text back) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((pieces or Pieces.load(model)).__dict__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces.__new__(Pieces)
        p.__dict__.update(sent.value)
        words = Words(p)
        for batch in batches:
            # A batch's lists have 32-bit offsets, and one text may be long: rows go out by slices.
            _, offsets = text_buffer(batch.column(1))
            for a, b in row_slices(offsets, SLICE):
                part = batch.slice(a, b - a)
                yield pa.record_batch([part.column(0), *encode_batch(p, words, part.column(1))], names=[id_col, "ids", "n_tokens", "n_byte_pieces", "exact"])

    slim = docs.select(id_col, text_col)
    return slim.mapInArrow(tidy(run), f"`{id_col}` {slim.schema[0].dataType.simpleString()}, ids array<int>, n_tokens long, n_byte_pieces long, exact boolean")


def decode_ids(rows: DataFrame, pieces: Pieces | None = None, *, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; null ids give null, ids outside the model an error."""
    sent = rows.sparkSession.sparkContext.broadcast((pieces or Pieces.load(model)).__dict__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces.__new__(Pieces)
        p.__dict__.update(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.record_batch([part.column(0), pa.array([None if x is None else p.decode(x) for x in part.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    slim = rows.select(id_col, ids_col)
    return slim.mapInArrow(tidy(run), f"`{id_col}` {slim.schema[0].dataType.simpleString()}, text string")
