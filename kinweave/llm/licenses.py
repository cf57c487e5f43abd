"""License scans by an exact set-similarity join. DataFrame functions only.

A text's paragraphs (parts between blank lines) are its blocks, so a notice
wrapped over several lines is one. A block meets a template of n distinct words
if some ``WINDOW`` * n words in a row hold at least ``THRESHOLD`` of them, all
of those that tell the template from a similar one of another license, and none
of those that the similar one has instead (CC BY-NC is neither CC BY nor CC
BY-SA). So a long block that merely holds the words here and there is none. The
join is exact:

* tokens are ordered globally, rarest first, by the number of documents of the
  whole input that hold them;
* prefix filter: of a template's n words, o = ceil(threshold * n) must be in
  the block, so at least one of its n - o + 1 rarest must be; blocks without
  any such word are dropped before the join, and the join's key is that word;
* length filter: a block of fewer than o words cannot meet the template;
* positional filter: the words that can still be shared after the place of a
  common prefix word must reach o;
* what is left is verified on the full sets, then window by window.

Texts are cut into words once; what later steps need of them, and of texts that
hold ``THRESHOLD`` of some template's words the text, is written to the shared
folder. The table of templates is a constant of this module, so it is broadcast,
and the counts that come to the driver are one per known word.

Beside the join stand the base labels: the places where a known phrase's words
stand one after the other.

Defined results: null or empty text has no words, no labels, score 0. Words
are compared after lower-casing A-Z only. Rows with equal ids are scanned each
for itself. Only the named columns are read.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.storage import materialize

#: Words after lower-casing, as a pattern for both engines.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
WINDOW = 2
#: What parts blocks, as a pattern for both engines.
GAP = r"\n[\x09\x0D\x20]*\n"

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Usual notices of public licenses, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}


def _template_rows() -> list[tuple[int, str, list[str]]]:
    import re

    rows = []
    for label, texts in TEMPLATES.items():
        for text in texts:
            rows.append((len(rows), label, list(dict.fromkeys(re.findall(WORD, text.lower())))))
    return rows


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() changes other letters too, but never from or to ASCII once the two that do are set aside."""
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")), F.lit("İ"), F.lit("Å")))


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def vocabulary() -> list[str]:
    """The words of templates and phrases."""
    return sorted({w for _, _, words in _template_rows() for w in words} | {w for phrase in PHRASES for w in phrase.split()})


def token_order(docs: DataFrame) -> list[str]:
    """Known words, rarest first by texts that hold them (column held), ties by word; as many rows as there are known words."""
    counts = {r.token: r.n for r in docs.select(F.explode("held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary(), key=lambda w: (counts.get(w, 0), w))


def needed(n: int, threshold: float) -> int:
    """Words of a template of n that a block must hold."""
    return max(1, math.ceil(threshold * n - 1e-9))


def _any(conditions) -> Column:
    return functools.reduce(operator.or_, conditions)


def prefix_index(order: list[str], threshold: float = THRESHOLD) -> list[tuple[str, int, str, int, int, int, list[str]]]:
    """(token, template, label, place, size, needed, words in global order) for each word of each template's prefix."""
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for i, label, words in _template_rows():
        words = sorted(words, key=rank.__getitem__)
        n = len(words)
        need = needed(n, threshold)
        out += [(w, i, label, place, n, need, words) for place, w in enumerate(words[: n - need + 1])]
    return out


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def deciding_words() -> dict[int, tuple[list[str], list[str]]]:
    """For each template the words it must have and must not have, from those of other licenses that share ``THRESHOLD`` of its or their own words."""
    rows, out = _template_rows(), {}
    for i, label, words in rows:
        must, not_ = set(), set()
        for _, other, theirs in rows:
            shared = len(set(words) & set(theirs))
            if other != label and shared >= THRESHOLD * min(len(words), len(theirs)):
                must |= set(words) - set(theirs) if len(set(words) - set(theirs)) <= len(words) / 4 else set()
                not_ |= set(theirs) - set(words) if len(set(theirs) - set(words)) <= len(theirs) / 4 else set()
        out[i] = sorted(must), sorted(not_)
    return out


def base_columns(norm: Column) -> dict[str, Column]:
    """Of ' word word ... ': places, first and last start and label of each phrase."""
    n, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        probe = f" {phrase} "
        at = F.instr(norm, probe)
        back = F.instr(F.reverse(norm), probe[::-1])
        start = F.char_length(norm) - back - len(probe) + 2
        n.append(F.regexp_count(norm, F.lit(f" {phrase}(?= )")))
        first.append(F.when(at > 0, _spaces(F.substring(norm, F.lit(1), at)) - 1))
        last.append(F.when(back > 0, _spaces(F.substring(norm, F.lit(1), start)) - 1))
        labels.append(F.when(at > 0, F.lit(label)))
    return {"n_base": sum(n[1:], n[0]).cast("long"), "first_word": F.least(*first).cast("long"), "last_word": F.greatest(*last).cast("long"), "base": F.array_sort(F.array_compact(F.array(*labels)))}


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, blocks: bool = False) -> DataFrame:
    """A row per text with its words, base places and labels; with ``blocks``, a row per block and template that meet."""
    spark = docs.sparkSession
    # One pass over the texts: words once a text; only texts that hold enough of a template, or a phrase's words, go on with more.
    docs = docs.select(F.col(id_col).alias("i"), lowered(F.col(text_col)).alias("low"))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "i", "low", words_of(F.col("low")).alias("words"))
    docs = docs.withColumn("held", F.array_intersect(F.array(*map(F.lit, vocabulary())), "words"))
    has = lambda words, n: F.size(F.array_intersect("held", F.array(*map(F.lit, words)))) >= n
    phrase = _any(has(phrase.split(), len(set(phrase.split()))) for phrase in PHRASES)
    enough = _any(has(words, needed(len(words), threshold)) for _, _, words in _template_rows())
    norm = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    docs = docs.select("row", "i", "held", F.size("words").cast("long").alias("n_words"), F.when(phrase, norm).alias("norm"), F.when(enough, F.col("low")).alias("low"))
    facts = base_columns(F.col("norm"))
    docs = materialize(docs.select("row", "i", "held", "n_words", "low", *[c.alias(k) for k, c in facts.items()]), "licenses")
    order = token_order(docs)
    index = prefix_index(order, threshold)
    starts = F.array(*map(F.lit, sorted({r[0] for r in index})))
    known = F.array(*map(F.lit, order))
    telling = deciding_words()
    templates = spark.createDataFrame([(*r, *telling[r[1]]) for r in index], "token string, template int, label string, place int, n int, need int, words array<string>, must array<string>, must_not array<string>")

    # Only blocks with a prefix word go on.
    some = F.filter(F.split("low", GAP), lambda line: F.arrays_overlap(words_of(line), starts))
    docs = docs.withColumn("lines", F.when(F.arrays_overlap("held", starts), some))
    docs = docs.select("row", "i", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base", F.array().cast("array<string>")).alias("base"), F.posexplode_outer("lines").alias("block", "line"))
    tokens = F.array_distinct(words_of(F.col("line")))
    docs = docs.withColumn("tokens", tokens).withColumn("held", F.array_intersect(known, F.col("tokens"))).withColumn("n_tokens", F.size("tokens"))
    keep = ["row", "i", "n_words", "n_base", "first_word", "last_word", "base", "block", "line", "n_tokens", "held"]
    docs = docs.drop("tokens").select(*keep, F.posexplode_outer(F.when(F.arrays_overlap("held", starts), F.col("held"))).alias("held_at", "token"))

    could = F.lit(1) + F.least(F.col("n") - F.col("place") - 1, F.size("held") - F.col("held_at") - 1)
    met = docs.join(F.broadcast(templates), "token", "left")
    shared = F.size(F.array_intersect("held", "words"))
    earlier = F.size(F.array_intersect(F.slice("held", F.lit(1), F.col("held_at")), F.col("words")))
    # Each pair of a block and a template counts at its first common word only, where the positional bound holds.
    good = (F.col("n_tokens") >= F.col("need")) & (earlier == 0) & (could >= F.col("need")) & (shared >= F.col("need"))
    # Windows begin at a word of the template; only blocks that hold enough of it come here.
    seq = words_of(F.col("line"))
    starts_at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(seq), F.lit(1))), lambda k: F.array_contains(F.col("words"), F.get(F.col("seq"), k - 1)))

    def in_window(k: Column) -> Column:
        part = F.slice(F.col("seq"), k, F.lit(WINDOW) * F.col("n"))
        held = F.size(F.array_intersect("words", part))
        told = (F.size(F.array_intersect("must", part)) == F.size("must")) & ~F.arrays_overlap("must_not", part)
        return F.when((held >= F.col("need")) & told, held).otherwise(0)

    met = met.withColumn("seq", F.when(good, seq)).withColumn("best", F.array_max(F.transform(starts_at, in_window)))
    met = met.withColumn("share", F.when(F.col("best") > 0, F.col("best") / F.col("n")))
    if blocks:
        return met.where("share is not null").select(F.col("i").alias(id_col), "block", "line", "label", "template", "share")
    out = met.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("i", "n_words", "n_base", "first_word", "last_word", "base")],
        F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("own"),
        F.max("share").alias("share"),
    )
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select(F.col("i").alias(id_col), "n_words", "n_base", "first_word", "last_word", join(F.col("base")).alias("base_labels"), join(F.array_union("base", "own")).alias("labels"), score.alias("score"))



def oracle_sql() -> str:
    """The same results by comparing every block with every template."""
    listed = lambda words: f"[{', '.join(repr(w) for w in words)}]::VARCHAR[]"
    telling = deciding_words()
    values = ", ".join(f"({i}, '{label}', {listed(words)}, {max(1, math.ceil(THRESHOLD * len(words) - 1e-9))}, {listed(telling[i][0])}, {listed(telling[i][1])})" for i, label, words in _template_rows())
    base = ", ".join(f"('{label}', [{', '.join(repr(w) for w in phrase.split())}])" for phrase, label in PHRASES.items())
    return rf"""
WITH templates(template, label, words, need, must, must_not) AS (VALUES {values}),
phrases(label, words) AS (VALUES {base}),
docs AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
worded AS (SELECT row, doc_id, low, regexp_extract_all(low, '{WORD}') AS words FROM docs),
blocks AS (SELECT row, unnest(string_split_regex(low, '{GAP}')) AS block FROM docs),
sets AS (SELECT row, regexp_extract_all(block, '{WORD}') AS seq FROM blocks),
near AS (SELECT s.row, s.seq, t.* FROM sets s, templates t WHERE len(list_intersect(t.words, s.seq)) >= t.need),
parts AS (SELECT row, label, words, need, must, must_not, unnest(list_transform(range(1, len(seq) + 1), lambda k: seq[k : k + {WINDOW} * len(words) - 1])) AS part FROM near),
met AS (
  SELECT row, label, len(list_intersect(words, part)) / len(words) AS share FROM parts
  WHERE len(list_intersect(words, part)) >= need AND len(list_intersect(must, part)) = len(must) AND len(list_intersect(must_not, part)) = 0),
own AS (SELECT row, list(DISTINCT label) AS own, max(share) AS share FROM met GROUP BY row),
places AS (
  SELECT w.row, p.label, unnest(range(0, len(w.words) - len(p.words) + 1)) AS pos, w.words AS have, p.words AS want
  FROM worded w, phrases p WHERE len(w.words) >= len(p.words)),
base AS (
  SELECT row, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base
  FROM places WHERE have[pos + 1 : pos + len(want)] = want GROUP BY row)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels,
  CASE WHEN base IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM worded w LEFT JOIN base b USING (row) LEFT JOIN own o USING (row)
"""
