"""License scans by diagonal voting over word k-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, table
from tessera.shipping import ship

#: A word: letters a-z and digits, and all that is not ASCII, once A-Z are lower case.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IN_WORD = np.array([b >= 128 or 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 for b in range(256)])
_TO_LOWER = np.array([b + 32 * (65 <= b < 91) for b in range(256)], dtype=np.uint8)
#: Numbers of bytes and of their places in a word, and bytes that are hashed at a time.
_BYTE = np.random.default_rng(51).integers(1, 1 << 63, size=256, dtype=np.uint64)
_PLACE = np.random.default_rng(52).integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)
SEGMENT = 1 << 20

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wordings that grant or name a license, with the method's labels. Their k-grams are longer than a phrase's.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "all rights reserved": "all-rights-reserved",
}


def words_in(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def gram_rows(phrases: Mapping[str, str], templates: Mapping[str, str]) -> list[tuple[int, str, int, str, bool, int, int]]:
    rows = []
    for i, (text, label) in enumerate([*phrases.items(), *templates.items()]):
        w, base = words_in(text), i < len(phrases)
        n = 2 if base or len(w) < 4 else 4
        rows += [(n, " ".join(w[p : p + n]), i, label, base, p, len(w) - n + 1) for p in range(len(w) - n + 1)]
    return rows


def template_grams(spark: SparkSession, phrases: Mapping[str, str], templates: Mapping[str, str]) -> DataFrame:
    """(k, gram, template, label, base, place, n_grams): the positions of every template's k-grams; k is 4, but 2 for phrases and templates of fewer words."""
    return spark.createDataFrame(gram_rows(phrases, templates), "k int, gram string, template int, label string, base boolean, place int, n_grams int")


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, hash) of the words in the bytes of lower-case texts that begin at ``at``; no word runs over two texts. A word's hash is a sum of its bytes' numbers times those of their places."""
    inside = _IN_WORD[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[at] = True
    start = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stop = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    n = stop - start
    place = np.flatnonzero(inside) - np.repeat(start, n)
    x = _BYTE[raw[inside]] * _PLACE[place & (len(_PLACE) - 1)]
    return start, stop, np.add.reduceat(x, np.cumsum(n) - n) if len(n) else np.zeros(0, dtype=np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of k words."""
    out = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * _PLACE[i]
    return out


def segments(data: bytes | memoryview, sizes: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """(from, to, starts of texts) of the bytes of texts one after the other: many short texts, or part of a long one that ends before a word, SEGMENT bytes at most where words allow it."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        begin = int(ends[i] - sizes[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + SEGMENT, side="right")))
        if int(ends[j - 1]) - begin <= SEGMENT:
            yield begin, int(ends[j - 1]), (ends[i:j] - sizes[i:j]).tolist()
        else:  # one long text
            at, raw = begin, np.frombuffer(data, dtype=np.uint8)
            while at < ends[i]:
                to = min(at + SEGMENT, int(ends[i]))
                while to < ends[i] and len(gaps := np.flatnonzero(~_IN_WORD[raw[at:to]])) == 0:
                    to = min(to + SEGMENT, int(ends[i]))
                if to < ends[i]:
                    to = at + int(gaps[-1]) + 1
                yield at, to, [begin]
                at = to
        i = j


def find_grams(known: Mapping[int, list[str]]):
    """(rid, doc_id, n_words, hits): the words of every text, and its k-grams (k, at, gram) that are in ``known``, in order."""
    wanted = {k: (np.unique(np.array([gram_hashes(word_spans(*_alone(g.encode()))[2], k)[0] for g in grams], dtype=np.uint64)), set(grams)) for k, grams in known.items()}
    kinds = pa.struct([("k", pa.int32()), ("at", pa.int32()), ("gram", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).fill_null(b"")
            sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1])
            from_ = int(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset]) if len(texts) else 0
            data = memoryview(texts.buffers()[2] or b"")[from_ : from_ + int(sizes.sum())]
            starts = np.cumsum(sizes) - sizes
            n_words, hits = np.zeros(len(texts), dtype=np.int64), [[] for _ in range(len(texts))]
            tail: tuple = (-1, np.zeros(0, dtype=np.uint64), [])  # row, hashes and words of the last words of a long text so far
            for lo, hi, begins in segments(data, sizes):
                raw = _TO_LOWER[np.frombuffer(data[lo:hi], dtype=np.uint8)]
                start, stop, h = word_spans(raw, np.array([max(0, x - lo) for x in begins], dtype=np.int64))
                # of texts that begin at one place all but the last are empty
                row = np.searchsorted(starts, start + lo, side="right") - 1
                carried = 0
                if tail[0] >= 0 and begins == [int(starts[tail[0]])] and lo > begins[0]:
                    carried, h, row = len(tail[1]), np.concatenate([tail[1], h]), np.concatenate([np.full(len(tail[1]), tail[0]), row])
                word = lambda x: tail[2][x] if x < carried else raw[start[x - carried] : stop[x - carried]].tobytes()  # noqa: B023, E731
                new = np.arange(len(h)) >= carried
                first = np.searchsorted(row, row)  # the first word here of the same text
                before = n_words.copy()
                for k, (keys, grams) in wanted.items():
                    g = gram_hashes(h, k)
                    for x in np.flatnonzero(np.isin(g, keys) & (row[: len(g)] == row[k - 1 :]) & new[k - 1 :]).tolist() if len(g) else ():
                        gram = b" ".join(word(y) for y in range(x, x + k)).decode("utf-8", "replace")
                        if gram in grams:
                            r = int(row[x])
                            hits[r].append((k, int(before[r] + x - first[x] - (carried if r == tail[0] else 0)), gram))
                n_words += np.bincount(row[carried:], minlength=len(n_words))
                last = max(0, len(h) - 3)
                if len(begins) == 1 and len(h):
                    tail = (int(row[-1]), h[last:], [word(y) for y in range(last, len(h))])
            found = [[dict(zip(("k", "at", "gram"), x)) for x in sorted(r)] for r in hits]
            yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + len(texts)), pa.int64()), b.column(0), pa.array(n_words), pa.array(found, pa.list_(kinds))], names=["rid", "doc_id", "n_words", "hits"])
            rid += len(texts)

    return run


def _alone(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(raw, dtype=np.uint8), np.zeros(1, dtype=np.int64)


def in_order(hits: Column) -> Column:
    """Length of the longest run of (at, -place) structs, sorted, in which places rise with words: for each length the smallest place that ends such a run is kept."""
    ends = F.aggregate(hits, F.array().cast("array<int>"), lambda s, x: _placed(s, -x["back"]))
    return F.size(ends)


def _placed(ends: Column, place: Column) -> Column:
    less = F.filter(ends, lambda e: e < place)
    n = F.size(less)
    return F.concat(less, F.array(place), F.slice(ends, n + 2, F.greatest(F.size(ends) - n - 1, F.lit(0))))


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, drift: int = 3, least: float = 0.7) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Rolling hashes of all 2-grams and 4-grams of a document's words are looked up in those of the templates; what is
    found is compared in full and meets the template positions in a Spark join (of a broadcast side as large as the
    templates). Meetings vote for their diagonal, word minus place. A phrase stands where its diagonal has all its
    2-grams. For longer templates each diagonal is merged with the ``drift`` diagonals after it, which bridges inserted
    or missing words, and no more: a span is as long as its template and ``drift`` words at most. The span is verified by
    the longest run of its meetings in which words and places both rise; a share of the template's grams of
    ``least`` or more adds the template's label. score is the largest share of any template, 1 for a phrase.

    Null and empty texts have no words: counts 0, first_word and last_word null, labels empty. Rows that repeat another
    stay. No rows: no rows. Other columns are not read. A very long text is hashed in segments of about 1 MB; its meetings, which
    are few but in texts made of license words, are grouped in one task. Rows are numbered once, in a checkpoint.
    """
    spark = docs.sparkSession
    ship(spark)
    known: dict[int, list[str]] = {}
    for k, gram, *_ in gram_rows(phrases, templates):
        known.setdefault(k, []).append(gram)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = checkpoint(d.mapInArrow(find_grams(known), "rid long, doc_id long, n_words long, hits array<struct<k:int,at:int,gram:string>>"))
    one = cut.where(F.size("hits") > 0).select("rid", "doc_id", "n_words", F.explode("hits").alias("g")).select("rid", "doc_id", "n_words", "g.*")
    met = one.join(F.broadcast(template_grams(spark, phrases, templates)), ["k", "gram"])
    shift = F.when(F.col("base"), F.array(F.lit(0))).otherwise(F.array(*[F.lit(j) for j in range(drift + 1)]))
    met = met.select("rid", "doc_id", "n_words", "template", "label", "base", "n_grams", "at", (-F.col("place")).alias("back"), F.explode(shift).alias("shift"))
    met = met.withColumn("diagonal", F.col("at") + F.col("back") - F.col("shift")).repartition("rid")  # the one shuffle; all below groups within a document
    spans = met.groupBy("rid", "doc_id", "n_words", "template", "label", "base", "n_grams", "diagonal").agg(F.array_sort(F.collect_list(F.struct("at", "back"))).alias("votes"))
    spans = spans.withColumn("share", in_order(F.col("votes")) / F.col("n_grams"))
    found = F.col("share") >= F.when(F.col("base"), 1.0).otherwise(least)
    whole = F.col("base") & found
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("rid", "doc_id", "n_words").agg(
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).cast("long").alias("last_word"),
        text(F.when(whole, F.col("label"))).alias("base_labels"),
        text(F.when(found, F.col("label"))).alias("labels"),
        F.max("share").alias("score"),
    ).drop("rid")
    none = F.lit(None).cast("long")
    rest = cut.where(F.size("hits") == 0).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return out.unionByName(rest)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    grams = ",\n".join(f"({k}, '{g}', {t}, '{label}', {base}, {p}, {n})" for k, g, t, label, base, p, n in gram_rows(PHRASES, TEMPLATES))
    return rf"""
WITH g(k, gram, template, label, base, place, n_grams) AS (VALUES {grams}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
x AS (SELECT rid, k, i, array_to_string(w[i + 1 : i + k], ' ') AS gram FROM (SELECT rid, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (VALUES (2), (4)) v(k) WHERE len(w) >= k)),
m AS (SELECT rid, template, label, base, n_grams, place, i, i - place - shift AS diagonal FROM x JOIN g USING (k, gram), (VALUES (0), (1), (2), (3)) v(shift) WHERE shift = 0 OR NOT base),
v AS (SELECT rid, label, base, n_grams, diagonal, list([place]::INT[] ORDER BY i, place DESC) AS places FROM m GROUP BY rid, template, label, base, n_grams, diagonal),
s AS (SELECT rid, label, base, diagonal, len(list_reduce(list_prepend([]::INT[], places), lambda a, p: list_filter(a, lambda e: e < p[1]) || p || a[len(list_filter(a, lambda e: e < p[1])) + 2 :])) / n_grams::DOUBLE AS share FROM v),
r AS (SELECT rid, count(*) FILTER (base AND share >= 1) AS n_base, min(diagonal) FILTER (base AND share >= 1) AS first_word, max(diagonal) FILTER (base AND share >= 1) AS last_word,
  list_sort(list(DISTINCT label) FILTER (base AND share >= 1)) AS base_labels, list_sort(list(DISTINCT label) FILTER (share >= CASE WHEN base THEN 1 ELSE 0.7 END)) AS labels, max(share) AS score FROM s GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (rid)
"""


OP5_SQL = _sql()
