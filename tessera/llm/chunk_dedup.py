"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, spread, table
from tessera.shipping import ship

#: Number of bytes that a boundary depends on.
REACH = 16
GEAR = np.random.default_rng(29).integers(0, 1 << 32, size=256, dtype=np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash at every byte, of that byte and the REACH - 1 before it: h = 2 h + GEAR[byte], summed over doubled spans at once."""
    h = GEAR[raw]
    span = 1
    while span < REACH:
        moved = h[:-span] << np.uint32(span) if span < len(h) else h[:0]
        h = h.copy()
        h[span:] += moved
        span *= 2
    return h


def boundaries(raw: np.ndarray, least: int = 16, bits: int = 5, most: int = 128) -> list[int]:
    """Ends of the chunks of a text: after bytes whose hash has ``bits`` leading zeros among its REACH low bits, at least ``least`` and at most ``most`` bytes apart."""
    n = len(raw)
    if not n:
        return []
    at = np.flatnonzero((gear(raw) & np.uint32(((1 << bits) - 1) << (REACH - bits))) == 0) + 1
    ends, last = [], 0
    for c in at.tolist():
        if c - last >= least:
            while c - last > most:
                last += most
                ends.append(last)
            if c - last >= least or c == n:
                ends.append(c)
                last = c
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _chunks(step: int = 100_000):
    """(rid, doc_id, first, starts, ends, digests, more, fresh) with one list entry for each chunk: a digest of 96 bits in two parts; fresh: its first time in this text. A very long text gives several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        digest = xxhash.xxh3_128_intdigest
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                ends = boundaries(np.frombuffer(raw, dtype=np.uint8))
                starts = [0, *ends[:-1]]
                whole = [digest(raw[s:e]) for s, e in zip(starts, ends)]
                digests, more = [(d >> 64) - (1 << 63) for d in whole], [(d & 0xFFFFFFFF) - (1 << 31) for d in whole]
                if len(set(whole)) == len(whole):
                    fresh = [True] * len(whole)
                else:
                    seen: set[int] = set()
                    fresh = [d not in seen and not seen.add(d) for d in whole]
                for k in range(0, len(ends), step):
                    for c, v in zip(cols, (rid, doc_id, k, starts[k : k + step], ends[k : k + step], digests[k : k + step], more[k : k + step], fresh[k : k + step])):
                        c.append(v)
                rid += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["rid", "doc_id", "first", "starts", "ends", "digests", "more", "fresh"])

    return run


def repeated_spans(docs: DataFrame, least_bytes: int = 100, gap: int = 0) -> DataFrame:
    """Spans of text that repeat in other rows: doc_id, start, length (bytes of the UTF-8 text), n_chunks, n_docs, keep_id, keep.

    Texts are cut where a gear hash of the last bytes says, so an insertion moves only the chunks beside it. A chunk
    whose digest of 96 bits occurs in two rows or more is repeated (two of 10**12 different chunks agree with probability 1e-5); chunks side by side form a span, over ``gap`` unrepeated
    chunks at most, and spans of ``least_bytes`` or more are returned. What the cuts lose at either end is about a
    chunk, so a passage of 50 words gives a span, and a common line does not. n_docs is the smallest number of rows of
    any chunk of the span; keep_id is the smallest doc_id that has a chunk of it, and keep says that this row has the
    smallest doc_id of every chunk of it, so that its copy stays.

    Null and empty texts have no chunks. Rows that repeat another repeat it in full; a row with a null doc_id takes
    part and is kept only if no row with one has the chunk. No rows: no rows. Other columns are not read. A very long text is cut whole; its
    chunks go on in rows of 100,000. A chunk that a third of all rows hold is
    summed before the shuffle and meets its rows by broadcast.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = checkpoint(spread(d).mapInArrow(_chunks(), "rid long, doc_id long, first int, starts array<int>, ends array<int>, digests array<long>, more array<int>, fresh array<boolean>"))
    key = ["digest", "more"]
    found = cut.select("doc_id", F.explode(F.arrays_zip("digests", "more", "fresh")).alias("c")).select("doc_id", F.col("c.digests").alias("digest"), F.col("c.more").alias("more"), F.col("c.fresh").cast("int").alias("fresh"))
    again = found.groupBy(*key).agg(F.sum("fresh").alias("n_docs"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep_id"))
    again = checkpoint(again.where("n_docs > 1"))
    total = cut.agg(F.sum(F.size("digests"))).first()[0] or 0
    hot = again.where(F.col("n") > total / 200)  # fewer than 200 rows
    names = [r.digest for r in hot.select("digest").collect()]
    each = cut.select("rid", "doc_id", "first", F.posexplode(F.arrays_zip("starts", "ends", "digests", "more")).alias("k", "c"))
    each = each.select("rid", "doc_id", (F.col("first") + F.col("k")).alias("k"), F.col("c.starts").alias("start"), F.col("c.ends").alias("end"), F.col("c.digests").alias("digest"), F.col("c.more").alias("more"))
    if names:
        is_hot = F.col("digest").isin(names)
        met = each.where(is_hot).join(F.broadcast(again.where(is_hot)), key).unionByName(each.where(~is_hot).join(again.where(~is_hot).hint("merge"), key))
    else:
        met = each.join(again.hint("merge"), key)
    order = Window.partitionBy("rid").orderBy("k")
    apart = F.coalesce((F.col("k") - F.lag("k").over(order) > 1 + gap).cast("int"), F.lit(1))
    spans = met.withColumn("span", F.sum(apart).over(order)).groupBy("rid", "doc_id", "span").agg(
        F.min("start").alias("start"),
        (F.max("end") - F.min("start")).alias("length"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.min("n_docs").alias("n_docs"),
        F.min("keep_id").alias("keep_id"),
        F.min(F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("keep"),
    )
    return spans.where(F.col("length") >= least_bytes).select("doc_id", "start", "length", "n_chunks", "n_docs", "keep_id", "keep")


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
