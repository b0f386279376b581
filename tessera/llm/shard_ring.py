"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import HASH_BITS, checkpoint, md5_hash, prefix_sums, table


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in ascending order, and the shard of each. A shard's places do not depend on how many shards there are."""
    at = {}
    for s in range(shards):
        for v in range(vnodes):
            at[int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[: HASH_BITS // 4], 16)] = s
    places = np.array(sorted(at), dtype=np.int64)
    return places, np.array([at[int(p)] for p in places], dtype=np.int64)


def flows(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, last rank + 1, shard): where the keys of each arc go.

    Arcs are served clockwise. An arc's keys go to its node's shard while that has room, then on to the shards of the
    next nodes clockwise. There are at most as many pieces as arcs plus shards that fill up.
    """
    left, out = capacity.copy(), []
    for a in range(len(counts)):
        rank, n, k = 0, int(counts[a]), a
        while n > 0:
            s = owner[k % len(owner)]
            if take := min(n, int(left[s])):
                out.append((a, rank, rank + take, int(s)))
                left[s] -= take
                rank, n = rank + take, n - take
            k += 1
    return out


def ring_shards(docs: DataFrame, shards: int = 24, vnodes: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    doc_id's hash places a row on the ring. Shards take at most floor or ceil of rows / shards (the first few take one
    more), so counts are at most one apart: the law is ``rows``; rows that find a shard full continue clockwise. What
    the driver sees are counts by arc, shards x vnodes numbers. Within an arc, rows rank by hash, then doc_id, then
    content, through sums over small hash buckets.

    A null doc_id hashes as empty text. Null text has no bytes: size 8 and CRC 0. Rows that repeat another in full
    take different slots. No rows: no rows.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), md5_hash(F.col("doc_id")).alias("__h"))
    places, owner = ring(shards, vnodes)
    nodes = F.array(*[F.lit(int(p)) for p in places]) if len(places) <= 64 else None
    spark = docs.sparkSession
    if nodes is None:  # two levels, so that a row meets few places: the last place at or before a slice of the ring, then those in it
        bits = 12
        step = 1 << (HASH_BITS - bits)
        lists = spark.createDataFrame([(i, int(lo := np.searchsorted(places, i * step)), [int(p) for p in places[lo : np.searchsorted(places, (i + 1) * step)]]) for i in range(1 << bits)], "__slice long, __lo long, __at array<long>")
        d = d.join(F.broadcast(lists), F.shiftright("__h", HASH_BITS - bits) == lists["__slice"]).withColumn("__arc", (F.col("__lo") + F.size(F.filter("__at", lambda p: p < F.col("__h")))) % len(places)).drop("__slice", "__lo", "__at")
    else:
        d = d.withColumn("__arc", (F.size(F.filter(nodes, lambda p: p < F.col("__h"))) % len(places)).cast("long"))
    d = checkpoint(d.withColumn("__one", F.lit(1).cast("long")))
    counts = np.zeros(len(places), dtype=np.int64)
    for a, n in d.groupBy("__arc").count().collect():  # at most shards x vnodes rows
        counts[a] = n
    total = int(counts.sum())
    capacity = np.array([total * (s + 1) // shards - total * s // shards for s in range(shards)], dtype=np.int64)
    filled, parts = np.zeros(shards, dtype=np.int64), []
    for a, lo, hi, s in flows(counts, owner, capacity):
        parts.append((a, lo, hi, s, int(filled[s])))
        filled[s] += hi - lo
    where = spark.createDataFrame(parts, "__arc long, __from long, __to long, shard int, __base long")
    ranked = prefix_sums(d, "__arc", "__h", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "__one", "__rank", total)
    out = ranked.join(F.broadcast(where), "__arc").where("__rank >= __from and __rank < __to")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("__base") + F.col("__rank") - F.col("__from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(table(spark, sf_dir, "documents"))
