"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import HASH_BITS, broadcast_few, checkpoint, md5_hash, mixed_hash, prefix_sums, row_hash, table
from tessera.shipping import ship

WORD = "[^\\x20\\x09-\\x0D]+"


class Mix(NamedTuple):
    docs: DataFrame  # a row for each document: doc_id, th (a hash of all columns), size, source_size, target, gi, at (its place in its source)
    pieces: DataFrame  # a row for each draw of a document: doc_id, th, size, gi, at, epoch, taken, shard, mix_order (its place in the shard)


def words_in(text: Column) -> Column:
    """Number of runs of bytes other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets_of(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Shares of budget in proportion to weights, none above ``most`` times its size; excess is shared again among the rest."""
    out, active = [0.0] * len(sizes), set(range(len(sizes)))
    pool = budget
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if pool * weights[i] / total > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = pool * weights[i] / total
            break
        for i in sorted(over):
            out[i] = float(most * sizes[i])
            active.remove(i)
        pool = budget - sum(out)
    return out


def _rng(*key: int) -> np.random.Generator:
    return np.random.default_rng([abs(k) for k in key])


def hypergeometric(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among n draws without replacement. Above numpy's bound of 10**9, counts are halved at random and both halves are drawn."""
    if counts.sum() < 10**9:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    half = counts // 2
    total, m = int(counts.sum()), int(half.sum())
    k = max(n - (total - m), min(m, n, round(n * m / total)))
    return hypergeometric(rng, half, k) + hypergeometric(rng, counts - half, n - k)


def leaf(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first draw, draws) of each source for one output shard: the path from the root of the splitting tree to that leaf.

    Each node splits its blocks of all sources between the shards left and right of its middle by a multivariate
    hypergeometric draw seeded by the node, so tasks agree on every node without exchanging anything, and the leaves
    add up to the quotas exactly.
    """
    total = int(quotas.sum())
    lo, hi, counts, first = 0, shards, quotas.astype(np.int64), np.zeros(len(quotas), dtype=np.int64)
    room = lambda a, b: total * b // shards - total * a // shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = hypergeometric(_rng(seed, lo, hi), counts, room(lo, mid))
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, counts, first = mid, counts - left, first + left
    return first, counts


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of x under a permutation of range(n): four Feistel rounds, walked along until they fall below n."""
    if n <= 1:
        return x
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _rng(key, n).integers(1, 1 << 62, size=4, dtype=np.uint64) | np.uint64(1)
    y, todo = x.astype(np.uint64), np.ones(len(x), dtype=bool)
    while todo.any():
        v = y[todo]
        a, b = v >> half, v & mask
        for k in keys:
            f = (b + np.uint64(1)) * k
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(33)) & mask)
        y[todo] = (a << half) | b
        todo = y >= n
    return y.astype(np.int64)


def draw_numbers(block_counts: Sequence[int], epochs: Sequence[int], seed: int):
    """Adds to (gi, epoch, block, words, first_at) each block's draw: its place in a permutation of its source's blocks, epoch after epoch; h: draws in order, spread over 60 bits."""
    n, e = np.array(block_counts, dtype=np.int64), np.array(epochs, dtype=np.int64)
    step = (1 << HASH_BITS) // np.maximum(1, n * e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gi, epoch, block = (b.column(k).to_numpy() for k in range(3))
            draw = np.empty(len(gi), dtype=np.int64)
            for g, k in np.unique(np.stack([gi, epoch], axis=1), axis=0).tolist():
                at = (gi == g) & (epoch == k)
                draw[at] = k * n[g] + permuted(block[at], int(n[g]), seed + 1 + g * 64 + k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(draw), pa.array(draw * step[gi])], names=["gi", "epoch", "block", "words", "first_at", "draw", "h"])

    return run


def deal(spark: SparkSession, quotas: Sequence[int], shard_blocks: int, seed: int) -> DataFrame:
    """(gi, draw, shard): the draws of every source's quota, dealt to shards. Each task walks down the tree for its own shards."""
    q = np.array(quotas, dtype=np.int64)
    shards = max(1, -(-int(q.sum()) // shard_blocks))
    schema = pa.schema([("gi", pa.int32()), ("draw", pa.int64()), ("shard", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                first, n = leaf(q, shards, s, seed)
                got = [(np.full(n[g], g, dtype=np.int32), np.arange(first[g], first[g] + n[g])) for g in np.flatnonzero(n)]
                if got:
                    gi, draw = (np.concatenate(x) for x in zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(gi), pa.array(draw), pa.array(np.full(len(gi), s, dtype=np.int64))], schema=schema)

    return spark.range(shards).mapInArrow(run, "gi int, draw long, shard long")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shard_blocks: int = 64, seed: int = 11, block: int | None = None) -> Mix:
    """Draws from the sources of docs until each has its target of words, and deals the draws to shuffled output shards.

    Sources in order of code points, null last, have ``weights`` in turn and share ``share`` times all words; a target
    stops at ``most`` times its source's words. A source's documents stand in the order of a hash of doc_id, cut into
    blocks by where documents start. Its blocks are drawn in the order of a permutation, once through all of them and
    again in another order, until the words drawn reach the target: that is the source's exact quota of draws. The
    last document drawn is cut at the target's word, so each source gives its rounded target exactly. The splitting
    tree deals each source's quota to shards, which get disjoint runs of its draws and order their documents by hash;
    a block is taken only by the shard that the tree gives it to. The driver and tasks see a few numbers for each source.

    Null or wordless text: size 0 and never drawn. A null source is a source of its own, last. Null doc_ids hash as
    empty text. Rows that repeat another in full are drawn separately; of rows that agree in doc_id the order is that of
    a hash of all columns. No rows, or no words: nothing is drawn. Very long texts are counted whole; one may fill
    several blocks, which then stand empty.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), md5_hash(F.col("doc_id")).alias("h"), row_hash(docs).alias("th")
    )
    d = checkpoint(d)
    stats = d.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()  # a row a source
    stats.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.words for r in stats]
    budget = share * sum(sizes)
    targets = targets_of(sizes, [weights[i % len(weights)] for i in range(len(sizes))], budget, most)
    want = [min(int(most * z), round(t)) for z, t in zip(sizes, targets)]
    block = block or max(2048, min(1 << 22, sum(want) >> 20))  # words
    epochs = [-(-w // z) if z else 0 for w, z in zip(want, sizes)]
    info = spark.createDataFrame(
        [(i, r.source is None, r.source or "", r.words, t, w, e) for i, (r, t, w, e) in enumerate(zip(stats, targets, want, epochs))], "gi int, __null boolean, __source string, source_size long, target double, want long, epochs int"
    )
    d = d.withColumn("__null", F.col("source").isNull()).withColumn("__source", F.coalesce("source", F.lit("")))
    d = d.join(broadcast_few(info, len(stats)), ["__null", "__source"]).drop("__null", "__source", "source")
    d = checkpoint(prefix_sums(d, "gi", "h", [F.col("doc_id"), F.col("th"), F.col("size")], "size", "at", sum(r.rows for r in stats)))
    places = d.where("size > 0 and epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).withColumn("block", F.floor(F.col("at") / block).cast("long"))
    blocks = places.groupBy("gi", "epoch", "block").agg(F.sum("size").alias("words"), F.min("at").alias("first_at"))
    counts = [-(-z // block) for z in sizes]
    blocks = checkpoint(blocks.mapInArrow(draw_numbers(counts, epochs, seed), "gi int, epoch int, block long, words long, first_at long, draw long, h long"))
    n_blocks = sum(c * e for c, e in zip(counts, epochs))
    drawn = prefix_sums(blocks, "gi", "h", [F.col("draw")], "words", "before", n_blocks)
    drawn = checkpoint(drawn.join(broadcast_few(info.select("gi", "want"), len(stats)), "gi").where("before < want").select("gi", "epoch", "block", "first_at", "draw", "before"))
    quotas = dict(drawn.groupBy("gi").agg(F.max("draw") + 1).collect())  # a row a source
    dealt = deal(spark, [quotas.get(i, 0) for i in range(len(stats))], shard_blocks, seed).hint("merge")  # a row a draw: the planner would count a row a shard and broadcast it
    pieces = places.join(drawn.join(dealt, ["gi", "draw"]).drop("draw"), ["gi", "epoch", "block"])
    pieces = pieces.withColumn("v", F.col("before") + F.col("at") - F.col("first_at")).where("v < want").withColumn("taken", F.least("size", F.col("want") - F.col("v")))
    pieces = pieces.withColumn("mix_order", mixed_hash(F.lit(seed), "gi", "v"))
    keep = ["doc_id", "th", "size", "gi", "at", "epoch", "taken", "shard", "mix_order"]
    return Mix(d, pieces.select(*keep))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each draw, in the columns of docs, by shard in mixed order.

    A document that is cut keeps its first words with their white space; n_chars, if docs has it, is counted again.
    A draw is joined to its row by doc_id and a hash of all columns, so rows that share a doc_id or a text keep their
    own sources; rows equal in all columns give a row for each draw of any of them. Null texts are never drawn. No rows: no rows.
    """
    key = lambda c: F.coalesce(c.cast("long"), F.lit(-1))
    p = mix(docs, **options).pieces
    p = p.select(key(F.col("doc_id")).alias("__id"), F.col("th").alias("__th"), F.col("taken").alias("__taken"), F.col("size").alias("__size"), F.col("shard").alias("__shard"), F.col("mix_order").alias("__order"))
    d = docs.withColumn("__id", key(F.col("doc_id"))).withColumn("__th", row_hash(docs)).dropDuplicates(["__id", "__th"])
    d = d.join(p, ["__id", "__th"])
    words = F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0))
    d = d.withColumn("text", F.when(F.col("__taken") < F.col("__size"), F.array_join(F.slice(words, F.lit(1), F.col("__taken").cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.repartition("__shard").sortWithinPartitions("__shard", "__order").select(*docs.columns)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, draws, and shard and mix_order of its first draw (null without one)."""
    m = mix(table(spark, sf_dir, "documents"))
    first = F.min_by(F.struct("shard", "mix_order"), "epoch")
    taken = m.pieces.groupBy("gi", "at").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).cast("int").alias("draws"), first.alias("first"))
    drawn = m.docs.where("size > 0").join(taken, ["gi", "at"], "left")  # with words, (gi, at) is a row's own
    rest = m.docs.where("size = 0").select("*", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("draws"), F.lit(None).cast("struct<shard:long,mix_order:long>").alias("first"))
    cols = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("draws", F.lit(0)).alias("draws"), "first.shard", "first.mix_order"]
    return drawn.select(*cols).unionByName(rest.select(*cols))
