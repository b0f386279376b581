"""Exact deduplication by sorting contents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_few, checkpoint, table, tidy
from tessera.shipping import ship

#: Runs of the bytes that normalisation turns into one space.
SPACES = "[\\x20\\x09-\\x0D]+"

_RUNS = "doc_id long, text_sha256 string, run_min long, run_size long, is_first boolean, part int, run long, edge boolean"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one sorted partition. Held in memory: one batch, one text and the identifiers of one run."""
    part = TaskContext.get().partitionId()
    text, sha, ids, run = None, "", [], -1
    cols: list[list] = [[] for _ in range(8)]
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("run_min", pa.int64()), ("run_size", pa.int64()), ("is_first", pa.bool_()), ("part", pa.int32()), ("run", pa.int64()), ("edge", pa.bool_())])

    def close(last: bool) -> None:
        n, low = len(ids), ids[0]  # the smallest first, nulls last
        for c, v in zip(cols, (ids, [sha] * n, [low] * n, [n] * n, [True] + [False] * (n - 1), [part] * n, [run] * n, [last or run == 0] * n)):
            c.extend(v)

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        for c in cols:
            c.clear()
        return out

    for b in batches:
        for t, s, i in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if t != text or run < 0:
                if run >= 0:
                    close(False)
                text, sha, ids, run = t, s, [], run + 1
            ids.append(i)
        if len(cols[0]) > 10_000:
            yield batch()
    if run >= 0:
        close(True)
        yield batch()


def exact_duplicates(docs: DataFrame, partitions: int | None = None, prefix: int = 16) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are range-partitioned at sampled splitters of (first ``prefix`` characters, half the digest, doc_id) of the normalised
    text, sorted outside memory by these and the text, and each is compared in full with its neighbour. A splitter has about 60 bytes,
    however long texts are; whole texts as splitters would send a sample of them to the driver. As doc_id belongs to the splitters, a
    group of copies of any size spreads over partitions; what is left to settle are each partition's first and last
    run, two small rows a partition, which are summed and broadcast, or joined by a shuffle beyond 100,000 of them.

    Null text counts as empty; a text of white space only is one space, other than empty. Of equal texts the smallest
    doc_id stays, null only where all are null; of rows that repeat a doc_id and text one stays. No rows: no rows.
    Other columns are not read. Of very long texts a task holds two at a time and one batch of rows.
    """
    ship(docs.sparkSession)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    t = t.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("prefix", F.substring("text", 1, prefix)).withColumn("half", F.substring("sha", 1, 16))
    t = t.repartitionByRange(n, F.col("prefix"), F.col("half"), F.col("doc_id").asc_nulls_last())
    t = t.sortWithinPartitions("prefix", "half", "text", F.col("doc_id").asc_nulls_last()).select("text", F.lower(F.hex("sha")).alias("sha"), "doc_id")
    runs = checkpoint(t.mapInArrow(tidy(_runs), _RUNS))
    edges = runs.where("edge and is_first").groupBy("text_sha256").agg(F.min("run_min").alias("__min"), F.sum("run_size").alias("__size"))
    out = runs.join(broadcast_few(edges, 2 * n), "text_sha256", "left")  # at most two rows a partition
    keep, size = (F.when(F.col("edge"), F.col(a)).otherwise(F.col(b)) for a, b in (("__min", "run_min"), ("__size", "run_size")))
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), (F.col("is_first") & F.col("run_min").eqNullSafe(keep)).alias("kept"), "text_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
