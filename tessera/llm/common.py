"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import math
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import shared_folder

#: Bits of the hashes that order rows.
HASH_BITS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for Python steps that cost far more than moving the rows. Tables of many files stay as they are. df should be a table or a checkpoint: to count the partitions of a plan with shuffles, Spark runs them."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def tidy(run):
    """A function of batches that, when it is done, gives back to the system what its process no longer uses: workers go on to other tasks, and several share an executor's memory."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return tidied


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in ``shared_folder``, so that later jobs neither repeat it nor depend on one executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Store:
    """Tables of an operator's steps, in a database of its own in ``shared_folder``: written once, read by column, dropped by name as soon as no step needs them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.kept = spark, f"{name}_{uuid.uuid4().hex}", {}
        where = f"{shared_folder(spark)}/{self.name}".replace("'", "\\'")
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{where}'")

    def keep(self, df: DataFrame) -> DataFrame:
        name = f"{self.name}.t{len(self.kept)}"
        df.write.saveAsTable(name, format="parquet")
        out = self.spark.table(name)
        self.kept[name] = out
        return out

    def drop(self, *frames: DataFrame) -> None:
        for name, df in self.kept.items():
            if df is not None and any(df is f for f in frames):
                self.spark.sql(f"DROP TABLE {name}")
                self.kept[name] = None

    def drop_others(self, *frames: DataFrame) -> None:
        self.drop(*(df for df in self.kept.values() if df is not None and not any(df is f for f in frames)))


def md5_hash(c: Column) -> Column:
    """60 bits of the MD5 of a column's text (null: of no text), which other engines compute alike."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def mixed_hash(*cols: Column | str) -> Column:
    """60 bits of xxhash64, not negative."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - HASH_BITS)


def row_hash(df: DataFrame) -> Column:
    """60 bits of a hash of all columns of df: rows of the same are taken to be equal in full. Maps, which have no hash, count by their JSON."""
    return mixed_hash(*(F.to_json(F.struct(f.name)) if re.search(r"map<|variant", f.dataType.simpleString()) else F.col(f"`{f.name}`") for f in df.schema.fields))


def broadcast_few(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """df hinted for broadcast if it has at most ``most`` rows, else left to the planner, which joins it by a shuffle."""
    return F.broadcast(df) if rows <= most else df


def prefix_sums(df: DataFrame, group: str, h: str, ties: list[Column], value: str, out: str, rows: int | None = None, per_bucket: int = 256) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``group`` that come before a row by (h, ties).

    ``h`` is a hash of HASH_BITS bits. Its leading bits cut each group into buckets of about ``per_bucket`` rows, and
    those into a square root as many ranges, so no window holds more than a bucket or a range of bucket totals, even
    where one group has most rows. ``rows`` is the row count, if known. df is read three times: checkpoint it first.
    """
    n = df.count() if rows is None else rows
    bits = max(0, math.ceil(math.log2(max(1, n / per_bucket))))
    high = bits // 2
    b = F.shiftright(F.col(h), HASH_BITS - bits) if bits else F.lit(0).cast("long")
    d = df.withColumn("__b", b)
    sums = d.groupBy(group, "__b").agg(F.sum(value).alias("__s")).withColumn("__a", F.shiftright("__b", bits - high))
    before = (Window.unboundedPreceding, -1)
    within = sums.withColumn("__in", F.coalesce(F.sum("__s").over(Window.partitionBy(group, "__a").orderBy("__b").rowsBetween(*before)), F.lit(0)))
    ranges = sums.groupBy(group, "__a").agg(F.sum("__s").alias("__t"))
    ranges = ranges.withColumn("__base", F.coalesce(F.sum("__t").over(Window.partitionBy(group).orderBy("__a").rowsBetween(*before)), F.lit(0))).drop("__t")
    offsets = within.join(ranges, [group, "__a"]).select(group, "__b", (F.col("__in") + F.col("__base")).alias("__off"))
    w = Window.partitionBy(group, "__b").orderBy(h, *ties).rowsBetween(*before)
    d = d.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    return d.join(offsets.hint("merge"), [group, "__b"]).withColumn(out, F.col(out) + F.col("__off")).drop("__b", "__off")


def hot_keys(df: DataFrame, key: str, share: int = 200) -> list:
    """Values of ``key`` with over 1/share of df's rows: fewer than ``share``, however large df is."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    n = counts.agg(F.sum("__n")).first()[0] or 0
    return [r[0] for r in counts.where((F.col("__n") > n / share) & (F.col("__n") > 100)).select(key).collect()]


def hot_join(df: DataFrame, other: DataFrame, key: str, how: str = "inner", share: int = 200, hot: list | None = None) -> DataFrame:
    """df joined with ``other`` (one row a key) without sending a frequent key's rows to one task.

    The rest is hinted to merge: the sizes that the planner assumes after explode() are too low for it to choose a broadcast.

    Keys that hold over 1/share of df's rows, fewer than ``share`` of them, meet a broadcast of their rows of
    ``other``; the rest are shuffled. how: inner, left or left_semi. df is read three times: checkpoint it first. hot: those
    keys, if known from an earlier join.
    """
    hot = hot_keys(df, key, share) if hot is None else hot
    if not hot:
        return df.join(other.hint("merge"), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    a = df.where(is_hot).join(F.broadcast(other.where(F.col(key).isin(hot))), key, how)
    return a.unionByName(df.where(~is_hot).join(other.hint("merge"), key, how))
