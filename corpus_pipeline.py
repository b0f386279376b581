"""A corpus pipeline: quality filter, exact and near deduplication, source mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, table
from tessera.llm.dedup_exact import exact_duplicates, normalised
from tessera.llm.mix import mixed_documents
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack, word_tokenizer
from tessera.llm.quality import good_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts (op2): score 0.3 or more, a tie at 0.3 included.

    Null and empty texts are scored as texts without words, very long ones whole; rows that repeat another are kept or
    not together. Without labels, or with one label only, all rows score alike. No rows: no rows.
    """
    return good_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (op10), that of the smallest doc_id. Of rows that repeat a doc_id and text one stays.

    Null texts count as empty and are one group; null doc_ids are largest. Very long texts are compared whole. No rows: no rows.
    """
    kept = exact_duplicates(docs).where("kept").select(F.coalesce("doc_id", F.lit(-1)).alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    d = docs.select(*COLUMNS).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("__sha", F.sha2(normalised(F.col("text")), 256))
    return d.join(kept, ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"]).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (op7), that of the smallest doc_id. Documents without a doc_id stay. Rows go by doc_id and text, as a doc_id may occur with texts of several classes.

    Null and empty texts, and texts without words, are near only to equal ones. Very long texts are compared whole. No rows: no rows.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).where("__id is not null").distinct()
    d = docs.select(*COLUMNS).withColumn("__id", F.col("doc_id").cast("long")).withColumn("__th", F.xxhash64("text"))
    return d.join(gone, ["__id", "__th"], "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources takes them (op1): some twice, some not, one of a source cut at its target.

    Null and wordless texts are never drawn; a null source is a source of its own. Rows that repeat another are drawn
    separately. Very long texts are drawn whole, but for the one that is cut. No rows: no rows.
    """
    return mixed_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens (op3).

    Null and empty texts are the end id alone; rows that repeat another are packed separately; very long texts are cut
    over sequences and partitions. No rows: no rows.
    """
    return pack(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learned scores and consistent sampling have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
