"""Data sources over a function that fetches pages: catalogs, searches, long polls. The function is given by the caller, so no address or key is part of this library."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tessera.shipping import ship

Fetch = Callable[[dict, int | str], Iterable[tuple]]


def paged_source(name: str, schema: str, fetch: Fetch, pages: int | Callable[[dict], Sequence[str]] = 1) -> type[DataSource]:
    """A source whose page k, of ``pages``, is a partition with the rows of fetch(options, k). fetch runs on executors and must be picklable.

    Where pages have addresses and not numbers, pages(options) lists them, and fetch gets one in place of k.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self) -> Sequence[InputPartition]:
            return [InputPartition(k) for k in (pages(self.options) if callable(pages) else range(int(self.options.get("pages", pages))))]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetch(self.options, partition.value)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(dict(self.options))

    return Paged


def polled_source(name: str, schema: str, poll: Callable[[dict, int], tuple[list[tuple], int]]) -> type[DataSource]:
    """A stream source: poll(options, cursor) gives rows and the next cursor, which the checkpoint keeps."""

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = options

        def initialOffset(self) -> dict:
            return {"cursor": int(self.options.get("cursor", 0))}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, cursor = poll(self.options, start["cursor"])
            return iter(rows), {"cursor": cursor}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            at = start["cursor"]
            while at < end["cursor"]:
                rows, at = poll(self.options, at)
                yield from rows

        def commit(self, end: dict) -> None:
            pass

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return Reader(dict(self.options))

    return Polled


def read(spark: SparkSession, source: type[DataSource], **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()


def read_stream(spark: SparkSession, source: type[DataSource], **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(**options).load()


def embedded(df: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[tuple[int, list[float]]]], batch: int = 64) -> DataFrame:
    """(key, embedding) by a function that takes up to ``batch`` texts and gives (index, vector) pairs in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors = [v for _, v in sorted(embed([t or "" for t in part.column(1).to_pylist()]), key=lambda x: x[0])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])

    ship(df.sparkSession)
    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, embedding array<float>")


def rows_of(document: str, path: Sequence[str]) -> list:
    """The list at a path of a JSON document; empty where it is missing."""
    at = json.loads(document)
    for p in path:
        at = at.get(p) if isinstance(at, dict) else None
    return at if isinstance(at, list) else []
