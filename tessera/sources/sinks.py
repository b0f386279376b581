"""Sinks: appended JSON lines, artifacts beside previews, reports, daily folders and tables, cursors."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.sessions import folded


def append_json(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)


def stream_json(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends a stream's rows as JSON lines; the checkpoint keeps its place, so a restart neither loses nor repeats rows."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)


def write_folded(df: DataFrame, text: str, main: str, artifacts: str, chars: int = 4000, lines: int = 120) -> None:
    """Writes rows with previews in place of long texts, and the long texts beside them."""
    short, long = folded(df, text, chars, lines)
    short.write.mode("overwrite").parquet(main)
    long.write.mode("overwrite").parquet(artifacts)


def write_daily(df: DataFrame, day: str, path: str) -> None:
    """Writes rows into a folder for each day, which readers prune by. Each day's rows go to a few tasks, so folders get few files."""
    df.repartition(day, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("append").partitionBy(day).parquet(path)


def log_daily(df: DataFrame, day: str, table: str, path: str, keep: int | None = None) -> None:
    """Appends rows to a table with a partition for each day and, with ``keep``, drops all but the last ``keep`` days."""
    df.repartition(day, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("append").partitionBy(day).option("path", path).saveAsTable(table)
    if keep is not None:
        retain(df.sparkSession, table, day, keep)


def retain(spark: SparkSession, table: str, day: str, keep: int) -> int:
    """Drops the partitions of all but the last ``keep`` days of a table, without reading a row, and says how many. The driver sees the names of the days."""
    days = sorted(r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect())
    old = days[: max(0, len(days) - keep)]
    for d in old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({day} = '{d}')")
    return len(old)


class Cursors:
    """Cursors of accounts, each a file that is replaced as a whole: a reader sees the old one or the new one, also after a crash.

    For drivers that poll outside a stream; streams keep theirs in their checkpoint.
    """

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _file(self, account: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(account.encode()).hexdigest() + ".json")

    def save(self, account: str, cursor: str) -> None:
        with tempfile.NamedTemporaryFile("w", dir=self.folder, suffix=".tmp", delete=False, encoding="utf-8") as f:
            try:
                json.dump({"account": account, "cursor": cursor}, f)
                f.flush()
                os.fsync(f.fileno())
                os.replace(f.name, self._file(account))
            except BaseException:
                os.unlink(f.name)
                raise

    def load(self, account: str, default: str = "") -> str:
        """The account's cursor; default where there is none or its file is no cursor of it."""
        try:
            with open(self._file(account), encoding="utf-8") as f:
                found = json.load(f)
            return found["cursor"] if found.get("account") == account else default
        except (FileNotFoundError, ValueError, KeyError, AttributeError):
            return default

    def forget(self, account: str) -> None:
        if os.path.exists(self._file(account)):
            os.unlink(self._file(account))


def json_report(df: DataFrame) -> DataFrame:
    """(json): each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def markdown_report(df: DataFrame, head: bool = False) -> DataFrame:
    """(line): a Markdown table of rows, each a line; with ``head`` the lines of ``markdown_head`` before them."""
    rows = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("line"))
    return df.sparkSession.createDataFrame([(x,) for x in markdown_head(df)], "line string").unionByName(rows) if head else rows


def markdown_head(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]


#: Report formats by name; callers may add theirs.
REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {"json": json_report, "markdown": markdown_report}


def report(df: DataFrame, format: str) -> DataFrame:
    return REPORTS[format](df)
