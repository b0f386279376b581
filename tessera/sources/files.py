"""Readers of folders, logs and documents. Each gives a DataFrame with a fixed schema, so nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id string, type string, ts double, text string, tool_name string, args_summary string, ref string, preview string, status string, size int, tags array<string>, tool_call_id string"
RUN = "date string, scope string, notes string, docs_scanned int, docs_fresh int, docs_possibly_stale int, docs_likely_stale int, style_errors_fixed int, style_warnings_remaining int, created_files array<string>, files_modified array<string>"
GRADING = "summary struct<pass_rate double, passed int, failed int, total int>, timing struct<total_duration_seconds double>, execution_metrics struct<total_tool_calls int, errors_encountered int, output_chars bigint>"


def whole_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, value): each file's whole text."""
    d = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), "value")


def front_matter(text: Column, *names: str) -> list[Column]:
    """Fields of a document's front matter, ``name: value`` lines between lines of three hyphens; null where missing."""
    head = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    field = lambda n: F.nullif(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{n}:[ \t]*(.*)$", 1), "^[\"']|[\"']\\s*$", ""), F.lit(""))
    return [F.trim(field(n)).alias(n) for n in names]


def skills(spark: SparkSession, path: str, full: bool = True) -> DataFrame:
    return skills_of(whole_files(spark, path, "SKILL.md"), full)


def skills_of(d: DataFrame, full: bool = True) -> DataFrame:
    """(name, description, content, folder) of every ``*/SKILL.md`` of (path, value), those without a name in their front matter left out; without ``full`` no content."""
    d = d.select(*front_matter(F.col("value"), "name", "description"), F.regexp_replace("value", r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "").alias("content"), F.regexp_extract("path", "([^/]+)/SKILL.md$", 1).alias("folder"))
    d = d.where("name is not null")
    return d if full else d.drop("content")


def attached(spark: SparkSession, path: str) -> DataFrame:
    return attached_of(whole_files(spark, path))


def attached_of(d: DataFrame) -> DataFrame:
    """(folder, kind, files): scripts (``scripts/*.py``) and references (``references/*.md, txt, rst``) of each skill, file name to text; blank references are dropped."""
    part = lambda k, n: F.regexp_extract("path", r"([^/]+)/(scripts|references)/([^/]+\.(?:py|md|txt|rst))$", k).alias(n)
    d = d.select(part(1, "folder"), part(2, "kind"), part(3, "file"), "value").where("kind <> ''")
    d = d.where("(kind = 'scripts' and file like '%.py') or (kind = 'references' and file not like '%.py' and trim(value) <> '')")
    return d.groupBy("folder", "kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "value")))).alias("files"))


def jsonl_events(spark: SparkSession, path: str, schema: str = EVENT, strict: bool = False) -> DataFrame:
    return events_of(whole_files(spark, path), schema, strict)


def events_of(d: DataFrame, schema: str = EVENT, strict: bool = False) -> DataFrame:
    """Events of JSON lines. Blank lines are skipped, as are lines that do not parse; with ``strict`` a file's rows after its first bad line are too."""
    lines = d.select("path", F.posexplode(F.split("value", "\n")).alias("line", "text")).where("trim(text) <> ''")
    d = lines.withColumn("event", F.from_json("text", schema)).withColumn("bad", F.try_parse_json("text").isNull())
    if strict:
        first = d.where("bad").groupBy("path").agg(F.min("line").alias("__stop"))
        d = d.join(first, "path", "left").where("__stop is null or line < __stop")
    return d.where("not bad").select("path", "line", "event.*")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    return runs_of(whole_files(spark, path, recursive=False)).drop("path")


def runs_of(d: DataFrame) -> DataFrame:
    """Runs of JSON documents (path, value) with a ``runs`` list, numbered from 1."""
    schema = f"runs array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in RUN.split(','))}>>"
    d = d.select("path", F.posexplode(F.from_json("value", schema)["runs"]).alias("k", "r"))
    return d.select("path", (F.col("k") + 1).alias("run"), "r.*")


def git_log(text: DataFrame, column: str = "value", record: str = "\x1e", field: str = "\x1f") -> DataFrame:
    """(hash, author, date, subject, body, files) of a log whose records and fields end in separators; the files are the lines of the last field."""
    d = text.select(F.explode(F.split(column, record)).alias("r")).where("trim(r) <> ''").select(F.split("r", field).alias("f"))
    at = lambda k, n: F.trim(F.coalesce(F.get("f", F.lit(k)), F.lit(""))).alias(n)
    files = F.filter(F.split(F.coalesce(F.get("f", F.lit(5)), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return d.select(F.regexp_replace(at(0, "hash"), r"^\s+", "").alias("hash"), at(1, "author"), at(2, "date"), at(3, "subject"), at(4, "body"), files.alias("files"))


def code_commits(commits: DataFrame, since: str, docs: Sequence[str] = ("docs/",)) -> DataFrame:
    """Commits since a date, without merges and without those that touch documents alone."""
    code = F.filter("files", lambda f: ~(F.exists(F.array(*[F.lit(p) for p in docs]), lambda p: f.startswith(p)) | f.endswith(".md")))
    d = commits.where((F.col("date") >= since) & ~F.col("subject").startswith("Merge ")).withColumn("files", code)
    return d.where(F.size("files") > 0)


#: Languages of source files by suffix.
LANGUAGES = {"py": "python", "cs": "csharp", "ts": "typescript", "tsx": "typescript", "js": "javascript", "go": "go", "java": "java", "rs": "rust"}


def source_tree(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    return sources_of(whole_files(spark, path), exclude)


def sources_of(d: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, language, value) of the source files of (path, value), but those whose path matches a pattern of ``exclude``."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    d = d.withColumn("language", F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix]).where("language is not null")
    for p in exclude:
        d = d.where(~F.col("path").rlike(p))
    return d.select("path", "language", "value")


def markdown_tree(spark: SparkSession, path: str) -> DataFrame:
    return markdown_of(whole_files(spark, path, "*.md"))


def markdown_of(d: DataFrame) -> DataFrame:
    """Markdown files of (path, value), at any depth, by their ending."""
    return d.where(F.col("path").endswith(".md")).select("path", "value")


def folder_tree(spark: SparkSession, path: str, depth: int = 3) -> DataFrame:
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    root = path.rstrip("/").rsplit("/", 1)[-1]
    return tree_of(d.select(F.regexp_extract("path", rf"/{root}/(.*)$", 1).alias("path"), "length"), depth).orderBy("folder", F.col("is_dir").desc(), F.lower("name"))


def tree_of(d: DataFrame, depth: int = 3) -> DataFrame:
    """(name, folder, is_dir, length) of files (path, length) up to a depth and of their folders."""
    d = d.select(F.split("path", "/").alias("p"), "length")
    files = d.where(F.size("p") <= depth).select(F.element_at("p", -1).alias("name"), F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/").alias("folder"), F.lit(False).alias("is_dir"), "length")
    ups = d.where(F.size("p") > 1).select(F.explode(F.sequence(F.lit(1), F.least(F.size("p") - 1, F.lit(depth)))).alias("k"), "p")
    dirs = ups.select(F.element_at("p", F.col("k")).alias("name"), F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), "/").alias("folder"), F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("length")).distinct()
    return dirs.unionByName(files)


def eval_runs(spark: SparkSession, path: str) -> DataFrame:
    return eval_runs_of(whole_files(spark, path, "grading.json"))


def eval_runs_of(d: DataFrame) -> DataFrame:
    """(eval_id, config, run_number, pass_rate, passed, failed, total, time_seconds, tool_calls, errors) of ``eval-*/<config>/run-*/grading.json``; files that do not parse are left out."""
    d = d.withColumn("g", F.from_json("value", GRADING)).where(F.try_parse_json("value").isNotNull())
    part = lambda k: F.regexp_extract("path", r"eval-(\d+)/(?:runs/)?([^/]+)/run-(\d+)/grading\.json$", k)
    return d.select(
        part(1).try_cast("int").alias("eval_id"), part(2).alias("config"), part(3).try_cast("int").alias("run_number"), *[F.coalesce(f"g.summary.{c}", F.lit(0)).alias(c) for c in ("pass_rate", "passed", "failed", "total")],
        F.coalesce("g.timing.total_duration_seconds", F.lit(0.0)).alias("time_seconds"), F.coalesce("g.execution_metrics.total_tool_calls", F.lit(0)).alias("tool_calls"), F.coalesce("g.execution_metrics.errors_encountered", F.lit(0)).alias("errors"),
    )


def log_files(spark: SparkSession, path: str, since: str) -> DataFrame:
    """(path, day, length): log files of a day or later, by the date in their name, else by when they were changed; newest first."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    day = F.coalesce(F.try_to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1), "yyyy-MM-dd"), F.to_date("modificationTime"))
    return d.select("path", day.alias("day"), "length").where(F.col("day") >= since).orderBy(F.col("day").desc(), "path")
