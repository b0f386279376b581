"""Evaluation statistics, integrity checks, configuration merges and routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sessions import ordered


def stats(rows: DataFrame, config: Column, value: str, digits: int = 4) -> DataFrame:
    """Mean, sample deviation (0 for one row), least and largest value of each configuration."""
    r = lambda c, n: F.round(c, digits).alias(n)
    return rows.groupBy(config).agg(r(F.avg(value), "mean"), r(F.coalesce(F.stddev_samp(value), F.lit(0.0)), "stddev"), r(F.min(value), "min"), r(F.max(value), "max"))


def trigger_rate(runs: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """(key, rate, runs, triggers, pass): what should trigger passes at the threshold or above, the rest below it. runs: key, should, triggered."""
    g = runs.groupBy(key).agg(F.avg(F.col("triggered").cast("double")).alias("rate"), F.count(F.lit(1)).alias("runs"), F.sum(F.col("triggered").cast("long")).alias("triggers"), F.bool_or("should").alias("should"))
    return g.withColumn("pass", F.when(F.col("should"), F.col("rate") >= threshold).otherwise(F.col("rate") < threshold)).drop("should")


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of agreement of ``predicted`` with ``actual``; precision and recall are 1 and accuracy 0 of nothing."""
    a, p = F.col("actual"), F.col("predicted")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    c = rows.agg(n(a & p).alias("tp"), n(~a & p).alias("fp"), n(~a & ~p).alias("tn"), n(a & ~p).alias("fn"))
    ratio = lambda x, y, none: F.when(y > 0, x / y).otherwise(F.lit(none))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select("*", ratio(tp, tp + fp, 1.0).alias("precision"), ratio(tp, tp + fn, 1.0).alias("recall"), ratio(tp + tn, tp + fp + tn + fn, 0.0).alias("accuracy"))


def split(rows: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds held: whole part of ``share`` of each label's rows, one at least, in a seeded hash order. Labels are few, so ranks come from hash buckets of each label, not from one sort of it."""
    buckets = 1024
    h = F.xxhash64(F.col(key), F.lit(seed))
    d = rows.withColumns({"__h": h, "__b": F.pmod(h, F.lit(buckets))})
    sizes = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(label).orderBy("__b")
    sizes = sizes.select(label, "__b", (F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(label)).alias("__all"))
    d = d.withColumn("__rn", F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))).join(sizes, [label, "__b"])
    held = F.col("__rn") + F.col("__before") <= F.greatest(F.lit(1), F.floor(F.col("__all") * share))
    return d.withColumn("held", held).drop("__h", "__b", "__rn", "__before", "__all")


def scorecard(runs: DataFrame, rules: Mapping[str, Column], order: str, value: str) -> DataFrame:
    """(rule, runs, utilization, last_value): runs that a rule claims, their share of all, and the value of the last of them. One pass: rules become rows only where they hold."""
    n = runs.agg(F.count(F.lit(1)).alias("n"))
    hits = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    d = runs.select(F.explode(hits).alias("rule"), F.col(order).alias("o"), F.col(value).alias("v"))
    g = d.groupBy("rule").agg(F.count(F.lit(1)).alias("runs"), F.max_by("v", "o").alias("last_value"))
    return g.crossJoin(F.broadcast(n)).select("rule", "runs", (F.col("runs") / F.col("n")).alias("utilization"), "last_value")


def dangling(a: DataFrame, b: DataFrame, key: str, only_a: str, only_b: str) -> DataFrame:
    """(kind, key): keys that one side alone has."""
    tag = lambda d, k: d.select(F.lit(k).alias("kind"), key)
    return tag(a.join(b, key, "left_anti"), only_a).unionByName(tag(b.join(a, key, "left_anti"), only_b))


def manifest_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, reason): added, missing or updated entries of new against old."""
    a = old.select(key, F.struct(*columns).alias("__a"))
    b = new.select(key, F.struct(*columns).alias("__b"))
    d = a.join(b, key, "full_outer")
    reason = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "missing").when(~F.col("__a").eqNullSafe(F.col("__b")), "updated")
    return d.select(key, reason.alias("reason")).where("reason is not null")


def overlapping(boxes: DataFrame, page: str, key: str) -> DataFrame:
    """(page, i, j): pairs of boxes of a page that overlap in more than an edge. boxes: page, key, x0, y0, x1, y1. Pages bound the pairs."""
    a = boxes.select(page, F.col(key).alias("i"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = boxes.select(page, F.col(key).alias("j"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    hit = (F.col("i") < F.col("j")) & (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    return a.join(b, page).where(hit).select(page, "i", "j")


def first_places(rows: DataFrame, token: Column, place: str, most: int) -> DataFrame:
    """(token, n, first): how often a token occurs, and its first places in order. Only ``most`` places of each are gathered."""
    d = rows.select(token, F.col(place).alias("p"))
    name = d.columns[0]
    counts = d.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    low = d.withColumn("rn", F.row_number().over(Window.partitionBy(name).orderBy("p"))).where(F.col("rn") <= most)
    return counts.join(low.groupBy(name).agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("first")), name)


def alignment(files: DataFrame, db: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, state): what is missing in, or an orphan of, the database or the vector table against the files."""
    flags = [d.select(key, *[F.lit(k == j).alias(n) for j, n in enumerate(("__f", "__d", "__v"))]) for k, d in enumerate((files, db, vectors))]
    g = flags[0].unionByName(flags[1]).unionByName(flags[2]).groupBy(key).agg(*[F.bool_or(c).alias(c) for c in ("__f", "__d", "__v")])
    f, d, v = (F.col(c) for c in ("__f", "__d", "__v"))
    state = F.when(f & ~d, "missing_in_db").when(f & ~v, "missing_in_vector").when(d & ~f, "orphan_in_db").when(v & ~f, "orphan_in_vector").otherwise("aligned")
    return g.select(key, state.alias("state"))


def allowed(tools: DataFrame, name: str, wanted: Sequence[str] | None, virtual: str) -> DataFrame:
    """The wanted tools that there are, all of them if none is wanted or known, and the virtual one. tools has a row a tool."""
    spark = tools.sparkSession
    some = tools.where(F.col(name).isin(list(wanted or [])))
    picked = some if wanted and not some.isEmpty() else tools
    return picked.select(name).unionByName(spark.createDataFrame([(virtual,)], f"{name} string"))


def route(calls: DataFrame, tool: str, workers: DataFrame, worker: str, can: str) -> DataFrame:
    """(tool, worker): the workers that can run each tool; all of them for a tool that none can. calls may repeat tools; few or many workers join alike, as sizes decide."""
    able = workers.select(worker, F.explode(can).alias(tool)).distinct()
    tools = calls.select(tool).distinct()
    per_tool = tools.join(able.select(tool).distinct().withColumn("__some", F.lit(True)), tool, "left")
    wanted = per_tool.select(tool, F.when(F.col("__some"), F.col(tool)).alias("__tool"))  # null: any worker
    every = workers.select(worker).distinct().withColumn("__tool", F.lit(None).cast(dict(calls.dtypes)[tool]))
    offers = able.select(worker, F.col(tool).alias("__tool")).unionByName(every)
    return wanted.join(offers, wanted["__tool"].eqNullSafe(offers["__tool"])).select(tool, worker)


#: Endings of files that are results in their own right.
CORE_ENDINGS = [".pptx", ".docx", ".xlsx", ".pdf", ".py", ".js", ".ts", ".java", ".go", ".rs", ".html", ".css", ".md", ".json", ".yaml", ".yml", ".csv", ".db", ".sqlite"]


def locked_artifacts(files: DataFrame, run: str, order: Sequence[str], path: str, preferred: str | None = None) -> DataFrame:
    """Adds accepted and existing: whether a run may make a file, and the file to edit instead.

    The first file of each ending of CORE_ENDINGS is the run's core file of that ending. A later one is refused if its
    name is the same without versions and the like; with ``preferred``, once that ending has its core file, so is the
    first file of any other. Paths that came before and other endings are accepted.
    """
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    ending = F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"[_-]?(v\d+|final|draft|copy|backup|new|old)[_-]?", ""), r"(?<=.)\.[^.]*$", "")
    core = ending.isin(CORE_ENDINGS)
    d = files.withColumns({"__e": ending, "__s": stem, "__core": core, "__again": F.row_number().over(ordered([run, path], *order)) > 1})
    if preferred:  # others wait from the preferred ending's first file on
        seen = F.max((F.col("__e") == preferred).cast("int")).over(ordered(run, *order).rowsBetween(Window.unboundedPreceding, -1))
        chosen = F.first(F.when(F.col("__e") == preferred, F.col(path)), ignorenulls=True).over(ordered(run, *order).rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("__barred", F.col("__core") & (F.col("__e") != preferred) & (F.coalesce(seen, F.lit(0)) == 1)).withColumn("__chosen", chosen)
    else:
        d = d.withColumn("__barred", F.lit(False)).withColumn("__chosen", F.lit(None).cast("string"))
    first = ordered([run, "__e"], *order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("__core") & ~F.col("__barred"), F.struct(F.col(path).alias("p"), F.col("__s").alias("s")))
    d = d.withColumn("__first", F.first(own, ignorenulls=True).over(first))
    similar = F.col("__core") & (F.col("__first.p") != F.col(path)) & (F.col("__first.s") == F.col("__s"))
    existing = F.when(F.col("__again"), F.lit(None)).when(F.col("__barred"), F.col("__chosen")).when(similar, F.col("__first.p"))
    d = d.withColumn("existing", existing).withColumn("accepted", F.col("existing").isNull())
    return d.drop("__e", "__s", "__core", "__again", "__barred", "__chosen", "__first")


def version_drift(sites: DataFrame, canonical: str) -> DataFrame:
    """Adds found, what each site's own pattern finds in its text, and whether it is the canonical version."""
    d = sites.withColumn("found", F.expr("regexp_extract(text, pattern, 1)")).drop("text", "pattern")
    return d.withColumn("in_sync", F.col("found") == canonical)


def overlay(base: DataFrame, user: DataFrame) -> DataFrame:
    """(path, value, change): user's values over the base's; what only the base has stays."""
    d = base.withColumnRenamed("value", "a").join(user.withColumnRenamed("value", "b"), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "kept").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return d.select("path", F.coalesce("b", "a").alias("value"), change.alias("change"))


def merge_managed(template: DataFrame, user: DataFrame, managed: Sequence[str]) -> DataFrame:
    """(path, value): under managed prefixes the user's values alone, elsewhere the template's paths with the user's values if there are any."""
    own = F.lit(False)
    for p in managed:
        own = own | F.col("path").startswith(p)
    d = template.where(~own).join(user.withColumnRenamed("value", "b"), "path", "left").select("path", F.coalesce("b", "value").alias("value"))
    return d.unionByName(user.where(own).select("path", "value"))


def json_in(text: Column, path: str) -> Column:
    """A value of the JSON object in a text: in a fenced block, the whole text, or between the outer braces."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.get_json_object(F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))), path)


def repaired_json(text: Column) -> Column:
    """A JSON object from what begins at the first brace: as it stands, closed, without trailing commas, or with double quotes; null if none parses."""
    t = F.nullif(F.regexp_extract(text, r"(?s)(\{.*)$", 1), F.lit(""))
    tries = [t, F.concat(t, F.lit("}")), F.regexp_replace(t, r",\s*([}\]])", "$1"), F.translate(t, "'", '"')]
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in tries])


#: Packages of modules with other names, by the module's name in lower case; none of the standard library's.
ALIASES = {
    "pptx": "python-pptx", "docx": "python-docx", "xlsx": "openpyxl", "sklearn": "scikit-learn", "yaml": "PyYAML", "dotenv": "python-dotenv", "cv2": "opencv-python", "pil": "Pillow",
    "bs4": "beautifulsoup4", "dateutil": "python-dateutil", "crypto": "pycryptodome", "jwt": "PyJWT", "sqlite3": "",
}


def dependency_alias(spec: Column) -> Column:
    """The package of a module, with the version or extras that stand after it; empty for blank text and modules of the standard library."""
    t = F.trim(spec)
    base = F.trim(F.regexp_replace(t, r"[\[=<>!~].*$", ""))
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[F.lower(base)]
    other = F.when(known == "", "").otherwise(F.concat(known, F.substring(t, F.length(base) + 1, F.length(t) + 1)))
    return F.when(base == "", "").when(known.isNull() | (known == base), t).otherwise(other)


def dependency(raw: Column) -> Column:
    """(kind, name, spec) of a dependency: ``cli:``, ``pip:`` or ``py:`` before it, ffmpeg a command, else Python; kind none for what needs no installation."""
    t = F.trim(raw)
    cli = F.lower(t).startswith("cli:")
    spec = F.when(cli, F.trim(F.regexp_replace(t, "^[^:]*:", ""))).otherwise(dependency_alias(F.regexp_replace(t, "(?i)^(pip|py):", "")))
    name = F.when(cli, spec).otherwise(F.trim(F.regexp_replace(spec, r"[\[=<>!~].*$", "")))
    kind = F.when(name == "", "none").when(cli | (F.lower(t) == "ffmpeg"), "cli").otherwise("python")
    return F.struct(kind.alias("kind"), name.alias("name"), spec.alias("spec"))
