"""URL filter: rules first, then trust and distrust that spread over the links between hosts. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, hot_join, hot_keys, table

#: (verdict, rule). A rule is a host and a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ?, # or the end, A-Z in lower case; path: then up to ?, # or the end. Both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: the url's host is the rule's or under it, and its path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


_ABSOLUTE = "(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]+)"
_SCHEME = "(?i)^[a-z][a-z0-9+.-]*:"
_HREF = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?([^\"'\\s>]+)"
_BASE = "(?i)<base\\s[^>]*?href\\s*=\\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^\"'\\s>/?#]+)"
#: A query parameter that sends the reader on to a url of another host.
_ONWARD = "(?i)[?&](?:url|u|to|target|dest|redirect)=[a-z]+(?::|%3a)(?://|%2f%2f)([^/?#&%]+)"


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how often hosts link to each other and to themselves. pages has host and html.

    - A page's hrefs, resolved against its <base> or its own host; a redirecting parameter of a link counts as a second link.
    - Each page once for its own host.
    - Domains: each page links its host to the host's parent domain, that to its parent, and so on to the domain of two
      labels; each domain links once to each host or domain right under it. Hosts of digits alone have no domain.
    """
    lower = lambda c: F.translate(c, _UPPER, _LOWER)
    p = pages.where("host <> ''").select("host", F.coalesce("html", F.lit("")).alias("html"))
    base = F.regexp_extract("html", _BASE, 1)
    p = p.select("host", F.when(base != "", lower(base)).otherwise(F.col("host")).alias("base"), F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)).alias("hrefs"))
    h = p.select("host", "base", F.explode("hrefs").alias("href"))
    to, on = F.regexp_extract("href", _ABSOLUTE, 1), F.regexp_extract("href", _ONWARD, 1)
    dst = F.when(to != "", lower(to)).when(~F.col("href").rlike(_SCHEME), F.col("base"))
    found = h.select(F.col("host").alias("src"), F.explode(F.array(dst, F.when(on != "", lower(on)))).alias("dst")).where("dst is not null")
    sites = p.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    labels = F.split("host", "\\.")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size("labels") - 1, F.lit(1))), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    up = sites.where(~F.col("host").rlike("^[0-9.:]*$")).select("n", labels.alias("labels")).select("n", chain.alias("chain"))
    up = up.select("n", F.explode(F.arrays_zip(F.expr("slice(chain, 1, size(chain) - 1)").alias("a"), F.expr("slice(chain, 2, size(chain))").alias("b"))).alias("x"))
    up = up.groupBy(F.col("x.a").alias("src"), F.col("x.b").alias("dst")).agg(F.sum("n").alias("n"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("n"))
    own = sites.select(F.col("host").alias("src"), F.col("host").alias("dst"), "n")
    links = found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).unionByName(own).unionByName(up).unionByName(down)
    return links.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, steps: int, damping: float, every: int = 4, few: int = 100_000) -> DataFrame:
    """(host, trust, distrust) after ``steps`` steps of two personalised PageRanks.

    Trust flows from trusted seeds along links, distrust from blocked seeds against them: a host that links to blocked
    hosts is distrusted. Both run as one table of (kind, host), so a step is one join and one sum. Ranks are in units of
    a seed: a host that no other gives anything has its seed as rank. A host's own links take their share of what it
    passes on, and a walk ends there, so hosts do not pile up what they give to themselves. What is left out are walks of more than
    ``steps`` links between hosts, at most damping ** steps of all seeds. Up to ``few`` links are broadcast, more are shuffled. seeds: host, trusted,
    blocked (0 to 1). links: src, dst, n; own links included.
    """
    kinds = F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.lit("d").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"))))
    e = links.select("n", kinds.alias("e")).select(F.concat("e.kind", F.lit(" "), "e.a").alias("node"), F.concat("e.kind", F.lit(" "), "e.b").alias("to"), "n")
    e = checkpoint(e)
    hot = hot_keys(e, "node")
    out = e.groupBy("node").agg(F.sum("n").alias("total"))
    e = checkpoint(hot_join(e.where("node <> to"), out, "node", hot=hot).select("node", "to", (F.col("n") / F.col("total") * damping).alias("weight")))
    seed = F.explode(F.array(F.struct(F.concat(F.lit("t "), "host").alias("node"), F.col("trusted").alias("rank")), F.struct(F.concat(F.lit("d "), "host").alias("node"), F.col("blocked").alias("rank"))))
    s = checkpoint(seeds.select(seed.alias("s")).select("s.node", "s.rank").where("rank > 0"))
    rank, small = s, e.count() <= few
    for k in range(steps):
        passed = rank.join(F.broadcast(e), "node") if small else hot_join(e, rank, "node", hot=hot)
        flow = passed.select(F.col("to").alias("node"), (F.col("rank") * F.col("weight")).alias("rank"))
        rank = flow.unionByName(s).groupBy("node").agg(F.sum("rank").alias("rank"))
        rank = checkpoint(rank) if k % every == every - 1 else rank
    kind, host = F.substring("node", 1, 1), F.expr("substring(node, 3)")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0))
    return rank.select(kind.alias("kind"), host.alias("host"), "rank").groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, steps: int = 12, damping: float = 0.8, margin: float = 0.2, **options) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, trust, distrust.

    A url that a rule fits has the rule's verdict. Of the others, those of a host whose distrust exceeds its trust by
    more than ``margin`` are blocked, the rest allowed. A host's seed of trust (distrust) is the share of its pages that
    rules allow (block). Trust and distrust then spread over the links of the pages and between hosts and their domains
    (``host_edges``, ``spread``).

    Null urls, and urls without ``://``, have empty host and path, fit no rule and are allowed; such rows are no host.
    Null and empty html has no links; a very long one is read whole, a row's links at a time. Rows that repeat another stay. No rows: no
    rows. Other columns are not read. A distrust at ``margin`` above trust is allowed. A host with many pages or links meets
    broadcasts of at most 200 hosts' rows, so no task gets all its rows.
    """
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = checkpoint(p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("__verdict")))
    share = lambda v: F.avg((F.coalesce(F.col("__verdict"), F.lit("")) == v).cast("double"))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    scores = spread(host_edges(p), seeds, steps, damping, **options)
    out = hot_join(judged, scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust - trust > margin, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("__verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_verdicts(table(spark, sf_dir, "pages"))
    return out.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})


def _rule_sql() -> tuple[str, str]:
    """CASE expressions of the longest rule that fits, and of its verdict."""
    cases = []
    for what, r in sorted(RULES, key=lambda x: (-len(x[1]), x[1])):
        h, _, p = r.partition("/")
        cases.append((f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN ", r, what))
    return tuple(f"CASE {' '.join(f"{c[0]}'{c[k]}'" for c in cases)} END" for k in (1, 2))


def _steps_sql(steps: int) -> str:
    return ",\n".join(f"r{k} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT * FROM r0 UNION ALL SELECT e.kind, e.b, rank * e.weight FROM r{k - 1} r JOIN e ON e.kind = r.kind AND e.a = r.host) GROUP BY ALL)" for k in range(1, steps + 1))


_Q = [x.replace("'", "''") for x in (_ABSOLUTE, _SCHEME, _HREF, _BASE, _ONWARD)]
_LOW = f"'{_UPPER}', '{_LOWER}'"
OP4_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(html, '') AS html, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), {_LOW}) AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, {_rule_sql()[0]} AS rule, {_rule_sql()[1]} AS own FROM p),
h AS (SELECT host, coalesce(nullif(translate(regexp_extract(html, '{_Q[3]}', 1), {_LOW}), ''), host) AS base, unnest(regexp_extract_all(html, '{_Q[2]}', 1)) AS href FROM p WHERE host <> ''),
sites AS (SELECT host, count(*) AS n FROM p WHERE host <> '' GROUP BY host),
c AS (SELECT n, host, split(host, '.') AS w, unnest(range(1, len(split(host, '.')) - 1)) AS i FROM sites WHERE NOT regexp_matches(host, '^[0-9.:]*$')),
up AS (SELECT array_to_string(w[i:], '.') AS src, array_to_string(w[i + 1:], '.') AS dst, sum(n) AS n FROM c GROUP BY ALL),
l AS (SELECT src, dst, sum(n) AS n FROM (
  SELECT host AS src, CASE WHEN regexp_extract(href, '{_Q[0]}', 1) <> '' THEN translate(regexp_extract(href, '{_Q[0]}', 1), {_LOW}) WHEN NOT regexp_matches(href, '{_Q[1]}') THEN base END AS dst, 1 AS n FROM h
  UNION ALL SELECT host, nullif(translate(regexp_extract(href, '{_Q[4]}', 1), {_LOW}), ''), 1 FROM h
  UNION ALL SELECT host, host, n FROM sites UNION ALL SELECT src, dst, n FROM up UNION ALL SELECT dst, src, 1 FROM up) WHERE dst IS NOT NULL GROUP BY ALL),
k AS (SELECT 't' AS kind, src AS a, dst AS b, n FROM l UNION ALL SELECT 'd', dst, src, n FROM l),
e AS MATERIALIZED (SELECT * FROM (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) * 0.8::DOUBLE AS weight FROM k) WHERE a <> b),
s AS (SELECT host, avg((own = 'allow' AND own IS NOT NULL)::INT) AS t, avg((own = 'block' AND own IS NOT NULL)::INT) AS d FROM j WHERE host <> '' GROUP BY host),
r0 AS MATERIALIZED (SELECT 't' AS kind, host, t AS rank FROM s WHERE t > 0 UNION ALL SELECT 'd', host, d FROM s WHERE d > 0),
{_steps_sql(12)},
f AS (SELECT host, coalesce(sum(rank) FILTER (kind = 't'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'd'), 0) AS distrust FROM r12 GROUP BY host)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > 0.2 THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM j LEFT JOIN f USING (host)
"""
