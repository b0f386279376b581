"""Column functions over text. Each takes and gives columns, so Spark compiles them with the query around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tokenizing drops.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "have", "he", "in", "is", "it", "its", "of", "on", "or",
    "that", "the", "this", "to", "was", "were", "will", "with",
    "you", "your",
]
#: BM25's saturation and length normalisation, the rank constant of fusion, and weights of fields.
BM25_K1, BM25_B, RRF_K = 1.2, 0.75, 60
FIELD_WEIGHTS = {"name": 4, "description": 2, "body": 1}
MIN_TOKEN_LENGTH = 2


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, of two characters or more, without stopwords. Compatibility forms (NFKC) are taken as they stand."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[^\W_]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= MIN_TOKEN_LENGTH) & ~w.isin(STOPWORDS))


def idf(n: Column, df: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5)))


def bm25_term(idf_: Column, tf: Column, length: Column, average: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def rrf(*ranks: Column, k: int = RRF_K) -> Column:
    """Sum of 1 / (k + rank) over the ranks that are not null."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.lit(1.0) / (F.lit(k) + r), F.lit(0.0)) for r in ranks])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def count_of(text: Column, keep: str) -> Column:
    """Number of characters that are in a regex class, given as what stands between the brackets."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def token_estimate(text: Column) -> Column:
    """Whole part of ASCII / 3.5 + CJK * 1.8 + others / 1.5 characters; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    ascii_, cjk = count_of(t, r"\x00-\x7F"), count_of(t, r"\u4e00-\u9fff\u3000-\u303f")
    return (ascii_ / 3.5 + cjk * F.lit(1.8).cast("double") + (F.length(t) - ascii_ - cjk) / 1.5).cast("long")


def must_fold(text: Column, chars: int = 4000, lines: int = 120) -> Column:
    """Longer than ``chars`` characters or than ``lines`` lines."""
    return (F.length(text) > chars) | (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1 > lines)


def preview(text: Column, lines: int = 5, chars: int = 500) -> Column:
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n"), 1, chars)


def truncated(text: Column, chars: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(mark))).otherwise(text)


def normalized_name(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "- ", "__")


def safe_id(raw: Column, default: str = "default", most: int = 128) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(raw, "[^a-zA-Z0-9_-]", "_"), 1, most), F.lit("")), F.lit(default))


def short_hash(text: Column, n: int = 8) -> Column:
    return F.substring(F.md5(text), 1, n)


def fingerprint(text: Column, chars: int = 200) -> Column:
    """16 digits of the MD5 of the first ``chars`` CJK characters, letters a-z and digits of a text in lower case."""
    return short_hash(F.substring(F.regexp_replace(F.lower(text), r"[^\u4e00-\u9fa5a-zA-Z0-9]", ""), 1, chars), 16)


def normalized_error(text: Column, quotes: bool = True) -> Column:
    """An error's text with line numbers, paths, quoted values (unless ``quotes`` is False) and numbers replaced by marks."""
    out = F.regexp_replace(F.lower(text), r"line\s+\d+", "line <n>")
    out = F.regexp_replace(out, "/[^\\s:\"']+", "<path>")
    if quotes:
        out = F.regexp_replace(F.regexp_replace(out, "'[^']+'", "'<var>'"), '"[^"]+"', '"<str>"')
    out = F.regexp_replace(F.regexp_replace(out, r"\b\d+\b", "<n>"), r"\s+", " ")
    return F.trim(out) if quotes else out


def error_fingerprint(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.substring(F.sha1(normalized_error(text)), 1, 16))


def action_signature(tool: Column, arguments: Column) -> Column:
    """SHA-1 of the tool and its arguments as they stand; ``events.signed`` brings JSON objects to one form before."""
    return F.sha1(F.concat(tool, F.lit("|"), arguments))


#: Words by which an answer concludes.
CONCLUSIONS = ["综上", "总结", "结论", "final", "in summary", "overall", "完成", "done"]


def concludes(text: Column) -> Column:
    return either([F.lower(F.coalesce(text, F.lit(""))).contains(w) for w in CONCLUSIONS])


def task_signal(
    category: Column, *, repeated: Column, success: Column, files: Column, dependencies: Column, error_changed: Column, concluding: Column, new_urls: Column, new_entities: Column, has_entities: Column, error: Column
) -> Column:
    """none, weak, medium or strong: what a step of a task has brought. files and dependencies: how many were made or installed; error: its text."""
    found = has_entities & (F.coalesce(error, F.lit("")) == "")
    weak = F.when(found, "weak").otherwise("none")
    seen = F.when(new_urls >= 2, "strong").when((new_urls >= 1) | (new_entities >= 2), "medium").otherwise(weak)
    useful = F.when(files > 0, "strong").when((dependencies > 0) | error_changed | concluding, "medium").when(category == "observation", seen).otherwise(weak)
    return F.when(repeated | ~success, "none").otherwise(useful)


def step_output(raw: Column, most: int = 500) -> Column:
    """What a step hands on: the first of output, summary and result of a JSON object that is not empty, else the text; cut."""
    of = lambda k: F.nullif(F.get_json_object(raw, f"$.{k}"), F.lit(""))
    named = F.when(F.ltrim(raw).startswith("{") & F.try_parse_json(raw).isNotNull(), F.coalesce(of("output"), of("summary"), of("result")))
    return F.substring(F.coalesce(named, raw), 1, most)


def slim_result(content: Column, most: int = 300, historical: bool = False) -> Column:
    """A tool's result in short: its status and summary, a line for each of its first ten results, or the text cut after ``most`` characters."""
    kind = "ok boolean, skill_name string, summary string, results array<struct<tool: string, error: string, result: string>>"
    o = F.when(F.ltrim(content).startswith("{") & F.try_parse_json(content).isNotNull(), F.from_json(content, kind))
    status = F.when(o["ok"], "OK").when(~o["ok"], "FAIL").otherwise("?")
    single = F.concat(F.lit("[tool: "), F.coalesce(o["skill_name"], F.lit("unknown")), F.lit("] "), status, F.lit(" — "), F.coalesce(o["summary"], F.lit("")))
    err = lambda r: F.coalesce(r["error"], F.lit(""))
    line = lambda r: F.concat(F.lit("  - "), F.coalesce(r["tool"], F.lit("unknown")), F.when(err(r) != "", F.concat(F.lit(": FAIL — "), F.substring(err(r), 1, 80))).otherwise(F.concat(F.lit(": OK — "), F.substring(F.coalesce(r["result"], F.lit("")), 1, 80))))
    batch = F.concat(F.lit("[batch results]\n"), F.array_join(F.transform(F.slice(o["results"], 1, 10), line), "\n"))
    out = F.when(o["skill_name"].isNotNull() | o["summary"].isNotNull(), single).when(F.size(o["results"]) > 0, batch).otherwise(truncated(content, most, "...[truncated]"))
    return F.concat(F.lit("[historical] "), out) if historical else out


def backoff(attempt: Column, base: float = 0.5, most: float = 30.0) -> Column:
    """Seconds to wait after ``attempt`` failures (from 0): base doubled each time, ``most`` at the longest."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


#: Fixed values: (error type, category, retryable, patterns), tried in this order.
ERROR_RULES = [
    ("timeout", "timeout", True, [r"\btimeout\b", "timed out", "deadline exceeded", "operation timed out", "read timed out"]),
    ("permission_denied", "permission", False, ["permission denied", "operation not permitted", "access denied", "eacces", "eprem", "authorization failed"]),
    ("tool_not_found", "tool_not_found", False, ["command not found", "not found", "no such file or directory", "unknown command", "executable file not found"]),
    ("dependency_error", "dependency", False, ["module not found", "modulenotfounderror", "cannot import name", "importerror", "no matching distribution found", "failed building wheel", "unsatisfied requirement"]),
    ("resource_missing", "resource_missing", False, ["file not found", "no such file", "does not exist", "cannot find", "not a directory"]),
    ("input_invalid", "input_invalid", False, ["invalid argument", "unrecognized arguments?", "bad request", "invalid request", "validation error", "json decode error", "expecting value"]),
    ("unavailable", "service_unavailable", True, ["service unavailable", "temporarily unavailable", "connection refused", "network is unreachable", "name or service not known", "dns", "502 bad gateway", "503", "429", "rate limit", "too many requests"]),
    ("environment_error", "environment", False, ["environment variable", "keyerror", "api[_ ]?key", "missing credentials", "not configured"]),
]


def error_class(text: Column) -> Column:
    """(type, category, retryable) of a tool's output by the first rule that matches; null for blank text."""
    t = F.trim(F.lower(text))
    t = F.when(t.startswith("err:") | t.startswith("error:"), F.trim(F.regexp_replace(t, "^[^:]*:", ""))).otherwise(t)
    out = lambda a, b, c: F.struct(F.lit(a).alias("type"), F.lit(b).alias("category"), F.lit(c).alias("retryable"))
    case = F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, F.lit(None))
    for kind, category, retry, patterns in ERROR_RULES:
        case = case.when(t.rlike("|".join(patterns)), out(kind, category, retry))
    return case.when(t.startswith("exit code:"), out("execution_error", "exit_code", False)).otherwise(out("execution_error", "execution", False))


#: What to do about each type of error.
RECOVERY = {
    "input_required": "prompt_user", "input_invalid": "auto_fix", "resource_missing": "auto_fix", "dependency_error": "auto_fix", "permission_denied": "prompt_user", "timeout": "retry",
    "environment_error": "prompt_user", "unavailable": "retry", "execution_error": "auto_fix", "tool_not_found": "auto_fix", "path_validation_failed": "auto_fix", "policy_blocked": "abort", "internal_error": "abort",
}


def recovery_action(kind: Column, category: Column, retryable: Column) -> Column:
    """What to do about an error of a type; null for an unknown type."""
    base = F.create_map(*[F.lit(x) for kv in RECOVERY.items() for x in kv])[kind]
    base = F.when(retryable & base.isin("auto_fix", "prompt_user"), "retry").otherwise(base)
    fixed = category.isin("input_invalid", "resource_missing", "dependency", "tool_not_found") & (base != "abort")
    return F.when(base.isNull(), F.lit(None)).when(category.isin("permission", "environment"), "prompt_user").when(fixed, "auto_fix").otherwise(base)


def execution_state(text: Column) -> Column:
    """failed, succeeded or unknown, by a JSON object's ``success`` or by how the text begins."""
    flag = F.get_json_object(text, "$.success")
    t = F.trim(F.lower(text))
    starts = lambda *p: either([t.startswith(x) for x in p])
    return F.when(flag == "false", "failed").when(flag == "true", "succeeded").when(starts("err:", "error:", "exit code:"), "failed").when(starts("stdout:", "success:"), "succeeded").otherwise("unknown")


def looks_error(text: Column) -> Column:
    """Blank, begins like an error, or a JSON object with ok = false."""
    begins = text.rlike(r"(?i)^\s*(error|traceback|exception|fatal)")
    return text.isNull() | (F.trim(text) == "") | begins | F.coalesce(F.get_json_object(text, "$.ok") == "false", F.lit(False))


def urls(text: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit("https?://[^\\s\\]\\)\"']+"), F.lit(0))), 1, most)


#: Fixed values: (pattern, most) of what counts as an entity.
ENTITIES = [("https?://[^\\s\\]\\)\"'>]+", 5), (r"[\u4e00-\u9fa5]{2,}诉[\u4e00-\u9fa5]{2,}案", 3), (r"[\u4e00-\u9fa5]{2,}(?:公司|集团|企业)", 5), ("202[0-5]", 3)]


def entities(text: Column) -> Column:
    return F.array_distinct(F.concat(*[F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(0)), 1, n) for p, n in ENTITIES]))


def significant_words(text: Column) -> Column:
    """Distinct runs of two or more CJK characters and of three or more letters a-z, as they stand."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"[\u4e00-\u9fa5]{2,}"), F.lit(0)), F.regexp_extract_all(text, F.lit("[a-zA-Z]{3,}"), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 if either is empty or null."""
    empty = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def script_class(text: Column, script: str = "Latin", target: float = 0.95, other: float = 0.2) -> Column:
    """target, non_target, mixed, empty or unknown, by the share of letters in a script."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    ratio = F.length(F.regexp_replace(F.regexp_replace(text, r"\P{L}+", ""), rf"\P{{Is{script}}}+", "")) / letters
    return F.when(F.coalesce(F.trim(F.regexp_replace(text, r"\s", "")), F.lit("")) == "", "empty").when(letters == 0, "unknown").when(ratio >= target, "target").when(ratio <= other, "non_target").otherwise("mixed")


#: Fixed value: a commit subject by its convention.
_COMMIT = r"(?i)^(feat|fix|docs|refactor|chore|test|style|perf|ci|build|revert)(?:\(([^)]+)\))?(!)?:\s*(.+)$"


def conventional_commit(subject: Column) -> Column:
    """(type, scope, breaking, description) of a commit's subject; uncategorized if it has no known prefix."""
    s = F.trim(subject)
    part = lambda k: F.regexp_extract(s, _COMMIT, k)
    known = s.rlike(_COMMIT)
    shout = F.upper(subject).contains("BREAKING CHANGE") | F.upper(subject).contains("BREAKING-CHANGE")
    return F.struct(
        F.when(known, F.lower(part(1))).otherwise("uncategorized").alias("type"),
        F.when(known, F.nullif(part(2), F.lit(""))).alias("scope"),
        F.when(known, part(3) == "!").otherwise(shout).alias("breaking"),
        F.when(known, F.trim(part(4))).otherwise(s).alias("description"),
    )


def priority(score: Column) -> Column:
    return F.when(score >= 0.66, "high").when(score >= 0.33, "medium").otherwise("low")


def freshness(doc_date: Column, code_date: Column, days: int = 30) -> Column:
    """fresh without related changes or if the document is as recent; possibly_stale up to ``days`` behind, else likely_stale."""
    return F.when(code_date.isNull() | (doc_date >= code_date), "fresh").when(F.datediff(code_date, doc_date) <= days, "possibly_stale").otherwise("likely_stale")


def path_overlaps(ref: Column, changed: Column) -> Column:
    """A directory reference (with a last /) holds the changed file, or a file reference is it or lies in the same directory."""
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    file = (ref == changed) | ((folder(ref) != "") & (folder(ref) == folder(changed)))
    return (ref != "") & (changed != "") & F.when(ref.endswith("/"), changed.startswith(ref)).otherwise(file)


def snake_case(name: Column) -> Column:
    """Any naming style in lower case with underscores; runs of capitals are one word."""
    out = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.translate(out, "-", "_"))


def kebab_case(name: Column) -> Column:
    return F.translate(snake_case(name), "_", "-")


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(F.split(snake_case(name), "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def camel_case(name: Column) -> Column:
    p = pascal_case(name)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))


def title_case(name: Column) -> Column:
    return F.initcap(F.translate(snake_case(name), "_", " "))


#: Parts of commands that are never run, and patterns of injected ones.
BLOCKED_PARTS = [
    "rm -rf /", "rm -rf /*", "mkfs", "dd if=", ":(){ :|:& };:", "format c:", "format d:", "rd /s /q c:\\", "rd /s /q \\",
    "sudo rm -rf", "chmod 777", "chmod -r 777", "> /dev/sda", "mv /* ", "rm -rf ~", "rm -rf $home", "shutdown", "reboot", "init 0", "init 6", "del /f /s /q", "rd /s /q", "reg delete", "bcdedit",
    "git push --force", "git push -f", "drop table", "drop database", "truncate table",
]
BLOCKED_PATTERNS = [r"\$\(curl\s", r"`curl\s", r"base64\s.*\|\s*sh", r"base64\s.*\|\s*bash", "eval\\s+[\"']", r"\|\s*sh\b", r"\|\s*bash\b", r"curl.*\|\s*(sh|bash)", r"wget.*\|\s*(sh|bash)", r"(?i)\\x[0-9a-f]{2}"]


def dangerous_command(command: Column) -> Column:
    return either([F.lower(command).contains(p) for p in BLOCKED_PARTS] + [command.rlike(p) for p in BLOCKED_PATTERNS])


#: Rewrites of Markdown to plain text before and after tables, in order.
MARKDOWN = [(r"```[^\n]*\n?\s*([\s\S]*?)\s*```", "$1"), ("`([^`]+)`", "$1"), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^\|[\s:|-]+\|$", "")]
MARKDOWN_AFTER = [
    (r"\*\*([^*]+)\*\*", "$1"), ("__([^_]+)__", "$1"), (r"\*([^*]+)\*", "$1"), ("_([^_]+)_", "$1"), ("~~([^~]+)~~", "$1"),
    (r"(?m)^#+\s*", ""), (r"(?m)^>\s*", ""), (r"(?m)^[\-*_]{3,}\s*$", ""), (r"\n{3,}", "\n\n"),
]


def plain_text(markdown: Column) -> Column:
    """Markdown without its marks; table rows become their cells."""
    out = markdown
    for p, r in MARKDOWN:
        out = F.regexp_replace(out, p, r)
    row = lambda x: F.array_join(F.transform(F.split(F.regexp_extract(x, r"^\|(.+)\|$", 1), r"\|"), lambda c: F.trim(c)), "  ")
    out = F.array_join(F.transform(F.split(out, "\n"), lambda x: F.when(x.rlike(r"^\|(.+)\|$"), row(x)).otherwise(x)), "\n")
    for p, r in MARKDOWN_AFTER:
        out = F.regexp_replace(out, p, r)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


#: Patterns of single leftovers.
CALL_LIST = r"(?s)\[TOOL_CALLS\]\s*\[.*?\]"
CALL_MARK = "(?s)✿FUNCTION✿.*?(?:✿RESULT✿|$)"
FUNCTION_TAG = r"</?function(?:=[a-zA-Z_]\w*)?>"
CALL_TAG = "</?tool_call>"
CALL_BRACKET = r"(?i)\[/?TOOL_CALLS?\]"
ANY_TAG = r"(?i)</?(?:\w+:)?(?:tool_calls?|function_calls?|function|invoke|parameters?|arg|execute_skill|skill_name)\b[^>]*>"
CONTROL_TOKEN = r"<\|[a-zA-Z_0-9\u2581]+\|>"
#: What models leave of tool calls and control tokens, in the order of removal.
LEFTOVERS = [
    r"(?s)<\|tool_calls_section_begin\|>.*?(?:<\|tool_calls_section_end\|>|$)",
    r"(?si)<(?:\w+:)?(?:tool_calls?|function_calls?|execute_skill)\b[^>]*>.*?(?:</(?:\w+:)?(?:tool_calls?|function_calls?|execute_skill)\s*>|$)",
    r"(?si)\[TOOL_CALLS?\].*?(?:\[/TOOL_CALLS?\]|$)",
    r'(?s)\{\s*"(?:name|tool|function|tool_name)"\s*:\s*"[^"]*"\s*,[^{}]*(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}[^{}]*)*\}',
    CALL_LIST,
    CALL_MARK,
    r"(?s)functions\.[a-zA-Z_]\w*:\d+\s*(?:<\|tool_call_argument_begin\|>)?\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}\s*(?:<\|tool_call_argument_end\|>)?",
    FUNCTION_TAG,
    CALL_TAG,
    CALL_BRACKET,
    ANY_TAG,
    CONTROL_TOKEN,
]
#: Signs of a tool call in text.
TOOL_CALL_SIGNS = [
    CONTROL_TOKEN, FUNCTION_TAG, CALL_TAG, CALL_BRACKET, ANY_TAG,
    r'\{\s*"(?:name|tool|function|tool_name)"\s*:\s*"[a-zA-Z_]\w*"\s*,\s*"(?:arguments|parameters|tool_input|input)"\s*:',
    r"functions\.[a-zA-Z_]\w*:\d+", CALL_LIST, CALL_MARK,
]


def sanitized(text: Column) -> Column:
    out = text
    for p in LEFTOVERS:
        out = F.regexp_replace(out, p, "")
    return out


def has_tool_call(text: Column) -> Column:
    return F.coalesce(either([text.rlike(p) for p in TOOL_CALL_SIGNS]), F.lit(False))


#: Fixed values: (extension, words that ask for it), tried in this order.
EXTENSIONS = [(".pptx", ["pptx", "ppt", "slides", "presentation"]), (".docx", ["docx", "word", "document"]), (".xlsx", ["xlsx", "excel", "spreadsheet"]), (".pdf", ["pdf"]), (".md", ["markdown", ".md", "readme"]), (".py", ["python", ".py", "script"])]


def preferred_extension(text: Column) -> Column:
    case = F.lit(None).cast("string")
    for ext, words in reversed(EXTENSIONS):
        case = F.when(either([F.lower(text).contains(w) for w in words]), ext).otherwise(case)
    return case


#: What each tool does.
OBSERVING = ["search_web", "fetch_webpage", "read_file", "list_dir", "grep"]
EFFECTING = ["file_create", "edit_file_by_lines", "bash", "python_repl"]


def tool_category(tool: Column) -> Column:
    return F.when(tool.isin(OBSERVING), "observation").when(tool.isin(EFFECTING), "effect").otherwise("mixed")


def semver(text: Column) -> Column:
    """[major, minor, patch] of ``1.2.3`` with an optional leading v; null if it is none."""
    return F.when(text.rlike(r"^v?\d+\.\d+\.\d+"), F.transform(F.split(F.regexp_extract(text, r"^v?(\d+\.\d+\.\d+)", 1), r"\."), lambda x: x.cast("int")))


def newer_version(new: Column, old: Column) -> Column:
    """An invalid new version is never newer; any valid one is newer than an invalid old one."""
    return F.when(semver(new).isNull(), False).when(semver(old).isNull(), True).otherwise(semver(new) > semver(old))


def valid_name(name: Column, most: int = 64) -> Column:
    """Lower-case letters, digits and single inner hyphens, at most ``most`` characters."""
    return F.coalesce(name.rlike("^[a-z0-9]+(-[a-z0-9]+)*$") & (F.length(name) <= most), F.lit(False))


def overlap_concat(a: Column, b: Column) -> Column:
    """Two arrays joined at the longest end of the first that begins the second."""
    n = F.least(F.size(a), F.size(b))
    k = F.coalesce(F.filter(F.sequence(n, F.lit(0), F.lit(-1)), lambda k: (k == 0) | (F.slice(a, -F.greatest(k, F.lit(1)), k) == F.slice(b, 1, k)))[0], F.lit(0))
    return F.concat(a, F.slice(b, k + 1, F.greatest(F.size(b), F.lit(1))))
