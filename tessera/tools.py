"""Operators as tools: named functions over a session with a schema of their arguments, for callers that choose them by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import corpus, retrieval
from tessera.sources import files

#: Python types of JSON schema types.
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


class Tool(NamedTuple):
    description: str
    parameters: dict
    run: Callable[..., DataFrame]


class Tools:
    """A registry of tools. ``call`` gives a DataFrame, or a text that begins with ERR: for names and arguments that do not fit."""

    def __init__(self) -> None:
        self.known: dict[str, Tool] = {}

    def register(self, name: str, description: str, properties: Mapping[str, dict], required: tuple[str, ...] = ()):
        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.known[name] = Tool(description, {"type": "object", "properties": dict(properties), "required": list(required)}, f)
            return f

        return add

    def __contains__(self, name: str) -> bool:
        return name in self.known

    def summary(self) -> str:
        return "\n".join(f"- {name}: {tool.description}" for name, tool in self.known.items())

    def schema(self, name: str) -> dict | None:
        return self.known[name].parameters if name in self.known else None

    def problem(self, name: str, arguments: Mapping[str, Any]) -> str | None:
        if name not in self.known:
            return f"ERR: unknown tool '{name}'"
        wanted = self.known[name].parameters
        if lacking := [p for p in wanted["required"] if arguments.get(p) is None]:
            return f"ERR: {name} needs {', '.join(lacking)}"
        for p, value in arguments.items():
            if p not in wanted["properties"]:
                return f"ERR: {name} takes no {p}"
            kind = wanted["properties"][p].get("type")
            if value is not None and kind in KINDS and (not isinstance(value, KINDS[kind]) or kind != "boolean" and isinstance(value, bool)):
                return f"ERR: {p} of {name} must be {kind}"
        return None

    def call(self, spark: SparkSession, name: str, arguments: Mapping[str, Any]) -> DataFrame | str:
        return self.problem(name, arguments) or self.known[name].run(spark, **{k: v for k, v in arguments.items() if v is not None})


TOOLS = Tools()
_PATH = {"path": {"type": "string", "description": "A folder or file"}}


@TOOLS.register("list_dir", "Files and folders under a path", _PATH | {"depth": {"type": "integer"}}, ("path",))
def list_dir(spark: SparkSession, path: str, depth: int = 3) -> DataFrame:
    return files.folder_tree(spark, path, depth)


@TOOLS.register("grep", "Lines of text files that match a pattern, in order", _PATH | {"pattern": {"type": "string"}, "most": {"type": "integer"}}, ("path", "pattern"))
def grep(spark: SparkSession, path: str, pattern: str, most: int = 100) -> DataFrame:
    return corpus.grep(files.whole_files(spark, path), "path", "value", pattern, most)


@TOOLS.register("read_file", "Lines of a text file, numbered, from start to stop", _PATH | {"start": {"type": "integer"}, "stop": {"type": "integer"}}, ("path",))
def read_file(spark: SparkSession, path: str, start: int = 1, stop: int = -1) -> DataFrame:
    d = corpus.lines(files.whole_files(spark, path), "path", "value").where(F.col("line_no") >= start)
    return (d.where(F.col("line_no") <= stop) if stop >= 0 else d).select("line_no", "line").orderBy("line_no")


@TOOLS.register("search", "The texts of a Parquet table that fit a query best", _PATH | {"query": {"type": "string"}, "key": {"type": "string"}, "text": {"type": "string"}, "k": {"type": "integer"}}, ("path", "query", "key", "text"))
def search(spark: SparkSession, path: str, query: str, key: str, text: str, k: int = 10) -> DataFrame:
    return retrieval.bm25_search(spark.read.parquet(path), key, query.lower().split(), k, {text: 1})
