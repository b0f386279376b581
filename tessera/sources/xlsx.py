"""Cells of spreadsheets in the Office Open XML format, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.corpus import per_document

#: What a cell holds when its formula fails.
ERRORS = ["#VALUE!", "#DIV/0!", "#REF!", "#NAME?", "#NULL!", "#NUM!", "#N/A"]
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(path: str, content: bytes | None) -> Iterator[tuple[str, str, str, str | None, str | None]]:
    try:
        book = zipfile.ZipFile(io.BytesIO(content or b""))
        names = set(book.namelist())
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in x.iter(f"{_MAIN}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    for sheet in root.iter(f"{_MAIN}sheet"):
        part = "xl/" + re.sub("^/?(xl/)?", "", links.get(sheet.get(_REL)) or "")
        if part not in names:
            continue
        for c in ElementTree.fromstring(book.read(part)).iter(f"{_MAIN}c"):
            value, formula = c.findtext(f"{_MAIN}v"), c.findtext(f"{_MAIN}f")
            if c.get("t") == "s" and value is not None:
                value = shared[int(value)] if int(value) < len(shared) else None
            elif c.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            if value is not None or formula is not None:
                yield path, sheet.get("name") or "", c.get("r") or "", value, formula


def cells(books: DataFrame) -> DataFrame:
    """(path, sheet, cell, value, formula) of (path, content); files that are no spreadsheets have none."""
    return per_document(books.select("path", "content"), "path string, sheet string, cell string, value string, formula string", _cells)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return cells(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path))


def error_summary(found: DataFrame, most: int = 20) -> DataFrame:
    """(path, token, n, places): failed cells of each kind, with the first ``most`` in order."""
    bad = found.where(F.col("value").isin(ERRORS)).select("path", F.col("value").alias("token"), F.concat("sheet", F.lit("!"), "cell").alias("place"))
    return bad.groupBy("path", "token").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list("place")), 1, most).alias("places"))


def formula_count(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(F.count("formula").alias("formulas"))
