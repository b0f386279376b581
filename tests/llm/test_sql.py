"""Queries of this subpackage against their SQL in another engine."""

import os
from collections import Counter

import duckdb
import pytest

from tessera.llm.registry import ORACLES, QUERIES
from tests.llm.conftest import EDGE, frame
from tests.llm.test_text_and_audio import LICENSED

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(round(v[k], 6) if isinstance(v[k], float) else v[k] for k in order) for v in values)


def compare(spark, name, sf_dir, tables):
    c = duckdb.connect()
    for t in tables:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = c.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    compare(spark, name, SF, ["documents", "pages"])


def test_edges_equal_sql(spark, tmp_path):
    keep = [r for r in EDGE if r[0] is not None or r[1]]
    frame(spark, EDGE + LICENSED * 2).select("doc_id", "text").write.parquet(f"{tmp_path}/c/documents.parquet")
    compare(spark, "op5_licenses", f"{tmp_path}/c", ["documents"])
    frame(spark, [r for r in keep if r[0] not in (9, None)]).select("doc_id", "text").write.parquet(f"{tmp_path}/b/documents.parquet")
    compare(spark, "op10_exact_dedup", f"{tmp_path}/b", ["documents"])
    link = [(1, "http://bad.org/1", '<a href="http://spam.net/x"> <A HREF=//mid.org/>'), (2, "http://spam.net/x", ""), (3, "http://mid.org/1", "<a href='http://q.org/y'>"), (4, "http://q.org/fr/y", None), (5, None, "<a href='http://z.org'>")]
    spark.createDataFrame(link, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    compare(spark, "op4_url_trust", str(tmp_path), ["pages"])
