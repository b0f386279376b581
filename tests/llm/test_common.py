import pytest
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.storage import shared_folder


def test_shared_folder_is_the_session_s(spark, monkeypatch):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Conf:
        def __init__(self, master):
            self.master = master

        def get(self, key, default=None):
            return self.master if key == "spark.master" else default

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    assert shared_folder(Session("local[4]")).endswith("checkpoints")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(Session(master))


def test_store_drops_by_name(spark):
    store = common.Store(spark, "test")
    a, b, c = (store.keep(spark.range(k)) for k in (1, 2, 3))
    store.drop(a)
    store.drop_others(c)
    assert [r.tableName for r in spark.sql(f"SHOW TABLES IN {store.name}").collect()] == ["t2"] and c.count() == 3


def test_row_hash_takes_all_columns(spark):
    df = spark.sql("SELECT 1 AS a, map('x', 1) AS m, struct(1 AS b) AS s UNION ALL SELECT 1, map('x', 2), struct(1) UNION ALL SELECT 1, map('x', 1), struct(2) UNION ALL SELECT 1, map('x', 1), struct(1)")
    assert df.select(common.row_hash(df).alias("h")).distinct().count() == 3


def test_spread_and_broadcast_few(spark):
    assert common.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    wide = spark.range(10).repartition(50, F.col("id"))
    assert common.spread(wide).count() == 10
    assert "broadcast" in common.broadcast_few(spark.range(3), 3)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in common.broadcast_few(spark.range(3), 200_000)._jdf.queryExecution().logical().toString().lower()
