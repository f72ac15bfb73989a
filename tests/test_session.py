"""Session helpers: guarded repartition and lineage cut through a written table."""

from pyspark.sql import functions as F

from reqscope.session import materialize, shared_path, spread


def test_spread_only_where_asked(spark):
    df = spark.range(100)
    before = spark.conf.get("reqscope.spread")
    try:
        spark.conf.set("reqscope.spread", "off")
        assert spread(df, "id") is df
        spark.conf.set("reqscope.spread", "on")
        assert "RepartitionByExpression" in spread(df, "id")._jdf.queryExecution().logical().toString()
    finally:
        spark.conf.set("reqscope.spread", before)


def test_materialize_cuts_lineage(spark):
    df = spark.range(50).withColumn("sq", F.col("id") * F.col("id"))
    m = materialize(df, "unit")
    assert sorted(r["sq"] for r in m.collect()) == sorted(i * i for i in range(50))
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan  # reads the written table, not the original plan
    assert shared_path(spark, "x").startswith(spark.sparkContext.getCheckpointDir().rstrip("/"))
