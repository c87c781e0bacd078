import pytest

from tripleforge import runtime


def test_materialize_and_discard(spark):
    df = runtime.materialize(spark.range(10).selectExpr("id", "array(id) as a"), "t")
    assert df.count() == 10 and "FileScan" in df._jdf.queryExecution().executedPlan().toString()
    assert runtime.discard(spark) >= 1 and runtime.discard(spark) == 0


def test_settings_are_restored(spark):
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), runtime.tuned(spark, spark__sql__files__openCostInBytes=5):
        assert spark.conf.get(key) == "5"
        1 / 0
    assert spark.conf.get(key) == before


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert runtime.spread(spark.read.parquet(f"{tmp_path}/one")).rdd.getNumPartitions() == 4
    assert runtime.spread(spark.range(100).repartition(9)).rdd.getNumPartitions() == 9
