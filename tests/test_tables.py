"""Size-checked broadcasts, spreading of small scans, the shared folder."""

from tidemark.sources.scratch import fresh_path, materialise, shared_dir
from tidemark.sources.tables import broadcast_if_small, spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_below_the_counted_size(spark):
    left, right = spark.range(50), spark.range(30)
    assert "BroadcastHashJoin" in plan(left.join(broadcast_if_small(right, 30), "id"))
    assert "SortMergeJoin" in plan(left.join(broadcast_if_small(right, 29), "id"))


def test_spread_deals_out_small_scans_only(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    small = spark.read.parquet(str(tmp_path / "one"))
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(small).count() == 100
    many = spark.range(100).repartition(40)
    assert spread(many) is many


def test_written_tables_keep_rows_and_types(spark):
    df = spark.sql("SELECT id, CAST(NULL AS STRING) AS s, array(id) AS a FROM range(10)")
    back = materialise(df, "t")
    assert back.dtypes == df.dtypes and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert fresh_path(spark, "t") != fresh_path(spark, "t") and fresh_path(spark, "t").startswith(shared_dir(spark))
    assert materialise(df.limit(0), "t").count() == 0
