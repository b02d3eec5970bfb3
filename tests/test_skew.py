"""A person holding a third of all posts: the post-level home-region join is split by AQE, results unchanged."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.operators import facts as Fa


@pytest.fixture
def skew_conf(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_email_join_is_split_and_exact(spark, skew_conf):
    from rollcall.session import stage_table

    n = 30000
    posts = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), (F.col("id") % 1000).cast("string"))).alias("email"),
        F.lit("U").alias("user_name"),
        (F.col("id") % 17).cast("string").alias("ao_id"),
        F.lit("ao").alias("ao"),
        F.date_add(F.lit(dt.date(2025, 1, 1)), (F.col("id") % 300).cast("int")).alias("date"),
        F.lit(0).alias("q_flag"),
        F.lit("Regular").alias("backblast"),
        F.lit("r0").alias("site_region"),
        F.col("id").cast("string").alias("user_id"),
    )
    # the per-person table is staged (as in report_run), so both join inputs are plain shuffles
    home = stage_table(
        posts.select("email").distinct().select("email", F.concat(F.lit("r"), F.length("email").cast("string")).alias("region")),
        "skew_home",
    )
    joined = Fa.attach_home_region(posts, home)
    rows = joined.collect()
    assert len(rows) == n
    assert sum(1 for r in rows if r.email == "hot") == n // 3
    final_plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin(skew=true)" in final_plan
