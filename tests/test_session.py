"""Checkpoint directory and staged tables."""

from rollcall.session import cut_lineage, ensure_checkpoint_dir, stage_table


def test_checkpoint_dir_is_kept_once_set(spark):
    first = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark, "/tmp/elsewhere") == first


def test_stage_table_writes_under_the_checkpoint_dir(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    staged = stage_table(df, "unit")
    assert sorted(tuple(r) for r in staged.collect()) == sorted(tuple(r) for r in df.collect())
    files = staged.inputFiles()
    root = ensure_checkpoint_dir(spark).replace("file:", "")
    assert files and all(root in f for f in files)
    # a later filter is pushed into the staged copy
    plan = staged.where("k = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "FileScan" in plan
    assert cut_lineage(df.where("k = 1")).count() == 15


def test_size_for_input(spark):
    from rollcall.session import size_for_input

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = size_for_input(spark, 10 << 40)  # 10 TiB
        assert int(got["spark.sql.shuffle.partitions"]) == 40960
        assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "40960"
        assert int(size_for_input(spark, 1 << 20)["spark.sql.shuffle.partitions"]) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", old)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(64 << 20))
