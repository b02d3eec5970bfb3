"""Command line on a folder of Parquet tables (the sf0.001 driver tables through the adapters)."""

import os

import pytest
from pyspark.sql import functions as F

from rollcall.plans import cli
from rollcall.sources import fixtures as X

SF = "/root/testdata/sf0.01"


def _write_lake(spark, root):
    X.normalised_users(spark, SF).write.parquet(os.path.join(root, "users"))
    X.normalised_attendance(spark, SF).write.parquet(os.path.join(root, "bd_attendance"))
    X.normalised_beatdowns(spark, SF).write.parquet(os.path.join(root, "beatdowns"))
    X.normalised_aos(spark, SF).drop("site_q_user_id").write.parquet(os.path.join(root, "aos"))  # column added later
    cfg = X.region_config(spark, SF).withColumnRenamed("region", "paxminer_schema")
    cfg.write.parquet(os.path.join(root, "region_config"))
    X.achievements_list(spark, SF).write.parquet(os.path.join(root, "achievements_list"))


def test_award_and_report_commands(spark, tmpdir_path):
    lake = os.path.join(tmpdir_path, "lake")
    _write_lake(spark, lake)
    awarded = os.path.join(tmpdir_path, "awarded")
    args = ["award", "--tables", lake, "--as-of", "1998-10-31", "--awarded-path", awarded,
            "--notifications", os.path.join(tmpdir_path, "notes")]
    first = cli.main(args)
    assert first["new_awards"] > 0
    assert spark.read.parquet(awarded).count() == first["new_awards"]
    assert cli.main(args)["new_awards"] == 0
    # awards that the lake itself holds are not awarded again, before or after the path has its own
    spark.read.parquet(awarded).write.parquet(os.path.join(lake, "achievements_awarded"))
    other = [*args[:-4], "--awarded-path", os.path.join(tmpdir_path, "other")]
    assert cli.main(other)["new_awards"] == 0 and cli.main(other)["new_awards"] == 0
    bad = os.path.join(tmpdir_path, "bad")
    os.makedirs(bad)
    with open(os.path.join(bad, "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        cli.main([*args[:-4], "--awarded-path", bad])
    rep = cli.main(["report", "--tables", lake, "--as-of", "1998-10-31"])
    assert rep["reports"] == X.region_config(spark, SF).count()


def test_photos_command(spark, tmpdir_path):
    sf = "/root/testdata/sf0.001"
    msgs, members, images = (os.path.join(tmpdir_path, n) for n in ("msgs", "members", "images"))
    X.photo_messages(X.photo_base(spark, sf)).write.json(msgs)
    X.photo_members(X.photo_base(spark, sf)).write.json(members)
    os.makedirs(images)
    for r in X.photo_contents(X.photo_base(spark, sf)).toLocalIterator():  # every file on local disk for the binaryFile source
        with open(os.path.join(images, f"{r.file_id}.bin"), "wb") as f:
            f.write(bytes(r.content))
    seen = os.path.join(tmpdir_path, "seen")
    args = ["photos", "--messages", msgs, "--members", members, "--images", images,
            "--as-of", X.PHOTO_AS_OF.isoformat(), "--seen", seen]
    out = cli.main(args)
    assert out["photos"] > 0
    assert spark.read.parquet(seen).where(F.length("checksum") == 32).count() == out["photos"]
    assert cli.main(args)["photos"] == out["photos"]  # a rerun of the month replaces it
    assert spark.read.parquet(seen).count() == out["photos"]


def test_setup_command(spark, tmpdir_path):
    regions = os.path.join(tmpdir_path, "regions")
    spark.createDataFrame([("f3one",), ("f3two",), ("other",)], "schema_name string").write.parquet(regions)
    out = cli.main(["setup", "--regions", regions, "--database", "rc_cli"])
    assert out["regions"] == 2
    lst = spark.table("rc_cli.achievements_list")
    assert lst.count() == 28 and {r.region for r in lst.select("region").distinct().collect()} == {"f3one", "f3two"}
    cli.main(["setup", "--regions", regions, "--database", "rc_cli"])
    assert spark.table("rc_cli.achievements_list").count() == 28


def test_award_command_on_catalog_tables(spark, tmpdir_path):
    from rollcall.sources import tables as S

    db = "rc_award_cli"
    S.store_by_event(spark, {"users": X.normalised_users(spark, SF), "bd_attendance": X.normalised_attendance(spark, SF),
                             "beatdowns": X.normalised_beatdowns(spark, SF), "aos": X.normalised_aos(spark, SF)}, db, buckets=4)
    X.region_config(spark, SF).withColumnRenamed("region", "paxminer_schema").write.saveAsTable(f"{db}.region_config")
    regions = os.path.join(tmpdir_path, "regions")
    X.regions(spark, SF).select(F.concat(F.lit("f3"), "region").alias("schema_name")).write.parquet(regions)
    cli.main(["setup", "--regions", regions, "--database", db])
    # the lists of the fixture's regions, whose names have no prefix
    X.achievements_list(spark, SF).select("id", "name", "description", "verb", "code", "region").write.insertInto(f"{db}.achievements_list")
    args = ["award", "--database", db, "--as-of", "1998-10-31"]
    first = cli.main(args)
    assert first["new_awards"] > 0 and first["failed_tables"] == 0
    history = spark.table(f"{db}.achievements_awarded")
    assert history.count() == first["new_awards"]
    assert [r.run_date.isoformat() for r in history.select("run_date").distinct().collect()] == ["1998-10-31"]
    assert cli.main(args)["new_awards"] == 0
    spark.catalog.refreshTable(f"{db}.achievements_awarded")
    assert spark.table(f"{db}.achievements_awarded").count() == first["new_awards"]
    assert spark.newSession().table(f"{db}.achievements_view").count() > 0


def test_a_singular_history_is_found_and_kept(spark, tmpdir_path):
    db = "rc_singular"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    spark.sql(f"CREATE TABLE {db}.achievement_awarded (region string, id bigint, achievement_id int, pax_id string, date_awarded date, created timestamp, updated timestamp, run_date date) USING parquet PARTITIONED BY (run_date)")
    lake = os.path.join(tmpdir_path, "lake")
    _write_lake(spark, lake)
    regions = os.path.join(tmpdir_path, "regions")
    spark.createDataFrame([("f3x",)], "schema_name string").write.parquet(regions)
    cli.main(["setup", "--regions", regions, "--database", db])
    assert not spark.catalog.tableExists(f"{db}.achievements_awarded")
    X.achievements_list(spark, SF).select("id", "name", "description", "verb", "code", "region").write.insertInto(f"{db}.achievements_list")
    out = cli.main(["award", "--tables", lake, "--database", db, "--as-of", "1998-10-31"])
    spark.catalog.refreshTable(f"{db}.achievement_awarded")
    assert spark.table(f"{db}.achievement_awarded").count() == out["new_awards"] > 0


def test_a_bad_region_does_not_stop_the_commands(spark, tmpdir_path):
    lake = os.path.join(tmpdir_path, "lake")
    _write_lake(spark, lake)
    cfg = X.region_config(spark, SF).withColumn("region", F.concat(F.lit("f3"), "region"))
    names = [f"f3{i}" for i in range(4)]
    for i, name in enumerate(names):
        for table in ("users", "bd_attendance", "beatdowns", "aos"):
            if (name, table) != ("f32", "beatdowns"):
                spark.read.parquet(os.path.join(lake, table)).where(F.col("region") == str(i)).drop("region").write.parquet(os.path.join(tmpdir_path, "regions_lake", name, table))
    root = os.path.join(tmpdir_path, "regions_lake")
    spark.createDataFrame([(n,) for n in [*names, "other"]], "schema_name string").write.parquet(os.path.join(root, "regions"))
    cfg.write.parquet(os.path.join(root, "region_config"))
    X.achievements_list(spark, SF).withColumn("region", F.concat(F.lit("f3"), "region")).write.parquet(os.path.join(root, "achievements_list"))
    bad = os.path.join(tmpdir_path, "bad")
    out = cli.main(["award", "--tables", root, "--by-region", "--failures", bad, "--as-of", "1998-10-31", "--awarded-path", os.path.join(tmpdir_path, "aw")])
    assert out["failed_tables"] == 1 and out["new_awards"] > 0
    assert [(r.region, r.table, r.run_date.isoformat()) for r in spark.read.parquet(bad).collect()] == [("f32", "beatdowns", "1998-10-31")]
    assert {r.region for r in spark.read.parquet(os.path.join(tmpdir_path, "aw")).collect()} <= {"f30", "f31", "f33"}
    rep = cli.main(["report", "--tables", root, "--by-region", "--as-of", "1998-10-31", "--led-state", os.path.join(tmpdir_path, "led")])
    assert rep["failed_tables"] == 1 and rep["reports"] > 0
