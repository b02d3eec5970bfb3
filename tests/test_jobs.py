"""End-to-end jobs on the driver tables: sinks, rerun idempotency, state updates."""

import os

import pytest
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.plans import jobs as J
from rollcall.queries import driver_specs
from rollcall.sources import fixtures as X

SF = "/root/testdata/sf0.01"


def _tables(spark):
    return J.AttendanceTables(
        X.normalised_users(spark, SF), X.normalised_attendance(spark, SF),
        X.normalised_beatdowns(spark, SF), X.normalised_aos(spark, SF),
    )


def test_award_run_appends_once(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "awarded")
    notes = os.path.join(tmpdir_path, "notes")
    empty = spark.createDataFrame([], schemas.ACHIEVEMENTS_AWARDED)
    lst = X.achievements_list(spark, SF)
    cfg = X.region_config(spark, SF)
    out = J.award_run(_tables(spark), cfg, lst, empty, X.FACT_AS_OF, specs=driver_specs(),
                      awarded_path=path, notifications_path=notes)
    n1 = out["new_awards"].count()
    assert n1 > 0
    written = spark.read.parquet(path)
    assert written.count() == n1
    assert written.where(F.col("id").isNull() | F.col("created").isNull()).count() == 0
    assert written.select("id").distinct().count() == n1
    assert out["messages"].count() == n1
    # second run on the same date: everything is already in the history
    out2 = J.award_run(_tables(spark), cfg, lst, spark.read.parquet(path), X.FACT_AS_OF, specs=driver_specs(),
                       awarded_path=path)
    assert out2["new_awards"].count() == 0
    assert spark.read.parquet(path).count() == n1
    kinds = {r.kind for r in spark.read.parquet(notes).select("kind").distinct().collect()}
    assert kinds == {"award", "award_summary"}


def test_award_run_respects_region_list(spark):
    empty = spark.createDataFrame([], schemas.ACHIEVEMENTS_AWARDED)
    names = spark.createDataFrame([("f3devcommunity",), ("x1",)], "schema_name string")
    out = J.award_run(_tables(spark), X.region_config(spark, SF), X.achievements_list(spark, SF), empty,
                      X.FACT_AS_OF, region_names=names, specs=driver_specs())
    assert out["new_awards"].count() == 0


def test_report_run(spark, tmpdir_path):
    notes_path = os.path.join(tmpdir_path, "notes")
    out = J.report_run(_tables(spark), X.region_config(spark, SF), X.FACT_AS_OF, notifications_path=notes_path)
    written = spark.read.parquet(notes_path).count()
    assert written == out["notifications"].count() > 0
    # a rerun for the same date replaces that run's messages
    J.report_run(_tables(spark), X.region_config(spark, SF), X.FACT_AS_OF, notifications_path=notes_path)
    assert spark.read.parquet(notes_path).count() == written
    n_regions = X.region_config(spark, SF).count()
    kinds = out["notifications"].groupBy("kind").count().collect()
    counts = {r["kind"]: r["count"] for r in kinds}
    assert counts["report_log"] == n_regions
    mia = {r.user_id for r in out["mia"].collect()}
    lowq = {r.user_id for r in out["lowq"].collect()}
    assert not (mia & lowq)


def test_photo_run_is_idempotent_per_month_and_skips_earlier_months(spark, tmpdir_path):
    import datetime as dt

    seen, manifest = os.path.join(tmpdir_path, "seen"), os.path.join(tmpdir_path, "manifest")
    base = X.photo_base(spark, SF)
    inputs = (X.photo_messages(base), X.photo_members(base), X.photo_contents(base))
    first = J.photo_run(*inputs, X.PHOTO_AS_OF, seen_path=seen, manifest_path=manifest)["manifest"].count()
    assert first > 0
    # a rerun for the same month replaces that month: same rows, nothing appended twice
    again = J.photo_run(*inputs, X.PHOTO_AS_OF, seen_path=seen, manifest_path=manifest)["manifest"].count()
    assert again == first
    assert spark.read.parquet(manifest).count() == first
    assert spark.read.parquet(seen).count() == first
    # the next month never re-archives an image archived in this month
    nxt = J.photo_run(*inputs, X.PHOTO_AS_OF + dt.timedelta(days=31), seen_path=seen, manifest_path=manifest)
    earlier = spark.read.parquet(seen).where(F.col("month") == "2000-02").select("checksum")
    assert nxt["manifest"].count() > 0
    assert nxt["manifest"].join(earlier, "checksum").count() == 0
    assert spark.read.parquet(manifest).select("month").distinct().count() == 2


def test_catalogue_setup_is_idempotent(spark):
    regions = spark.createDataFrame([("f3a",), ("f3b",)], "region string")
    J.catalogue_setup(spark, regions, database="rc_test")
    J.catalogue_setup(spark, regions, database="rc_test")
    lst = spark.table("rc_test.achievements_list")
    assert lst.count() == 28
    assert lst.select("code").distinct().count() == 14


def test_not_null_is_enforced_on_write(spark, tmpdir_path):
    from rollcall.operators import catalog as K

    bad = spark.createDataFrame([("r1", 1, None, None)], "region string, achievement_id int, pax_id string, date_awarded date")
    with pytest.raises(Exception):
        K.record_run(K.awarded_rows(bad), X.FACT_AS_OF, path=os.path.join(tmpdir_path, "bad"))


def test_shared_event_join_gives_the_same_results(spark):
    empty = spark.createDataFrame([], schemas.ACHIEVEMENTS_AWARDED)
    args = (_tables(spark), X.region_config(spark, SF), X.achievements_list(spark, SF), empty, X.FACT_AS_OF)
    shared = J.award_run(*args, specs=driver_specs(), share_event_join=True)
    split = J.award_run(*args, specs=driver_specs(), share_event_join=False)
    for key in ("new_awards", "messages", "summary"):
        a = sorted(tuple(r) for r in shared[key].collect())
        b = sorted(tuple(r) for r in split[key].collect())
        assert a == b and len(a) > 0
    rshared = J.report_run(_tables(spark), X.region_config(spark, SF), X.FACT_AS_OF, share_event_join=True)
    rsplit = J.report_run(_tables(spark), X.region_config(spark, SF), X.FACT_AS_OF, share_event_join=False)
    for key in ("mia", "lowq", "noq", "report"):
        assert sorted(tuple(r) for r in rshared[key].collect()) == sorted(tuple(r) for r in rsplit[key].collect())


def test_award_run_on_catalog_tables_and_trophy_view(spark):
    from rollcall.operators import catalog as K

    db = "rc_awards"
    regions = X.regions(spark, SF).select("region")
    J.catalogue_setup(spark, regions, database=db)
    lst_t, aw_t = f"{db}.{K.LIST_TABLE}", f"{db}.{K.AWARDED_TABLE}"
    before = spark.table(aw_t).count()
    out = J.award_run(_tables(spark), X.region_config(spark, SF), spark.table(lst_t), spark.table(aw_t),
                      X.FACT_AS_OF, specs=driver_specs(), awarded_table=aw_t)
    n = out["new_awards"].count()
    assert n > 0 and spark.table(aw_t).count() == before + n
    again = J.award_run(_tables(spark), X.region_config(spark, SF), spark.table(lst_t), spark.table(aw_t),
                        X.FACT_AS_OF, specs=driver_specs(), awarded_table=aw_t)
    assert again["new_awards"].count() == 0
    # the history grows under the job; texts must be those of a run whose history is a fixed path
    fixed = J.award_run(_tables(spark), X.region_config(spark, SF), spark.table(lst_t), spark.createDataFrame([], schemas.ACHIEVEMENTS_AWARDED),
                        X.FACT_AS_OF, specs=driver_specs())
    texts = lambda run: sorted((r.target, r.text) for r in run["messages"].collect())
    assert texts(out) == texts(fixed)
    # an attempt that finds its awards already recorded announces the same awards again
    assert len(texts(again)) == n and {t for _, t in texts(again)} == {t for _, t in texts(out)}
    # a failed attempt leaves a part of the run's awards: the next one records the rest and keeps the ids of those
    some = spark.table(aw_t).where("id % 2 = 0")
    kept = sorted(map(tuple, some.select("id", "created").collect()))
    stage = J.stage_table(some, "half")
    K.record_run(stage, X.FACT_AS_OF, table=aw_t)
    assert 0 < spark.table(aw_t).count() == len(kept) < n
    third = J.award_run(_tables(spark), X.region_config(spark, SF), spark.table(lst_t), spark.table(aw_t),
                        X.FACT_AS_OF, specs=driver_specs(), awarded_table=aw_t)
    assert third["new_awards"].count() == n - len(kept) and texts(third) == texts(out)
    assert spark.table(aw_t).count() == n
    assert sorted(map(tuple, spark.table(aw_t).where("id % 2 = 0").select("id", "created").collect())) == kept
    # an import stamped with the run's midnight is no award of the run
    spark.sql(f"INSERT INTO {aw_t} PARTITION (run_date = NULL) SELECT region, 77L, 8, 'U-import', DATE'1998-02-01', TIMESTAMP'1998-10-31 00:00:00', TIMESTAMP'1998-10-31 00:00:00' FROM {lst_t} LIMIT 1")
    fourth = J.award_run(_tables(spark), X.region_config(spark, SF), spark.table(lst_t), spark.table(aw_t),
                         X.FACT_AS_OF, specs=driver_specs(), awarded_table=aw_t)
    assert not any("U-import" in t for _, t in texts(fourth)) and spark.table(aw_t).count() == n + 1
    X.normalised_users(spark, SF).write.mode("overwrite").saveAsTable(f"{db}.users")
    X.normalised_aos(spark, SF).drop("site_q_user_id").write.mode("overwrite").saveAsTable(f"{db}.aos")
    for _ in range(2):
        J.catalogue_setup(spark, regions, database=db)
    other = spark.newSession()
    assert other.table(f"{db}.{K.VIEW_NAME}").count() == n
    assert sorted(other.table(f"{db}.{K.VIEW_NAME}").columns) == ["date_awarded", "description", "name", "pax", "pax_id", "region"]
    assert other.table(f"{db}.aos").columns[-1] == "site_q_user_id"


def test_injected_predicates_reach_the_award_run(spark):
    empty = spark.createDataFrame([], schemas.ACHIEVEMENTS_AWARDED)
    args = (_tables(spark), X.region_config(spark, SF), X.achievements_list(spark, SF), empty, X.FACT_AS_OF)
    none = F.lit(None).cast("boolean")
    for shared in (True, False):
        out = J.award_run(*args, specs=driver_specs(), share_event_join=shared, workout=none, qsource=none)
        assert out["new_awards"].count() == 0
        # every event a lesson: only the awards of lessons remain
        lessons = J.award_run(*args, specs=driver_specs(), share_event_join=shared, workout=none, qsource=F.col("backblast").isNotNull())
        assert {r.achievement_id for r in lessons["new_awards"].collect()} <= {1, 2} and lessons["new_awards"].count() > 0


def test_bounded_history_report_equals_full_history(spark):
    args = (_tables(spark), X.region_config(spark, SF), X.FACT_AS_OF)
    bounded = J.report_run(*args, bounded_history=True)
    full = J.report_run(*args, bounded_history=False)
    for key in ("mia", "lowq", "noq", "report"):
        a = sorted(tuple(r) for r in bounded[key].collect())
        b = sorted(tuple(r) for r in full[key].collect())
        assert a == b
    assert bounded["report"].count() > 0
