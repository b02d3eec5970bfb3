"""Award catalogue seed and the trophy view."""

import datetime as dt

from rollcall.constants import AWARD_CATALOGUE
from rollcall.operators import catalog as K


def test_seed_ids_codes_lengths(spark):
    rows = K.catalogue_seed(spark).collect()
    assert [r.id for r in rows] == list(range(1, 15))
    assert len({r.code for r in rows}) == 14
    assert all(" " not in r.code for r in rows)
    for r in rows:
        assert all(len(v) <= K.TEXT_LENGTH for v in (r.name, r.description, r.verb, r.code))
    assert rows[12].code == "6_pack" and rows[13].code == "holding_down_the_fort"
    assert len(AWARD_CATALOGUE) == 14


def test_seed_lists_per_region_without_cross_join(spark):
    regions = spark.createDataFrame([("r1",), ("r2",)], "region string")
    df = K.seed_lists(regions)
    assert df.count() == 28
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_trophy_view(spark):
    users = spark.createDataFrame([("r1", "U1", "a@x", "Alpha"), ("r2", "U1", "b@x", "Beta")],
                                  "region string, user_id string, email string, user_name string")
    awarded = spark.createDataFrame([("r1", 1, 2, "U1", dt.date(2025, 3, 1))],
                                    "region string, id long, achievement_id int, pax_id string, date_awarded date")
    lst = K.seed_lists(spark.createDataFrame([("r1",), ("r2",)], "region string"))
    rows = [tuple(r) for r in K.trophy_view(users, awarded, lst).collect()]
    assert rows == [("r1", "Alpha", "U1", "The Monk", "Post at 4 QSources in a month", dt.date(2025, 3, 1))]


def test_award_tables_fall_back_to_the_singular_name(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS rc_old")
    spark.sql("CREATE TABLE IF NOT EXISTS rc_old.achievements_list (id int, name string, description string, verb string, code string, region string) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS rc_old.achievement_awarded (id long, achievement_id int, pax_id string, date_awarded date, region string) USING parquet")
    lst, awarded, name = K.award_tables(spark, "rc_old")
    assert name == "rc_old.achievement_awarded"
    assert "pax_id" in awarded.columns and "code" in lst.columns
