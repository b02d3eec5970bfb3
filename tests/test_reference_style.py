"""Injected predicates, look-back windows 30/60/90/120, award table structure."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.operators import awards as A
from rollcall.operators import catalog as K
from rollcall.operators import home as H

FACT = "email string, user_name string, ao_id string, ao string, date date, q_flag int, backblast string, region string"


def year_of_posts():
    """One person's 2024: a led post at a track every day of a week, and three talks at a hall in May."""
    track = [("kim@mail.org", "Kim", "S7", "river track", dt.date(2024, 3, 4 + d), 1, "laps and sprints", "north") for d in range(7)]
    hall = [("kim@mail.org", "Kim", "S9", "town hall", dt.date(2024, 5, 7 * w + 1), 0, "talk on habits", "north") for w in range(3)]
    return track + hall


def talk():
    return F.col("backblast").startswith("talk")


def sport():
    return F.col("ao").endswith("track")


#: award id -> (threshold, awards): talks a year and a month, led posts a month, posts a week and at a site
EXPECTED = {1: (3, 1), 2: (3, 1), 3: (7, 1), 13: (7, 1), 14: (7, 1)}


@pytest.mark.parametrize("award_id", sorted(EXPECTED))
def test_predicates_decide_what_counts(spark, award_id):
    threshold, awards = EXPECTED[award_id]
    fact = spark.createDataFrame(year_of_posts(), FACT)
    reached = A.award_specs({award_id: threshold}, ids=[award_id])
    missed = A.award_specs({award_id: threshold + 1}, ids=[award_id])
    assert A.earned_awards(fact, reached, qsource=talk(), workout=sport()).count() == awards
    assert A.earned_awards(fact, missed, qsource=talk(), workout=sport()).count() == 0
    assert A.earned_awards(fact, reached, qsource=F.lit(False), workout=F.lit(False)).count() == 0


@pytest.mark.parametrize("days", [30, 60, 90, 120])
def test_lookback_window_is_strict(spark, days):
    as_of = dt.date(2025, 6, 30)
    rows = [("r1", "in", "u", as_of - dt.timedelta(days=days - 1)), ("r1", "out", "u", as_of - dt.timedelta(days=days))]
    att = spark.createDataFrame(rows, "region string, email string, user_id string, bd_date date")
    got = {r.email: r.attendance for r in H.home_region_counts(att, as_of, lookbacks=(days,)).collect()}
    assert got == {"in": 1, "out": 1}  # "out" falls back to the year count
    inside = H._lookback_counts(att, as_of, (days,), ["email"]).collect()
    assert {r.email: r[f"c{days}"] for r in inside} == {"in": 1, "out": 0}


def test_award_table_structure():
    lst = [f for f in schemas.ACHIEVEMENTS_LIST.fields if f.name != "region"]
    awarded = [f for f in schemas.ACHIEVEMENTS_AWARDED.fields if f.name != "region"]
    assert [f.name for f in lst] == ["id", "name", "description", "verb", "code"]
    assert [f.name for f in awarded] == ["id", "achievement_id", "pax_id", "date_awarded", "created", "updated"]
    assert not any(f.nullable for f in lst) and not any(f.nullable for f in awarded)
    ddl = K._ddl("t", schemas.ACHIEVEMENTS_LIST, None)
    assert ddl.startswith("CREATE TABLE IF NOT EXISTS t (id int NOT NULL, name string NOT NULL")
    assert "PARTITIONED BY (region)" in ddl
