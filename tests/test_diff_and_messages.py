"""New-award diff (null-safe anti join per period), ordinals and message text."""

import datetime as dt

from rollcall.operators import diff as D
from rollcall.operators import notify as N

EARNED = "achievement_id int, period_kind string, period int, region string, pax_id string, date_awarded date"
HIST = "region string, id long, achievement_id int, pax_id string, date_awarded date, code string"
LIST = "region string, id int, name string, description string, verb string, code string"


def _list(spark, ids=(2, 13)):
    rows = [("r1", i, f"Name{i}", f"Desc{i}", f"verb{i}", f"code{i}") for i in ids]
    return spark.createDataFrame(rows, LIST)


def test_already_given_in_period_is_not_new(spark):
    earned = spark.createDataFrame(
        [(2, "month", 3, "r1", "U1", dt.date(2025, 3, 20)), (2, "month", 4, "r1", "U1", dt.date(2025, 4, 9)),
         (13, "week", 1, "r1", "U1", dt.date(2025, 1, 3))],
        EARNED,
    )
    # monk given in March; six pack given on 30 Dec 2024 (ISO week 1 of 2025) - another year, so not history
    hist = spark.createDataFrame(
        [("r1", 1, 2, "U1", dt.date(2025, 3, 10), "code2"), ("r1", 2, 13, "U1", dt.date(2024, 12, 30), "code13")], HIST
    )
    history = D.award_history(hist.drop("code"), _list(spark), dt.date(2025, 6, 1))
    got = sorted((r.achievement_id, r.period) for r in D.unseen_awards(earned, history).collect())
    assert got == [(2, 4), (13, 1)]


def test_unlisted_award_and_unsigned_region_are_skipped(spark):
    earned = spark.createDataFrame([(2, "month", 3, "r1", "U1", dt.date(2025, 3, 20)), (4, "month", 3, "r1", "U1", dt.date(2025, 3, 20)),
                                    (2, "month", 3, "r2", "U2", dt.date(2025, 3, 20))], EARNED)
    empty = spark.createDataFrame([], HIST)
    config = spark.createDataFrame([("r1", "C1"), ("r2", None)], "region string, achievement_channel string")
    lst = _list(spark).unionByName(_list(spark).where("id = 2").selectExpr("'r2' AS region", "id", "name", "description", "verb", "code"))
    regions = D.eligible_regions(config, lst)
    got = [(r.region, r.achievement_id) for r in D.new_awards(earned, empty, lst, regions).collect()]
    assert got == [("r1", 2)]


def test_ordinals_messages_and_six_pack_routing(spark):
    new = spark.createDataFrame(
        [("r1", 13, "U1", dt.date(2025, 1, 10), "week", 2), ("r1", 13, "U1", dt.date(2025, 1, 17), "week", 3),
         ("r1", 2, "U1", dt.date(2025, 1, 31), "month", 1)],
        "region string, achievement_id int, pax_id string, date_awarded date, period_kind string, period int",
    )
    counts = spark.createDataFrame([("r1", "U1", 7, 2)], "region string, pax_id string, achievement_id int, n long")
    ords = sorted((r.achievement_id, r.period, r.total_awards, r.nth_time) for r in D.award_ordinals(new, counts).collect())
    assert ords == [(2, 1, 3, 1), (13, 2, 4, 1), (13, 3, 5, 2)]
    regions = spark.createDataFrame([("r1", "CACH")], "region string, achievement_channel string")
    msgs = {r.date_awarded: r for r in N.award_messages(D.award_ordinals(new, counts), _list(spark), regions).collect()}
    first = msgs[dt.date(2025, 1, 10)]
    assert first.target == "CACH"
    assert first.text == (
        "Congrats to our man <@U1>! He just unlocked the achievement *Name13* for verb13 which he earned on "
        "2025-01-10. This is achievement #4 for <@U1> and the 1st time this year he's earned this award. "
        "Keep up the good work!"
    )
    repeat = msgs[dt.date(2025, 1, 17)]
    assert repeat.target == "U1"
    assert repeat.text == "Nice work brother. You just earned 6 pack for the 2nd time this year!"
    compat = {r.date_awarded: r for r in N.award_messages(D.award_ordinals(new, counts), _list(spark), regions, compat=True).collect()}
    assert compat[dt.date(2025, 1, 17)].text.startswith("Congrats to our man <@U1>!")


def test_ordinal_suffixes(spark):
    from pyspark.sql import functions as F

    from rollcall.functions.text import ordinal_suffix

    ns = [1, 2, 3, 4, 11, 12, 13, 21, 22, 23, 101, 111, 112]
    got = [r.s for r in spark.createDataFrame([(n,) for n in ns], "n int").select(ordinal_suffix(F.col("n")).alias("s")).collect()]
    assert got == ["st", "nd", "rd", "th", "th", "th", "th", "st", "nd", "rd", "st", "th", "th"]


def test_run_summary_keeps_zero_regions(spark):
    new = spark.createDataFrame([("r1", 2, "U1", dt.date(2025, 1, 31), "month", 1)],
                                "region string, achievement_id int, pax_id string, date_awarded date, period_kind string, period int")
    regions = spark.createDataFrame([("r1", "C1"), ("r2", "C2")], "region string, achievement_channel string")
    logs = spark.createDataFrame([("r1", "L1")], "region string, log_channel string")
    got = {r.region: (r.target, r.n_new) for r in N.run_summary(new, regions, logs).collect()}
    assert got == {"r1": ("L1", 1), "r2": (None, 0)}


def test_anti_join_matches_null_keys(spark):
    earned = spark.createDataFrame([(1, "year", 2025, "r1", None, dt.date(2025, 3, 1)),
                                    (1, "year", 2025, "r1", "U2", dt.date(2025, 3, 1))], EARNED)
    hist = spark.createDataFrame([("r1", 1, 1, None, dt.date(2025, 2, 1), "code1")], HIST)
    got = [r.pax_id for r in D.unseen_awards(earned, hist).collect()]
    assert got == ["U2"]
    plan = D.unseen_awards(earned, hist)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_new_awards_equal_later_minus_earlier_by_brute_force(spark):
    """awards(t2) - awards(t1) == unseen awards, checked in plain Python on the smallest driver tables."""
    from rollcall import queries as Q
    from rollcall.sources import fixtures as X

    sf = "/root/testdata/sf0.001"
    specs = Q.driver_specs()
    later = [tuple(r) for r in Q.awards_region_users(spark, sf).collect()]
    earlier = X.award_history_table(spark, sf).collect()
    kind = {s.id: s.period_kind for s in specs}

    def period(aid, d):
        k = kind.get(aid, "year")
        return d.month if k == "month" else d.isocalendar()[1] if k == "week" else d.year

    given = {(h.region, h.achievement_id, period(h.achievement_id, h.date_awarded), h.pax_id)
             for h in earlier if h.date_awarded.year == X.AWARD_AS_OF.year}
    history = D.award_history(X.award_history_table(spark, sf), X.achievements_list(spark, sf), X.AWARD_AS_OF)
    # the history of the query path keeps only awards still in the region's list
    listed = {(r.region, r.id) for r in X.achievements_list(spark, sf).collect()}
    expected = sorted(r for r in later
                      if (r[3], r[0], r[2], r[4]) not in {g for g in given if (g[0], g[1]) in listed})
    got = sorted(tuple(r) for r in D.unseen_awards(Q.awards_region_users(spark, sf), history, specs).collect())
    assert got == expected and len(got) > 0
