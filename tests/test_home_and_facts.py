"""Home-region ladder, arg-max ties, and the national fact joins (J1 vs J2)."""

import datetime as dt

from rollcall.operators import facts as Fa
from rollcall.operators import home as H

AS_OF = dt.date(2025, 6, 30)
ATT = "region string, email string, user_id string, bd_date date"


def d(days_ago):
    return AS_OF - dt.timedelta(days=days_ago)


def test_ladder_takes_first_nonzero_window(spark):
    rows = [
        ("r1", "a", "u1", d(5)), ("r1", "a", "u1", d(100)),  # 30-day count 1
        ("r2", "a", "u9", d(45)), ("r2", "a", "u9", d(50)), ("r2", "a", "u9", d(55)),  # 60-day count 3
        ("r3", "b", "u2", d(150)), ("r3", "b", "u2", d(160)),  # year-to-date only
        ("r4", "c", "u3", d(-3)),  # a future date is inside every window
        ("r5", "e", "u5", dt.date(2024, 12, 20)),  # no post this year: no row
    ]
    got = {(r.region, r.email): r.attendance for r in H.home_region_counts(spark.createDataFrame(rows, ATT), AS_OF).collect()}
    assert got == {("r1", "a"): 1, ("r2", "a"): 3, ("r3", "b"): 2, ("r4", "c"): 1}


def test_pick_is_deterministic_on_ties(spark):
    counts = spark.createDataFrame([("r1", "a", 3), ("r2", "a", 3), ("r0", "a", 1)], "region string, email string, attendance long")
    assert [tuple(r) for r in H.pick_home_region(counts).collect()] == [("a", "r2", 3)]


def test_null_email_uses_year_count(spark):
    rows = [("r1", None, "u1", d(5)), ("r1", None, "u1", d(150))]
    got = H.home_region_counts(spark.createDataFrame(rows, ATT), AS_OF).collect()
    assert [(r.email, r.attendance) for r in got] == [(None, 2)]


def test_by_user_windows_per_email_year_per_user(spark):
    rows = [("r1", "a", "u1", d(5)), ("r1", "a", "u2", d(150)), ("r1", "a", "u2", d(151))]
    got = {r.user_id: r.attendance for r in H.home_region_counts_by_user(spark.createDataFrame(rows, ATT), AS_OF).collect()}
    # both accounts get the email's 30-day count (1)
    assert got == {"u1": 1, "u2": 1}


def _tables(spark):
    users = spark.createDataFrame(
        [("r1", "u1", "a@x", "A"), ("r1", "u2", "b@x", "B"), ("r1", "u3", "none", "C"), ("r1", "u4", "d@x", "PAXminer")],
        "region string, user_id string, email string, user_name string",
    )
    bd = dt.date(2025, 3, 3)
    beatdowns = spark.createDataFrame(
        [("r1", "S1", bd, "u1", "u2", "Regular"), ("r1", "S1", bd, "u9", None, "second event same site and day")],
        "region string, ao_id string, bd_date date, q_user_id string, coq_user_id string, backblast string",
    )
    attendance = spark.createDataFrame(
        [("r1", "u1", "S1", "u1", bd), ("r1", "u2", "S1", "u2", bd), ("r1", "u3", "S1", "u1", bd), ("r1", "u4", "S1", "u1", bd)],
        "region string, user_id string, ao_id string, q_user_id string, date date",
    )
    aos = spark.createDataFrame([("r1", "S1", "ao-one", None)], "region string, channel_id string, ao string, site_q_user_id string")
    return users, attendance, beatdowns, aos


def test_j1_needs_the_q_j2_accepts_the_coq(spark):
    t = _tables(spark)
    j1 = Fa.attendance_fact(*t).collect()
    assert sorted(r.user_id for r in j1) == ["u1", "u3", "u4"]  # u2 recorded the co-leader
    j2 = Fa.post_fact(*t, as_of=AS_OF, current_year=True).collect()
    # 'none' email and the system user are dropped; u2 joins through the co-leader
    assert sorted((r.user_id, r.q_flag) for r in j2) == [("u1", 1), ("u2", 1)]


def test_future_and_other_year_events_are_filtered(spark):
    users, attendance, beatdowns, aos = _tables(spark)
    early = dt.date(2025, 3, 1)
    assert Fa.post_fact(users, attendance, beatdowns, aos, as_of=early, current_year=True).count() == 0
    assert Fa.post_fact(users, attendance, beatdowns, aos, as_of=dt.date(2026, 1, 5), current_year=True).count() == 0
    assert Fa.post_fact(users, attendance, beatdowns, aos, as_of=dt.date(2026, 1, 5), current_year=False).count() == 2


def test_event_join_is_an_equi_join(spark):
    plan = Fa.post_fact(*_tables(spark), as_of=AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_double_matched_attendance_is_kept_twice(spark):
    # two event rows at one site and date: (Q u1, coQ u2) and (Q u2); an attendance row whose recorded
    # leader is u2 matches both, so the post is counted twice (kept, like the source)
    users = spark.createDataFrame([("r1", "u3", "c@x", "C")], "region string, user_id string, email string, user_name string")
    bd = dt.date(2025, 3, 3)
    beatdowns = spark.createDataFrame(
        [("r1", "S1", bd, "u1", "u2", "Regular"), ("r1", "S1", bd, "u2", None, "Regular")],
        "region string, ao_id string, bd_date date, q_user_id string, coq_user_id string, backblast string",
    )
    attendance = spark.createDataFrame([("r1", "u3", "S1", "u2", bd)], "region string, user_id string, ao_id string, q_user_id string, date date")
    aos = spark.createDataFrame([("r1", "S1", "ao-one", None)], "region string, channel_id string, ao string, site_q_user_id string")
    assert Fa.post_fact(users, attendance, beatdowns, aos, as_of=AS_OF).count() == 2
    assert Fa.attendance_fact(users, attendance, beatdowns, aos).count() == 1
    events = Fa.event_posts(users, attendance, beatdowns, aos)
    assert Fa.valid_posts(events, AS_OF).count() == 2 and Fa.q_attendance(events).count() == 1


def test_ever_led_equals_led_posts_of_the_full_fact(spark):
    from rollcall.sources import fixtures as X

    sf = "/root/testdata/sf0.01"
    t = (X.normalised_users(spark, sf), X.normalised_attendance(spark, sf),
         X.normalised_beatdowns(spark, sf), X.normalised_aos(spark, sf))
    as_of = dt.date(1998, 10, 31)
    led = {r.email for r in Fa.ever_led(*t, as_of=as_of).collect()}
    full = {r.email for r in Fa.post_fact(*t, as_of=as_of, current_year=False).where("q_flag = 1").select("email").distinct().collect()}
    assert led == full and len(led) > 100
    plan = Fa.ever_led(*t, as_of=as_of)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
