"""Inactivity report lists, their invariants, and the message text."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.operators import lapse as L

AS_OF = dt.date(2025, 8, 1)
FACT = "email string, ao_id string, ao string, date date, q_flag int, region string, user_id string"
CFG = ("region string, default_siteq string, NO_POST_THRESHOLD int, NO_Q_THRESHOLD_WEEKS int, REMINDER_WEEKS int, "
       "NO_Q_THRESHOLD_POSTS int, HOME_AO_CAPTURE int")


def wk(weeks, days=0):
    return AS_OF - dt.timedelta(weeks=weeks, days=days)


@pytest.fixture
def inputs(spark):
    rows = [
        # A: last post 3 weeks ago -> lapsed poster
        ("a", "S1", "ao-1", wk(3), 1, "r1", "UA"), ("a", "S1", "ao-1", wk(6), 0, "r1", "UA"),
        # B: posts every week, last lead 3 weeks ago -> lapsed leader
        ("b", "S1", "ao-1", wk(0, 1), 0, "r1", "UB"), ("b", "S1", "ao-1", wk(3), 1, "r1", "UB"),
        # C: never led, posted 3 weeks ago and recently -> never led
        ("c", "S2", "ao-2", wk(3), 0, "r1", "UC"), ("c", "S2", "ao-2", wk(0, 2), 0, "r1", "UC"),
        # D: last post 10 weeks ago -> beyond the reminder window, no list
        ("d", "S2", "ao-2", wk(10), 0, "r1", "UD"),
        # E: last post 3 weeks ago, never led -> only in the lapsed posters (lists are disjoint)
        ("e", "S3", "ao-3", wk(3), 0, "r1", "UE"),
    ]
    fact = spark.createDataFrame(rows, FACT)
    config = spark.createDataFrame([("r1", "CFULL", 2, 2, 4, 2, 52)], CFG)
    aos = spark.createDataFrame(
        [("r1", "S1", "ao-1", "UL1"), ("r1", "S1", "ao-1", "UL1b"), ("r1", "S2", "ao-2", "UL2"), ("r1", "S3", "ao-3", None)],
        "region string, channel_id string, ao string, site_q_user_id string",
    )
    leads = L.site_leads(aos)
    status = L.lapse_status(L.person_activity(fact, config, AS_OF), AS_OF)
    return status, leads, config


def test_lists_and_invariants(inputs):
    activity, leads, _ = inputs
    mia = {r.user_id for r in L.mia(activity, leads).collect()}
    lowq = {r.user_id for r in L.lowq(activity, leads).collect()}
    noq = {r.user_id for r in L.noq(activity, leads).collect()}
    assert mia == {"UA", "UE"}
    assert lowq == {"UB"}
    assert noq == {"UC"}
    assert not (mia & lowq) and not (lowq & noq) and not (mia & noq)


def test_two_leads_repeat_the_person(inputs):
    activity, leads, _ = inputs
    rows = sorted((r.user_id, r.site_q_user_id) for r in L.mia(activity, leads).collect())
    assert rows == [("UA", "UL1"), ("UA", "UL1b"), ("UE", None)]


def test_report_text(inputs):
    activity, leads, config = inputs
    lines = L.report_lines(activity, leads, AS_OF)
    rx = L.report_recipients(lines, config, leads)
    texts = {}
    for r in L.report_text(lines, rx, bot_name="Bot").orderBy(*L.REPORT_ORDER).collect():
        texts[r.recipient] = texts.get(r.recipient, "") + r.text
    assert set(texts) == {"UL1", "UL1b", "UL2", "CFULL"}
    assert texts["UL2"] == (
        "Howdy, <@UL2>! This is your weekly Bot Site Q report. According to my records..."
        "\n\nThese guys have never been Q:\n- <@UC>"
    )
    d = wk(3).strftime("%B %d, %Y")
    assert texts["UL1"] == (
        "Howdy, <@UL1>! This is your weekly Bot Site Q report. According to my records..."
        f"\n\nThe following men haven't posted in a while.\n- <@UA> last posted {d}"
        "\n\nThese guys haven't Q'd in a while. Here's how many days it's been:\n- <@UB>: 21!"
    )
    full = texts["CFULL"]
    assert full.startswith("Howdy, <!channel>!")
    assert full.count("<@UA> last posted") == 2  # the full list keeps the per-lead repeat
    assert full.endswith("this information will have gone out to them as well.")


def test_default_recipient_gets_empty_report_unless_a_lead(spark, inputs):
    activity, leads, _ = inputs
    empty = activity.where("false")
    lines = L.report_lines(empty, leads, AS_OF)
    cfg = spark.createDataFrame([("r1", "UDEF", 2, 2, 4, 2, 52), ("r2", "UL9", 2, 2, 4, 2, 52)], CFG)
    leads2 = leads.unionByName(spark.createDataFrame([("r2", "S9", "ao-9", "UL9")], leads.schema))
    got = L.report_text(lines, L.report_recipients(lines, cfg, leads2)).orderBy(*L.REPORT_ORDER).collect()
    assert [(r.recipient, r.section) for r in got] == [("UDEF", 0), ("UDEF", 4)]
    assert got[1].text.endswith("as well.")


@pytest.mark.parametrize("n", [501, 50_000])
def test_long_lists_have_the_same_shape_and_order(spark, n):
    day = F.date_sub(F.lit(wk(3)), (F.col("id") % 7).cast("int"))
    fact = spark.range(n).select(
        F.format_string("p%d", "id").alias("email"), F.lit("S1").alias("ao_id"), F.lit("ao-1").alias("ao"), day.alias("date"),
        F.lit(1).alias("q_flag"), F.lit("r1").alias("region"), F.format_string("U%06d", "id").alias("user_id"),
    )
    config = spark.createDataFrame([("r1", "UDEF", 2, 2, 4, 2, 52)], CFG)
    leads = L.site_leads(spark.createDataFrame([("r1", "S1", "ao-1", None)], "region string, channel_id string, ao string, site_q_user_id string"))
    act = L.lapse_status(L.person_activity(fact, config, AS_OF), AS_OF)
    lines = L.report_lines(act, leads, AS_OF)
    rows = L.report_text(lines, L.report_recipients(lines, config, leads)).orderBy(*L.REPORT_ORDER).collect()
    assert [(r.section, r.is_line) for r in rows] == [(0, 0), (1, 0)] + [(1, 1)] * n + [(4, 0)]
    want = sorted((i % 7, f"U{i:06d}") for i in range(n))  # latest first, then by person
    assert [r.k2 for r in rows[2:-1]] == [u for _, u in want]


def test_bounded_history_keeps_never_led_exact(spark):
    config = spark.createDataFrame([("r1", "UDEF", 2, 2, 4, 2, 8)], CFG)
    old = AS_OF - dt.timedelta(weeks=100)
    rows = [
        ("a", "S1", "ao-1", old, 1, "r1", "UA"),  # led long ago
        ("a", "S1", "ao-1", wk(3), 0, "r1", "UA"), ("a", "S1", "ao-1", wk(0, 1), 0, "r1", "UA"),
        ("b", "S1", "ao-1", old, 0, "r1", "UB"),  # never led
        ("b", "S1", "ao-1", wk(3), 0, "r1", "UB"), ("b", "S1", "ao-1", wk(0, 1), 0, "r1", "UB"),
    ]
    fact = spark.createDataFrame(rows, FACT)
    full = L.lapse_status(L.person_activity(fact, config, AS_OF), AS_OF)
    since = L.history_start(config, AS_OF)
    assert since == AS_OF - dt.timedelta(weeks=8)
    led = fact.where("q_flag = 1").select("email").distinct()
    recent = fact.where(F.col("date") >= F.lit(since))
    bounded = L.lapse_status(L.person_activity(recent, config, AS_OF, led), AS_OF)
    got_full = sorted((r.user_id, r.status) for r in full.collect())
    got_bounded = sorted((r.user_id, r.status) for r in bounded.collect())
    assert got_full == got_bounded == [("UA", None), ("UB", "noq")]
