"""Inactivity ("lapsed") report (U26-U31), all regions in one plan.

Per-region thresholds are columns of the region config (joined by region;
Spark broadcasts it only when its measured size allows), never Python values
in a driver loop. Every person is reduced to one row by a single aggregate
(last post, last lead, leads total, any post in the no-lead window) and the
home site is joined onto that row; one status column then says which list
the person is on, so the three lists and the report lines come from one pass
over per-person rows. A report is a set of ordered rows (``REPORT_ORDER``),
the same at every size, so no recipient's lines meet in one row or task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.constants import (
    REPORT_DATE_FORMAT,
    REPORT_DEFAULT_NOTE,
    REPORT_HEADER,
    REPORT_LOWQ_HEADER,
    REPORT_LOWQ_LINE,
    REPORT_MIA_HEADER,
    REPORT_MIA_LINE,
    REPORT_NOQ_HEADER,
    REPORT_NOQ_LINE,
)
from rollcall.functions import periods
from rollcall.functions.text import fill, mention_target
from rollcall.operators.home import number_of, numbered, packed
from rollcall.operators.notify import DEFAULT_BOT_NAME

THRESHOLD_COLUMNS = (
    "NO_POST_THRESHOLD",
    "NO_Q_THRESHOLD_WEEKS",
    "REMINDER_WEEKS",
    "NO_Q_THRESHOLD_POSTS",
    "HOME_AO_CAPTURE",
)


def site_leads(aos: DataFrame) -> DataFrame:
    """SRC8/F16: (region, home_ao, ao, site_q_user_id) for sites with a lead."""
    return aos.where(F.col("site_q_user_id").isNotNull()).select(
        "region", F.col("channel_id").alias("home_ao"), "ao", "site_q_user_id"
    )


def with_thresholds(fact: DataFrame, config: DataFrame) -> DataFrame:
    """SRC9: attach each region's thresholds (weeks); regions without config are not reported."""
    return fact.join(config.select("region", *THRESHOLD_COLUMNS), "region")


def home_sites(fact: DataFrame, config: DataFrame, as_of: _dt.date | str, sites: DataFrame | None = None) -> DataFrame:
    """Each person's most-posted site in the last HOME_AO_CAPTURE weeks (strictly after).

    Posts per person and site, then the maximum of (posts, site) per person as a
    packed long (``home.packed``), a hash aggregate; ties go to the larger site id.
    ``sites`` (region, ao_id) lists the sites, if the caller has such a table;
    else they are taken from the fact. Columns: region, email, home_ao.
    """
    f = with_thresholds(fact, config)
    recent = f.where(F.col("date") > periods.weeks_before(as_of, F.col("HOME_AO_CAPTURE")))
    per_site = recent.groupBy("region", "email", "ao_id").agg(F.count("ao").alias("n"))
    no = numbered(fact if sites is None else sites, "ao_id", within="region")
    best = per_site.join(no, ["region", "ao_id"]).groupBy("region", "email").agg(F.max(packed("n")).alias("v"))
    return best.withColumn("no", number_of("v")).join(no, ["region", "no"]).select("region", "email", F.col("ao_id").alias("home_ao"))


def home_site(fact: DataFrame, config: DataFrame, as_of: _dt.date | str) -> DataFrame:
    """J9 as a post-level join: the fact with thresholds and ``home_ao``; people without a recent post drop out.

    The report itself joins the home site onto per-person rows (``person_activity``).
    """
    return with_thresholds(fact, config).join(home_sites(fact, config, as_of), ["region", "email"])


def history_start(config: DataFrame, as_of: _dt.date | str) -> _dt.date:
    """Earliest date any region's report thresholds look at (the longest threshold, in weeks).

    One scalar read from the (small) region config.
    """
    longest = config.select(F.greatest(*[F.max(c) for c in THRESHOLD_COLUMNS]).alias("w")).first()["w"] or 0
    return periods.to_pydate(as_of) - _dt.timedelta(weeks=int(longest))


def person_activity(
    fact: DataFrame, config: DataFrame, as_of: _dt.date | str, ever_led: DataFrame | None = None, sites: DataFrame | None = None
) -> DataFrame:
    """One row per (region, email, user_id, home_ao): last post, last lead, lead total, post in no-lead window.

    The per-person counters are aggregated straight from the posts (partial
    aggregation: a very active person costs one row per map task) and the
    home site is joined onto them afterwards, person to person (J9), instead
    of joining every post to its person's home site first. People without a
    recent post have no home site and drop out, as with the source's inner join.

    ``fact`` may be limited to the recent weeks (``history_start``) when
    ``ever_led`` (emails that ever led, from ``facts.ever_led``) is given: the
    last post, last lead, no-lead window and home site only look that far
    back, and "never led" is then taken from ``ever_led``.
    """
    f = with_thresholds(fact, config)
    noq_lo = periods.weeks_before(as_of, F.col("REMINDER_WEEKS"))
    noq_hi = periods.weeks_before(as_of, F.col("NO_Q_THRESHOLD_WEEKS"))
    act = f.groupBy("region", "email", "user_id", *THRESHOLD_COLUMNS).agg(
        F.max("date").alias("last_post"),
        F.max(F.when(F.col("q_flag") == 1, F.col("date"))).alias("last_q"),
        F.sum("q_flag").alias("q_total"),
        F.max(F.col("date").between(noq_lo, noq_hi)).alias("noq_window_post"),
    )
    if ever_led is not None:
        led = ever_led.select("email", F.lit(1).cast("long").alias("led"))
        act = act.join(led, "email", "left").withColumn(
            "q_total", F.col("q_total") + F.coalesce(F.col("led"), F.lit(0))
        ).drop("led")
    return act.join(home_sites(fact, config, as_of, sites), ["region", "email"])


def _lead_join(people: DataFrame, leads: DataFrame) -> DataFrame:
    """Left join on (region, home_ao); a site with several leads repeats the person."""
    return people.join(leads, ["region", "home_ao"], "left")


def _weeks(as_of, far: str, near: str) -> tuple[Column, Column]:
    return periods.weeks_before(as_of, F.col(far)), periods.weeks_before(as_of, F.col(near))


def lapse_status(activity: DataFrame, as_of: _dt.date | str) -> DataFrame:
    """Which list (if any) each person is on: 'mia', 'lowq' or 'noq'.

    * mia  (U27): last post between REMINDER_WEEKS and NO_POST_THRESHOLD weeks ago (inclusive);
    * lowq (U28): last lead between REMINDER_WEEKS and NO_Q_THRESHOLD_POSTS weeks ago, minus MIA user ids;
    * noq  (U29): never led and a post between REMINDER_WEEKS and NO_Q_THRESHOLD_WEEKS weeks ago,
      minus MIA and low-lead user ids.
    The source removes people by user id across the region (J11/SET3); the
    same is done with a window over (region, user_id) on per-person rows (one
    row per account), instead of repeated anti joins.
    Columns: region, email, user_id, home_ao, last_post, last_q, status.
    """
    mia_lo, mia_hi = _weeks(as_of, "REMINDER_WEEKS", "NO_POST_THRESHOLD")
    low_lo, low_hi = _weeks(as_of, "REMINDER_WEEKS", "NO_Q_THRESHOLD_POSTS")
    mia_hit = F.coalesce(F.col("last_post").between(mia_lo, mia_hi), F.lit(False))
    low_hit = F.coalesce(F.col("last_q").between(low_lo, low_hi), F.lit(False))
    noq_hit = F.coalesce((F.col("q_total") == 0) & F.col("noq_window_post"), F.lit(False))
    account = Window.partitionBy("region", "user_id")
    flagged = activity.select(
        "region", "email", "user_id", "home_ao", "last_post", "last_q",
        mia_hit.alias("mia_hit"), low_hit.alias("low_hit"), noq_hit.alias("noq_hit"),
    )
    user_mia = F.max("mia_hit").over(account)
    user_low = F.max("low_hit").over(account)
    status = (
        F.when(F.col("mia_hit"), F.lit("mia"))
        .when(F.col("low_hit") & ~user_mia, F.lit("lowq"))
        .when(F.col("noq_hit") & ~user_mia & ~user_low, F.lit("noq"))
    )
    return flagged.select("region", "email", "user_id", "home_ao", "last_post", "last_q", status.alias("status"))


def mia(status: DataFrame, leads: DataFrame) -> DataFrame:
    """U27 list. Columns: region, home_ao, user_id, date, ao, site_q_user_id."""
    people = status.where(F.col("status") == "mia").select("region", "home_ao", "user_id", F.col("last_post").alias("date"))
    return _lead_join(people, leads)


def lowq(status: DataFrame, leads: DataFrame) -> DataFrame:
    """U28 list. Columns: region, home_ao, user_id, date, ao, site_q_user_id."""
    people = status.where(F.col("status") == "lowq").select("region", "home_ao", "user_id", F.col("last_q").alias("date"))
    return _lead_join(people, leads)


def noq(status: DataFrame, leads: DataFrame) -> DataFrame:
    """U29/A7 list. Columns: region, home_ao, user_id, ao, site_q_user_id."""
    people = status.where(F.col("status") == "noq").select("region", "home_ao", "user_id")
    return _lead_join(people, leads)


# ---------------------------------------------------------------------------
# report text
# ---------------------------------------------------------------------------

def report_lines(status: DataFrame, leads: DataFrame, as_of: _dt.date | str) -> DataFrame:
    """One row per report line, all three lists in one pass: (region, site_q_user_id, user_id, section, k1, k2, line).

    Sections: 1 lapsed posters (latest first), 2 lapsed leaders (fewest days
    first), 3 never led (by user id). ``k1``/``k2`` sort lines within a section.
    """
    people = status.where(F.col("status").isNotNull())
    rows = _lead_join(people, leads)
    st = F.col("status")
    section = F.when(st == "mia", F.lit(1)).when(st == "lowq", F.lit(2)).otherwise(F.lit(3))
    date = F.when(st == "mia", F.col("last_post")).when(st == "lowq", F.col("last_q"))
    day0 = F.lit(_dt.date(1970, 1, 1))
    days = F.datediff(periods.as_date(as_of), date)
    k1 = F.when(st == "mia", -F.datediff(date, day0)).when(st == "lowq", days).otherwise(F.lit(0)).cast("long")
    line = (
        F.when(st == "mia", fill(REPORT_MIA_LINE, user=F.col("user_id"), date=F.date_format(date, REPORT_DATE_FORMAT)))
        .when(st == "lowq", fill(REPORT_LOWQ_LINE, user=F.col("user_id"), days=days))
        .otherwise(fill(REPORT_NOQ_LINE, user=F.col("user_id")))
    )
    return rows.select(
        "region", "site_q_user_id", "user_id", section.alias("section"), k1.alias("k1"),
        F.col("user_id").alias("k2"), line.alias("line"),
    )


def report_recipients(lines: DataFrame, config: DataFrame, leads: DataFrame) -> DataFrame:
    """Who gets a report.

    * every site lead with at least one line for one of their sites (one report per lead);
    * the region's default recipient with the full list, even when empty, unless
      the default recipient is one of the region's site leads.
    Columns: region, recipient, is_default.
    """
    lead_rx = (
        lines.where(F.col("site_q_user_id").isNotNull())
        .select("region", F.col("site_q_user_id").alias("recipient"))
        .distinct()
        .withColumn("is_default", F.lit(False))
    )
    all_leads = leads.select("region", F.col("site_q_user_id").alias("recipient"))
    default_rx = (
        config.where(F.col("default_siteq").isNotNull())
        .select("region", F.col("default_siteq").alias("recipient"))
        .join(all_leads, ["region", "recipient"], "left_anti")
        .withColumn("is_default", F.lit(True))
    )
    return lead_rx.unionByName(default_rx)


#: Order of the rows of one recipient's report; their texts joined in this order are the message.
REPORT_ORDER = ("section", "is_line", "k1", "k2", "text")


def report_text(lines: DataFrame, recipients: DataFrame, bot_name: str = DEFAULT_BOT_NAME) -> DataFrame:
    """The report of each recipient as ordered rows, the same at every size.

    A lead's report holds the lines of their sites; a default report holds
    every line of the region. Header (section 0), section titles, lines and
    the default note (section 4) are rows; sorted by ``REPORT_ORDER`` and
    joined they are the source's text. No recipient's lines meet in one row or task.
    Columns: region, recipient, section, is_line, k1, k2, text.
    """
    # each line goes to its site lead and, if the region has one, to the default recipient:
    # one pass over the lines (the per-region default table is one row per region)
    defaults = recipients.where(F.col("is_default")).select("region", F.col("recipient").alias("default_rx"))
    lead = F.when(F.col("site_q_user_id").isNotNull(), F.col("site_q_user_id"))
    sent = lines.join(defaults, "region", "left").withColumn("recipient", F.explode(F.array_compact(F.array(lead, "default_rx"))))

    def fixed(rows: DataFrame, section: Column, text: Column) -> DataFrame:
        return rows.select(
            "region", "recipient", section.cast("int").alias("section"), F.lit(0).alias("is_line"),
            F.lit(0).cast("long").alias("k1"), F.lit("").alias("k2"), text.alias("text"),
        )

    header = fill(REPORT_HEADER, target=mention_target(F.col("recipient")), bot=bot_name)
    titles = {1: REPORT_MIA_HEADER, 2: REPORT_LOWQ_HEADER, 3: REPORT_NOQ_HEADER}
    title = F.coalesce(*[F.when(F.col("section") == no, F.lit(text)) for no, text in titles.items()])
    body = sent.select(
        "region", "recipient", F.col("section").cast("int").alias("section"), F.lit(1).alias("is_line"),
        F.col("k1").cast("long").alias("k1"), "k2", F.col("line").alias("text"),
    )
    return (
        fixed(recipients, F.lit(0), header)
        .unionByName(fixed(sent.select("region", "recipient", "section").distinct(), F.col("section"), title))
        .unionByName(body)
        .unionByName(fixed(recipients.where("is_default"), F.lit(4), F.lit(REPORT_DEFAULT_NOTE)))
    )
