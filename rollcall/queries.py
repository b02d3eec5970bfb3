"""Registered queries: adapter (driver tables) + library operator, one per inventory item.

Each function takes (spark, sf_dir) and returns a lazy DataFrame whose column
names match the DuckDB oracle in ``rollcall.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.constants import EXCLUDED_REGIONS_FACT
from rollcall.functions import classify as C
from rollcall.functions import periods
from rollcall.operators import awards as A
from rollcall.operators import catalog as K
from rollcall.operators import diff as D
from rollcall.operators import facts as Fa
from rollcall.operators import home as H
from rollcall.operators import lapse as L
from rollcall.operators import led_state as S
from rollcall.operators import notify as N
from rollcall.operators import photos as P
from rollcall.operators import tags as T
from rollcall.plans import jobs as J
from rollcall.session import ensure_checkpoint_dir, stage_table
from rollcall.sources import fixtures as X
from rollcall.sources.tables import region_list

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn

    return deco


# ---------------------------------------------------------------------------
# awards
# ---------------------------------------------------------------------------

def award_fact(spark: SparkSession, sf_dir: str, as_of=X.AWARD_AS_OF) -> DataFrame:
    posts = X.award_posts(spark, sf_dir)
    return posts.where(periods.in_year_of("date", as_of) & periods.not_after("date", as_of))


def driver_specs(ids=None):
    return A.award_specs(X.DRIVER_THRESHOLDS, ids)


@register("awards_all")
def awards_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.earned_awards(award_fact(spark, sf_dir), driver_specs())


def _single_award(award_id: int) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.earned_awards(award_fact(spark, sf_dir), driver_specs([award_id]))

    return q


AWARD_QUERY_NAMES = {
    1: "award_priest",
    2: "award_monk",
    3: "award_leader_of_men",
    4: "award_boss",
    5: "award_hammer",
    6: "award_cadre",
    7: "award_el_presidente",
    8: "award_posts_tier1",
    9: "award_posts_tier2",
    10: "award_posts_tier3",
    11: "award_posts_tier4",
    12: "award_posts_tier5",
    13: "award_six_pack",
    14: "award_hdtf",
}
for _aid, _name in AWARD_QUERY_NAMES.items():
    register(_name)(_single_award(_aid))


@register("award_posts")
def award_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.yearly_posts(award_fact(spark, sf_dir)).select(
        F.col("year").cast("int").alias("year"), "email", "region", "n_posts", "last_date"
    )


# ---------------------------------------------------------------------------
# national fact, classifier, home region
# ---------------------------------------------------------------------------

def normalised(spark: SparkSession, sf_dir: str):
    return (
        X.normalised_users(spark, sf_dir),
        X.normalised_attendance(spark, sf_dir),
        X.normalised_beatdowns(spark, sf_dir),
        X.normalised_aos(spark, sf_dir),
    )


@register("post_fact_normalised")
def post_fact_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fa.attendance_fact(*normalised(spark, sf_dir))


@register("post_fact")
def post_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fa.post_fact(*normalised(spark, sf_dir), as_of=X.FACT_AS_OF, current_year=True)


@register("post_fact_coq")
def post_fact_coq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fa.post_fact(*normalised(spark, sf_dir), as_of=X.FACT_AS_OF, current_year=False)


@register("classify_posts")
def classify_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = X.award_posts(spark, sf_dir)
    return posts.select("email", "region", "ao_id", "date", "q_flag", C.event_class("backblast", "ao").alias("event_class"))


@register("home_region_counts")
def home_region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.home_region_counts(X.home_attendance(spark, sf_dir), X.HOME_AS_OF)


@register("home_region")
def home_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.pick_home_region(home_region_counts(spark, sf_dir), X.regions(spark, sf_dir))


@register("home_region_by_user")
def home_region_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.home_region_counts_by_user(X.home_attendance(spark, sf_dir), X.HOME_AS_OF)


@register("home_region_user_pick")
def home_region_user_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.pick_home_region(home_region_by_user(spark, sf_dir), X.regions(spark, sf_dir))


def national_posts_and_home(spark: SparkSession, sf_dir: str, as_of=X.FACT_AS_OF):
    """U5 + U1-U4 on the normalised tables: the year's posts and every person's home region, from one national join."""
    events = stage_table(Fa.event_posts(*normalised(spark, sf_dir), since=H.lookback_start(as_of)), "national_events")
    home = H.pick_home_region(H.home_region_counts(Fa.q_attendance(events), as_of), X.regions(spark, sf_dir))
    return Fa.valid_posts(events, as_of, current_year=True), home


@register("awards_national")
def awards_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, home = national_posts_and_home(spark, sf_dir)
    return A.earned_awards_by_home(posts, home, driver_specs())


@register("awards_region_users")
def awards_region_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    earned = awards_all(spark, sf_dir)
    return D.attach_pax_id(earned, X.award_users(spark, sf_dir))


# ---------------------------------------------------------------------------
# award diff, counters, messages
# ---------------------------------------------------------------------------

def _award_inputs(spark: SparkSession, sf_dir: str):
    lst = X.achievements_list(spark, sf_dir)
    history = D.award_history(X.award_history_table(spark, sf_dir), lst, X.AWARD_AS_OF)
    regions = D.eligible_regions(X.region_config(spark, sf_dir), lst)
    return lst, history, regions


@register("award_history")
def award_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    _lst, history, _regions = _award_inputs(spark, sf_dir)
    return history.select("region", "achievement_id", "pax_id", "date_awarded", "code")


@register("awards_new")
def awards_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    _lst, history, _regions = _award_inputs(spark, sf_dir)
    return D.unseen_awards(awards_region_users(spark, sf_dir), history, driver_specs())


def _new_awards(spark: SparkSession, sf_dir: str):
    lst, history, regions = _award_inputs(spark, sf_dir)
    new = D.new_awards(awards_region_users(spark, sf_dir), history, lst, regions, driver_specs())
    return new, lst, history, regions


@register("awards_eligible")
def awards_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, *_ = _new_awards(spark, sf_dir)
    return D.upload_rows(new)


@register("award_counts")
def award_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _lst, history, _regions = _award_inputs(spark, sf_dir)
    return D.award_counts(history)


@register("award_ordinals")
def award_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lst, history, regions = _award_inputs(spark, sf_dir)
    return D.new_award_ordinals(awards_region_users(spark, sf_dir), history, lst, regions, driver_specs())


@register("award_messages")
def award_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lst, history, regions = _award_inputs(spark, sf_dir)
    ordinals = D.new_award_ordinals(awards_region_users(spark, sf_dir), history, lst, regions, driver_specs())
    return N.award_messages(ordinals, lst, regions)


@register("run_summary")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, _lst, _history, regions = _new_awards(spark, sf_dir)
    return N.run_summary(new, regions, N.log_channels(X.award_aos(spark, sf_dir)))


# ---------------------------------------------------------------------------
# inactivity report
# ---------------------------------------------------------------------------

def _report_inputs(spark: SparkSession, sf_dir: str):
    fact = X.report_fact(spark, sf_dir)
    config = X.region_config(spark, sf_dir)
    leads = L.site_leads(X.report_aos(spark, sf_dir))
    activity = L.person_activity(fact, config, X.REPORT_AS_OF)
    return config, leads, L.lapse_status(activity, X.REPORT_AS_OF)


@register("home_site")
def home_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.home_sites(X.report_fact(spark, sf_dir), X.region_config(spark, sf_dir), X.REPORT_AS_OF)


@register("report_mia")
def report_mia(spark: SparkSession, sf_dir: str) -> DataFrame:
    _c, leads, status = _report_inputs(spark, sf_dir)
    return L.mia(status, leads)


@register("report_lowq")
def report_lowq(spark: SparkSession, sf_dir: str) -> DataFrame:
    _c, leads, status = _report_inputs(spark, sf_dir)
    return L.lowq(status, leads)


@register("report_noq")
def report_noq(spark: SparkSession, sf_dir: str) -> DataFrame:
    _c, leads, status = _report_inputs(spark, sf_dir)
    return L.noq(status, leads)


def _report_lines(spark: SparkSession, sf_dir: str):
    config, leads, status = _report_inputs(spark, sf_dir)
    # one row per person, read by the lines of every section and recipient
    status = stage_table(status, "report_status")
    return L.report_lines(status, leads, X.REPORT_AS_OF), config, leads


@register("report_recipients")
def report_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, config, leads = _report_lines(spark, sf_dir)
    return L.report_recipients(lines, config, leads)


@register("report_text")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, config, leads = _report_lines(spark, sf_dir)
    return L.report_text(lines, L.report_recipients(lines, config, leads))


# ---------------------------------------------------------------------------
# photo archive
# ---------------------------------------------------------------------------

@register("message_files")
def message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.flatten_files(X.photo_messages(X.photo_base(spark, sf_dir)))


def _photo_rows(base: DataFrame) -> DataFrame:
    month = P.in_previous_month(X.photo_messages(base), X.PHOTO_AS_OF)
    return P.photo_rows(P.flatten_files(month), X.photo_members(base))


@register("photo_rows")
def photo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _photo_rows(stage_table(X.photo_base(spark, sf_dir), "photo_base"))


@register("photo_dedup")
def photo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the export is read once; messages, members, file bytes and the seen checksums come from that copy
    base = stage_table(X.photo_base(spark, sf_dir), "photo_base")
    return P.dedup_photos(_photo_rows(base), X.photo_contents(base), X.photo_seen(base))


@register("photo_manifest")
def photo_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.photo_manifest(photo_dedup(spark, sf_dir))


# ---------------------------------------------------------------------------
# catalogue and manual tags
# ---------------------------------------------------------------------------

@register("trophy_view")
def trophy_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.trophy_view(
        X.award_users(spark, sf_dir), X.award_history_table(spark, sf_dir), X.achievements_list(spark, sf_dir)
    )


@register("manual_tags")
def manual_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, attendance, beatdowns, aos = normalised(spark, sf_dir)
    _posts, home = national_posts_and_home(spark, sf_dir)
    tagged = Fa.post_fact(users, attendance, T.tagged_events(beatdowns), aos, as_of=X.FACT_AS_OF)
    return T.manual_awards(Fa.attach_home_region(tagged, home), X.achievements_list(spark, sf_dir))


@register("report_national")
def report_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report on the normalised tables: J1 by user id -> home -> J2 -> J4 -> report text, as the weekly job runs it."""
    stored = [stage_table(t, "normalised") for t in normalised(spark, sf_dir)]
    return J.report_run(J.AttendanceTables(*stored), X.region_config(spark, sf_dir), X.FACT_AS_OF)["report"]


@register("ever_led")
def ever_led(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails that led (Q or co-Q) at least once up to the run date: the leaders-only join."""
    return Fa.ever_led(*normalised(spark, sf_dir), as_of=X.FACT_AS_OF)


@register("ever_led_state")
def ever_led_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same emails from the state table: half of the history stored first, the rest of its months merged in."""
    users, attendance, beatdowns, aos = (stage_table(t, "normalised") for t in normalised(spark, sf_dir))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/led-state-{uuid.uuid4().hex}"
    before = X.FACT_AS_OF.replace(year=X.FACT_AS_OF.year - 2)
    S.rebuild(attendance.where(F.col("date") <= F.lit(before)), beatdowns, aos, path)
    late = attendance.where((F.col("date") > F.lit(before)) & (F.col("date") <= F.lit(X.FACT_AS_OF)))
    S.refresh(attendance, beatdowns, aos, path, S.months_of(late))
    return S.ever_led(spark, path, users, X.FACT_AS_OF)


# ---------------------------------------------------------------------------
# the league: region list, deny lists, system and nameless accounts, lesson and ruck sites
# ---------------------------------------------------------------------------

def _league(spark: SparkSession, sf_dir: str) -> J.AttendanceTables:
    return J.AttendanceTables(X.league_users(spark, sf_dir), X.league_attendance(spark, sf_dir), X.league_beatdowns(spark, sf_dir), X.league_aos(spark, sf_dir))


@register("league_posts")
def league_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F8: the year's valid posts of the listed regions with their class flags, as the award run joins them."""
    t = _league(spark, sf_dir).restricted(region_list(X.league_regions(spark, sf_dir)), EXCLUDED_REGIONS_FACT)
    return Fa.valid_posts(Fa.event_posts(*t.as_tuple(), since=X.FACT_AS_OF.replace(month=1, day=1)), X.FACT_AS_OF).drop("user_name")


@register("league_home")
def league_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1-U4 over the listed regions; accounts without an email count by the year alone."""
    t = _league(spark, sf_dir).restricted(region_list(X.league_regions(spark, sf_dir)), EXCLUDED_REGIONS_FACT)
    j1 = Fa.attendance_fact(*t.as_tuple(), since=H.lookback_start(X.FACT_AS_OF))
    return H.pick_home_region(H.home_region_counts(j1, X.FACT_AS_OF), t.aos)


@register("league_lists")
def league_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U32: the seed list of every listed region."""
    return K.seed_lists(region_list(X.league_regions(spark, sf_dir)))


def _league_report(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    stored = [stage_table(t, "league") for t in _league(spark, sf_dir).as_tuple()]
    names = X.league_regions(spark, sf_dir)
    return J.report_run(J.AttendanceTables(*stored), X.league_config(spark, sf_dir), X.FACT_AS_OF, region_names=names)


@register("league_noq")
def league_noq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U29 with site leads: never led, a post in the window, neither missing nor lapsed as a leader."""
    return _league_report(spark, sf_dir)["noq"]


@register("league_report")
def league_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the listed regions to leads and default recipients."""
    return _league_report(spark, sf_dir)["report"]


@register("award_notifications")
def award_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6 payload: the award run's outgoing messages as rows."""
    lst, history, regions = _award_inputs(spark, sf_dir)
    ordinals = stage_table(D.new_award_ordinals(awards_region_users(spark, sf_dir), history, lst, regions, driver_specs()), "ordinals")
    summary = N.run_summary(ordinals, regions, N.log_channels(X.award_aos(spark, sf_dir)))
    return J.award_notes(N.award_messages(ordinals, lst, regions), summary, X.AWARD_AS_OF)


@register("award_records")
def award_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1 payload: the rows the award run records, with the number of each row among equal ones instead of its hashed id."""
    new, *_ = _new_awards(spark, sf_dir)
    rows = K.awarded_rows(new).withColumn("run_date", periods.as_date(X.AWARD_AS_OF))
    equal = ["region", "achievement_id", "pax_id", "date_awarded", "run_date"]
    return rows.groupBy(*equal).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))
