"""End-to-end jobs: the award run, the inactivity report and the photo archive.

Each job is one Spark plan over all regions, parameterised by an explicit
run date. Writes come before notifications: the new awards are materialised
as a Parquet table under the reliable checkpoint directory (the shared folder
named by ``spark.checkpoint.dir``), appended to the award table, and the
messages are derived from the materialised rows, so a rerun on the same date
adds nothing and a lost executor never re-reads a table the job has already
appended to. Large intermediates read by several branches (the shared
national join, the per-person report status) are staged the same way.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.constants import (
    EXCLUDED_REGIONS_AWARDS,
    EXCLUDED_REGIONS_FACT,
    EXCLUDED_REGIONS_REPORT,
    REPORT_LOG_MESSAGE,
)
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
from rollcall.session import stage_table
from rollcall.sources.tables import path_exists, region_list, restrict_regions


@dataclass
class AttendanceTables:
    """The four region tables, each with a ``region`` column."""

    users: DataFrame
    attendance: DataFrame
    beatdowns: DataFrame
    aos: DataFrame

    def restricted(self, regions: DataFrame | None, exclude: Sequence[str]) -> AttendanceTables:
        return AttendanceTables(
            *(restrict_regions(t, regions, exclude) for t in (self.users, self.attendance, self.beatdowns, self.aos))
        )

    def as_tuple(self):
        return self.users, self.attendance, self.beatdowns, self.aos


def _notes(df: DataFrame, kind: str) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "region", "target", "text")


def award_notes(messages: DataFrame, summary: DataFrame, as_of: _dt.date | str) -> DataFrame:
    """SNK6 rows of an award run: kind, region, target, text, run_date."""
    notes = _notes(messages, "award").unionByName(_notes(summary, "award_summary"))
    return notes.withColumn("run_date", periods.as_date(periods.to_pydate(as_of)))


def award_run(
    tables: AttendanceTables,
    region_config: DataFrame,
    award_list: DataFrame,
    awarded: DataFrame,
    as_of: _dt.date | str,
    region_names: DataFrame | None = None,
    specs: Sequence[A.AwardSpec] = A.DEFAULT_AWARDS,
    awarded_table: str | None = None,
    awarded_path: str | None = None,
    notifications_path: str | None = None,
    bot_name: str = N.DEFAULT_BOT_NAME,
    share_event_join: bool = True,
    qsource: Column | None = None,
    workout: Column | None = None,
) -> dict[str, DataFrame]:
    """Entry 1: compute, record and announce new awards for every region.

    ``region_names`` is the region list (``schema_name``); it is filtered with
    ``LIKE 'f3%'``. With ``share_event_join`` the national event join runs once
    for both the home region and the award fact. ``qsource`` / ``workout``
    replace the event classifiers (expressions over ``backblast`` and ``ao``; NULL
    counts as not passing); events are classified before the attendance is
    joined. Returns the new awards, notifications and run summary.
    """
    regions = region_list(region_names) if region_names is not None else None
    t = tables.restricted(regions, EXCLUDED_REGIONS_FACT)
    # look-backs reach into the previous year; nothing older can count
    since = H.lookback_start(as_of)
    if share_event_join:
        # one national join for both facts, materialised once: J1 rows feed the
        # home region, J2 rows the awards
        events = stage_table(Fa.event_posts(*t.as_tuple(), since=since, qsource=qsource, workout=workout), "award_events")
        home = H.pick_home_region(H.home_region_counts(Fa.q_attendance(events), as_of), t.aos)
    else:
        home = H.pick_home_region(H.home_region_counts(Fa.attendance_fact(*t.as_tuple(), since=since), as_of), t.aos)
        year_start = periods.to_pydate(as_of).replace(month=1, day=1)
        events = Fa.event_posts(*t.as_tuple(), since=year_start, qsource=qsource, workout=workout)
    posts = Fa.valid_posts(events, as_of, current_year=True)
    # J4 after aggregation: counters per email, home region joined onto them
    earned = A.earned_awards_by_home(posts, home, specs)
    earned_pax = D.attach_pax_id(earned, tables.users)

    if "run_date" not in awarded.columns:  # a history from elsewhere: no run of ours recorded it
        awarded = awarded.withColumn("run_date", F.lit(None).cast("date"))
    history = D.award_history(awarded, award_list, as_of)
    eligible = D.eligible_regions(region_config, award_list, EXCLUDED_REGIONS_AWARDS)
    if regions is not None:
        eligible = eligible.join(regions, "region", "left_semi")
    # materialise before appending: neither the append nor the messages may re-read the table it extends
    new = stage_table(D.new_awards(earned_pax, history, award_list, eligible, specs), "new_awards")
    # awards recorded by an earlier attempt at this run date are announced again with the new ones,
    # so that an attempt that failed between the two writes loses no message
    run_date = periods.to_pydate(as_of)
    own = F.coalesce(F.col("run_date") == F.lit(run_date), F.lit(False))
    prior = stage_table(D.award_counts(history.where(~own)), "prior_awards")
    again = history.where(own).join(eligible.select("region"), "region", "left_semi")
    run = stage_table(new.unionByName(D.recorded_awards(again, specs)), "run_awards")

    if (awarded_table is not None or awarded_path is not None) and not new.isEmpty():
        fresh = K.awarded_rows(new)
        kept = awarded.where(own).select(*fresh.columns)
        K.record_run(stage_table(kept.unionByName(fresh), "recorded"), as_of, table=awarded_table, path=awarded_path)

    ordinals = D.award_ordinals(run, prior)
    messages = N.award_messages(ordinals, award_list, eligible)
    summary = N.run_summary(run, eligible, N.log_channels(tables.aos), bot_name)
    notes = award_notes(messages, summary, as_of)
    if notifications_path is not None:
        K.append_notifications(notes, notifications_path, replace_run=True)
    return {"new_awards": new, "messages": messages, "summary": summary, "notifications": notes}


def report_run(
    tables: AttendanceTables,
    region_config: DataFrame,
    as_of: _dt.date | str,
    region_names: DataFrame | None = None,
    notifications_path: str | None = None,
    bot_name: str = N.DEFAULT_BOT_NAME,
    share_event_join: bool = False,
    bounded_history: bool = True,
    led_state_path: str | None = None,
    changed_months: Sequence[_dt.date] | None = None,
) -> dict[str, DataFrame]:
    """Entry 2: the weekly inactivity report for every region.

    The post fact spans all history while the home region needs only the
    current year and the look-backs, so by default the two national joins run
    separately (the home-region one reads ~16 months, pruned in both scans)
    instead of staging the all-history join; ``share_event_join=True`` stages
    one all-history join for both (equal results, tested).

    With ``bounded_history`` (default) the post fact is read only back to the
    longest threshold of any region (``lapse.history_start``) and "never led"
    comes from a leaders-only join over all history (``facts.ever_led``),
    instead of carrying every post of all time through the national join, the
    home-region join and the per-person aggregates (equal results, tested).

    ``led_state_path`` keeps "never led" in a table by month (``led_state``):
    the run refreshes ``changed_months`` (months with new, late or corrected
    rows) and reads no other month of the tables for it. Without a table at
    the path, or without ``changed_months``, it is built from all history.
    """
    regions = region_list(region_names) if region_names is not None else None
    t = tables.restricted(regions, EXCLUDED_REGIONS_REPORT)
    if share_event_join:
        # the report reads all history anyway: one join, materialised once, feeds both facts
        events = stage_table(
            Fa.event_posts(*t.as_tuple(), exclude=EXCLUDED_REGIONS_REPORT), "report_events"
        )
        counts = H.home_region_counts_by_user(Fa.q_attendance(events), as_of)
        posts = Fa.valid_posts(events, as_of, current_year=False)
    else:
        counts = H.home_region_counts_by_user(
            Fa.attendance_fact(*t.as_tuple(), exclude=EXCLUDED_REGIONS_REPORT, since=H.lookback_start(as_of)), as_of
        )
        since = L.history_start(region_config, as_of) if bounded_history else None
        posts = Fa.post_fact(
            *t.as_tuple(), as_of=as_of, current_year=False, exclude=EXCLUDED_REGIONS_REPORT, since=since
        )
    # one row per person, staged: the post-level join below then has plain shuffles on
    # both sides, so AQE can split a very active person's posts over several tasks
    home = stage_table(H.pick_home_region(counts, t.aos), "report_home")
    fact = Fa.attach_home_region(posts, home, with_user=True)
    config = region_config if regions is None else region_config.join(regions, "region", "left_semi")
    leads = L.site_leads(t.aos)
    sites = t.aos.select("region", F.col("channel_id").alias("ao_id"))
    # one row per person with its list; read by the three lists and the report
    led = None
    if led_state_path is not None and bounded_history and not share_event_join:
        past = t.attendance, t.beatdowns, t.aos
        if changed_months is None or not path_exists(t.users.sparkSession, led_state_path):
            S.rebuild(*past, led_state_path, exclude=EXCLUDED_REGIONS_REPORT)
        else:
            S.refresh(*past, led_state_path, changed_months, exclude=EXCLUDED_REGIONS_REPORT)
        led = S.ever_led(t.users.sparkSession, led_state_path, t.users, as_of)
    elif bounded_history and not share_event_join:
        led = Fa.ever_led(*t.as_tuple(), as_of=as_of, exclude=EXCLUDED_REGIONS_REPORT)
    status = stage_table(L.lapse_status(L.person_activity(fact, config, as_of, led, sites), as_of), "report_status")
    mia = L.mia(status, leads)
    lowq = L.lowq(status, leads)
    noq = L.noq(status, leads)
    lines = L.report_lines(status, leads, as_of)
    recipients = L.report_recipients(lines, config, leads)
    text = L.report_text(lines, recipients, bot_name)
    logs = N.log_channels(t.aos)
    log_rows = config.select("region").join(logs, "region", "left").select(
        "region", F.col("log_channel").alias("target"), F.lit(REPORT_LOG_MESSAGE).alias("text")
    )
    notes = (
        text.withColumn("kind", F.lit("report")).withColumnRenamed("recipient", "target")
        .unionByName(_notes(log_rows, "report_log"), allowMissingColumns=True)
        .withColumn("run_date", periods.as_date(periods.to_pydate(as_of)))
    )
    if notifications_path is not None:
        K.append_notifications(notes, notifications_path, replace_run=True)
    return {"mia": mia, "lowq": lowq, "noq": noq, "report": text, "notifications": notes}


def photo_run(
    messages: DataFrame,
    members: DataFrame,
    contents: DataFrame,
    as_of: _dt.date | str,
    seen_path: str | None = None,
    manifest_path: str | None = None,
) -> dict[str, DataFrame]:
    """Entry 4: the previous month's photo manifest and its checksums, idempotent per month.

    Both outputs are partitioned by the archived month and written with
    dynamic partition overwrite; duplicates are judged against the checksums
    of *other* months. A rerun for the same month (after a failure between
    the two writes, or on purpose) replaces that month instead of appending
    twice or finding everything already seen.
    """
    spark = messages.sparkSession
    start, _end = periods.previous_month_bounds(as_of)
    month = f"{start.year:04d}-{start.month:02d}"
    seen = None
    if seen_path is not None:
        if path_exists(spark, seen_path):  # else the first run: no state yet
            seen = spark.read.parquet(seen_path).where(F.col("month") != month)
    flat = P.flatten_files(P.in_previous_month(messages, as_of))
    manifest = stage_table(
        P.photo_manifest(P.dedup_photos(P.photo_rows(flat, members), contents, seen)).withColumn("month", F.lit(month)),
        "photo_manifest",
    )
    if manifest_path is not None:
        _overwrite_month(manifest, manifest_path)
    if seen_path is not None:
        _overwrite_month(P.new_checksums(manifest).withColumn("month", F.lit(month)), seen_path)
    return {"manifest": manifest}


def _overwrite_month(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def catalogue_setup(
    spark,
    regions: DataFrame,
    database: str | None = None,
    location: str | None = None,
    users_table: str | None = None,
    aos_table: str | None = None,
) -> None:
    """Entry 3: award tables, seed lists for new regions, the site-lead column and the trophy view (idempotent).

    ``users_table`` and ``aos_table`` are catalog tables (default: ``users`` and
    ``aos`` of ``database`` where they exist); without them the steps that need them are left out.
    """
    K.create_tables(spark, database, location)
    prefix = f"{database}." if database else ""
    K.seed_missing_lists(spark, regions, prefix + K.LIST_TABLE)

    def given(name: str | None, default: str) -> str | None:
        if name is not None:
            return name
        return prefix + default if database and spark.catalog.tableExists(prefix + default) else None

    users_table, aos_table = given(users_table, "users"), given(aos_table, "aos")
    if aos_table is not None:
        K.ensure_site_lead_column(spark, aos_table)
    if users_table is not None:
        _lst, _awarded, name = K.award_tables(spark, database)
        K.create_trophy_view(spark, users_table, name, prefix + K.LIST_TABLE, prefix + K.VIEW_NAME)
