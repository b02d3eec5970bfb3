"""Command line for the jobs (``python -m rollcall ...`` or ``spark-submit -m``-style drivers).

Tables are read from a folder of Parquet tables, one sub-folder per logical
table, each region-scoped table with a ``region`` column:

    <tables>/users  bd_attendance  beatdowns  aos  regions  region_config
             achievements_list  achievements_awarded (optional)

``region_config`` may use the source's ``paxminer_schema`` column name for the
region. With ``--by-region`` the four attendance tables are read from
``<tables>/<region>/<table>`` for the regions of ``regions``; a region that
cannot be read is reported and left out. With ``--database`` tables that the catalog's
database has are used instead of folders; awards are then recorded in its
history table. Commands print one JSON line with row counts of what they produced.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.constants import EXCLUDED_REGIONS_FACT
from rollcall.operators import catalog as K
from rollcall.plans import jobs as J
from rollcall.session import SESSION_DEFAULTS, ensure_checkpoint_dir, size_for_input
from rollcall.sources import tables as S


def _session() -> SparkSession:
    builder = SparkSession.builder.appName("rollcall")
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _read(spark: SparkSession, root: str, name: str, schema=None, required: bool = True) -> DataFrame | None:
    path = os.path.join(root, name)
    if not required and not S.path_exists(spark, path):
        return None
    df = spark.read.parquet(path)
    return S.conform(df, schema) if schema is not None else df


def _table(spark: SparkSession, a: argparse.Namespace, name: str, schema=None, required: bool = True) -> DataFrame | None:
    """A logical table: of the catalog's database if it is there, else the folder."""
    if a.database and spark.catalog.tableExists(f"{a.database}.{name}"):
        df = spark.table(f"{a.database}.{name}")
        return S.conform(df, schema) if schema is not None else df
    if not a.tables:
        if required:
            raise ValueError(f"{a.database} has no table {name}, and no --tables folder is given")
        return None
    return _read(spark, a.tables, name, schema, required)


def load_attendance(spark: SparkSession, a: argparse.Namespace) -> tuple[J.AttendanceTables, DataFrame]:
    """The attendance tables, and the region tables that could not be read (region, table, reason)."""
    if a.by_region:
        names = S.region_list(_table(spark, a, "regions"), EXCLUDED_REGIONS_FACT)
        regions = sorted(r["region"] for r in names.distinct().collect())  # one short name a region
        found, failures = S.read_regions(spark, regions, S.parquet_regions(spark, a.tables))
    else:
        found = {t: _table(spark, a, t, getattr(schemas, t.upper())) for t in S.ATTENDANCE_TABLES}
        failures = spark.createDataFrame([], S.FAILURES)
    if a.failures:
        dated = failures.withColumn("run_date", F.lit(a.as_of))
        dated.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(a.failures)
    return J.AttendanceTables(*(found[t] for t in S.ATTENDANCE_TABLES)), failures


def load_config(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    cfg = _table(spark, a, "region_config")
    if "region" not in cfg.columns and "paxminer_schema" in cfg.columns:
        cfg = cfg.withColumnRenamed("paxminer_schema", "region")
    return cfg


def _date(value: str) -> dt.date:
    return dt.date.fromisoformat(value)


def _history(spark: SparkSession, path: str) -> DataFrame:
    """Recorded awards at an existing path; a folder in which no run has recorded any is an empty history, damaged files raise."""
    try:
        return S.conform(spark.read.parquet(path), schemas.AWARDED_BY_RUN)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], schemas.AWARDED_BY_RUN)


def run_award(spark: SparkSession, a: argparse.Namespace) -> dict:
    table = None
    if a.database:
        lst, awarded, table = K.award_tables(spark, a.database)
        awarded = S.conform(awarded, schemas.AWARDED_BY_RUN)
    else:
        lst = _read(spark, a.tables, "achievements_list")
        # one history: what the lake holds and what earlier runs recorded
        own = os.path.join(a.tables, "achievements_awarded")
        paths = dict.fromkeys(p.rstrip("/") for p in (own, a.awarded_path) if p)
        awarded = spark.createDataFrame([], schemas.AWARDED_BY_RUN)
        for path in paths:
            if S.path_exists(spark, path):
                awarded = awarded.unionByName(_history(spark, path))
    tables, failures = load_attendance(spark, a)
    out = J.award_run(
        tables,
        load_config(spark, a),
        lst,
        awarded,
        a.as_of,
        region_names=_table(spark, a, "regions", required=False),
        awarded_table=table,
        awarded_path=None if table else a.awarded_path,
        notifications_path=a.notifications,
        bot_name=a.bot_name,
    )
    return {"new_awards": out["new_awards"].count(), "failed_tables": failures.count()}


def run_report(spark: SparkSession, a: argparse.Namespace) -> dict:
    tables, failures = load_attendance(spark, a)
    out = J.report_run(
        tables,
        load_config(spark, a),
        a.as_of,
        region_names=_table(spark, a, "regions", required=False),
        notifications_path=a.notifications,
        bot_name=a.bot_name,
        led_state_path=a.led_state,
        changed_months=a.changed_months,
    )
    return {"reports": out["report"].where("section = 0").count(), "failed_tables": failures.count()}


def run_photos(spark: SparkSession, a: argparse.Namespace) -> dict:
    images = S.read_image_bytes(spark, a.images)
    out = J.photo_run(
        S.read_messages(spark, a.messages),
        S.read_members(spark, a.members),
        images,
        a.as_of,
        seen_path=a.seen,
        manifest_path=a.manifest,
    )
    return {"photos": out["manifest"].count()}


def run_setup(spark: SparkSession, a: argparse.Namespace) -> dict:
    regions = S.region_list(spark.read.parquet(a.regions))
    J.catalogue_setup(spark, regions, database=a.database, location=a.location, users_table=a.users, aos_table=a.aos)
    return {"regions": regions.count()}


def _months(value: str) -> list[dt.date]:
    return [dt.date.fromisoformat(f"{m}-01") for m in value.split(",") if m]


def _inputs(p: argparse.ArgumentParser) -> None:
    p.add_argument("--tables", help="folder of Parquet tables")
    p.add_argument("--database", help="catalog database whose tables are used where it has them")
    p.add_argument("--by-region", action="store_true", help="attendance tables lie in one folder a region")
    p.add_argument("--failures", help="Parquet folder for the region tables that could not be read, by run date")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rollcall")
    p.add_argument(
        "--input-gb",
        type=float,
        help="size of the largest input table; sizes scan splits and shuffle partitions (see README)",
    )
    sub = p.add_subparsers(dest="command", required=True)
    aw = sub.add_parser("award", help="compute, record and announce new awards")
    _inputs(aw)
    aw.add_argument("--as-of", type=_date, default=dt.date.today())
    aw.add_argument("--awarded-path", help="Parquet award history to read and append to")
    aw.add_argument("--notifications")
    aw.add_argument("--bot-name", default="Rollcall")
    rp = sub.add_parser("report", help="weekly inactivity report")
    _inputs(rp)
    rp.add_argument("--led-state", help="folder of the who-ever-led state, refreshed by the run")
    rp.add_argument("--changed-months", type=_months, help="months (1998-10,1998-11) with new, late or corrected rows; without them the state is rebuilt")
    rp.add_argument("--as-of", type=_date, default=dt.date.today())
    rp.add_argument("--notifications")
    rp.add_argument("--bot-name", default="Rollcall")
    ph = sub.add_parser("photos", help="previous month's photo manifest")
    ph.add_argument("--messages", required=True)
    ph.add_argument("--members", required=True)
    ph.add_argument("--images", required=True)
    ph.add_argument("--as-of", type=_date, default=dt.date.today())
    ph.add_argument("--seen")
    ph.add_argument("--manifest")
    st = sub.add_parser("setup", help="award tables and seed lists")
    st.add_argument("--regions", required=True, help="Parquet region list (schema_name)")
    st.add_argument("--database")
    st.add_argument("--location")
    st.add_argument("--users", help="catalog table of users, for the trophy view")
    st.add_argument("--aos", help="catalog table of sites, which gets the site-lead column")
    return p


COMMANDS = {"award": run_award, "report": run_report, "photos": run_photos, "setup": run_setup}


def main(argv: Sequence[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    if args.command in ("award", "report") and not (args.tables or args.database):
        raise SystemExit("--tables or --database is needed")
    spark = _session()
    if args.input_gb:
        size_for_input(spark, int(args.input_gb * (1 << 30)))
    result = COMMANDS[args.command](spark, args)
    print(json.dumps({"command": args.command, **result}))
    return result
