"""The month-by-month state of who ever led equals the leaders-only join over all history on any run date."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rollcall.operators import facts as Fa
from rollcall.operators import led_state as S
from rollcall.plans import jobs as J
from rollcall.sources import fixtures as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    from rollcall.session import stage_table

    names = (X.normalised_users, X.normalised_attendance, X.normalised_beatdowns, X.normalised_aos)
    return [stage_table(f(spark, SF), "led-test") for f in names]


def emails(df):
    return {r.email for r in df.collect()}


def full(tables, as_of):
    return emails(Fa.ever_led(*tables, as_of=as_of))


@pytest.mark.parametrize("as_of", [dt.date(1992, 1, 1), dt.date(1992, 2, 10), dt.date(1995, 6, 14), dt.date(1998, 10, 31), dt.date(2010, 1, 1)])
def test_rebuilt_state_equals_the_join_on_any_date(spark, stored, tmpdir_path, as_of):
    users, attendance, beatdowns, aos = stored
    path = os.path.join(tmpdir_path, "state")
    S.rebuild(attendance, beatdowns, aos, path)
    assert emails(S.ever_led(spark, path, users, as_of)) == full(stored, as_of)


def test_new_late_corrected_and_deleted_rows(spark, stored, tmpdir_path):
    users, attendance, beatdowns, aos = stored
    path = os.path.join(tmpdir_path, "state")
    cut, as_of = dt.date(1996, 3, 15), dt.date(1996, 8, 1)
    # as of the first run: half of the history, and a tenth of its rows still missing
    missing = F.pmod(F.xxhash64("user_id", "date", "ao_id"), F.lit(10)) == 0
    first = attendance.where((F.col("date") <= F.lit(cut)) & ~missing)
    S.rebuild(first, beatdowns, aos, path)
    assert emails(S.ever_led(spark, path, users, cut)) == full((users, first, beatdowns, aos), cut)
    # then the rest arrives, late rows among it, and every led post of 1993 is withdrawn
    gone = F.year("date") == 1993
    now = attendance.where((F.col("date") <= F.lit(as_of)) & ~gone)
    changed = attendance.where((missing | (F.col("date") > F.lit(cut)) | gone) & (F.col("date") <= F.lit(as_of)))
    for _ in range(2):  # a repeated refresh changes nothing
        S.refresh(now, beatdowns, aos, path, S.months_of(changed))
        for day in (dt.date(1993, 12, 31), cut, as_of):
            assert emails(S.ever_led(spark, path, users, day)) == full((users, now, beatdowns, aos), day)
    # a corrected email needs no refresh
    renamed = users.withColumn("email", F.concat(F.lit("x"), "email"))
    assert emails(S.ever_led(spark, path, renamed, as_of)) == full((renamed, now, beatdowns, aos), as_of)


def test_refresh_reads_the_changed_months_only(spark, stored, tmpdir_path):
    users, attendance, beatdowns, aos = stored
    by_month = os.path.join(tmpdir_path, "attendance")
    attendance.withColumn("month", S.month_of("date")).repartition("month").write.partitionBy("month").parquet(by_month)
    path = os.path.join(tmpdir_path, "state")
    S.rebuild(attendance, beatdowns, aos, path)
    before = {d: os.path.getmtime(os.path.join(path, d)) for d in os.listdir(path) if d.startswith("month=")}
    S.refresh(attendance, beatdowns, aos, path, [dt.date(1995, 6, 1)])
    after = {d: os.path.getmtime(os.path.join(path, d)) for d in os.listdir(path) if d.startswith("month=")}
    assert {d for d in after if after[d] != before.get(d)} == {"month=1995-06-01"}
    S.refresh(attendance, beatdowns, aos, path, [])
    late = spark.read.parquet(by_month).where("month = DATE'1995-06-01'")
    assert S.months_of(late) == [dt.date(1995, 6, 1)]
    plan = S.ever_led(spark, path, users, dt.date(1995, 1, 1))
    text = spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(month" in text and "(month#" in text


def test_report_run_with_state_equals_the_run_without(spark, stored, tmpdir_path):
    tables, cfg = J.AttendanceTables(*stored), X.region_config(spark, SF)
    path = os.path.join(tmpdir_path, "state")
    want = sorted(map(tuple, J.report_run(tables, cfg, X.FACT_AS_OF)["report"].collect()))
    earlier = X.FACT_AS_OF - dt.timedelta(days=70)
    J.report_run(tables, cfg, earlier, led_state_path=path)
    months = [dt.date(1998, m, 1) for m in (8, 9, 10)]
    got = J.report_run(tables, cfg, X.FACT_AS_OF, led_state_path=path, changed_months=months)["report"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10
