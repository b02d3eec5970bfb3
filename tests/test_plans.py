"""Physical-plan shape of every registered query: no all-pairs joins, no Python, filters pushed."""

import re

import pytest

from conftest import SMOKE
from rollcall import queries

QUERIES = queries.REGISTRY


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_no_python(spark, name):
    p = _plan(QUERIES[name](spark, SMOKE))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p


def test_award_fact_scans_with_date_pushdown(spark):
    assert _plan(QUERIES["awards_all"](spark, SMOKE)).count("lineitem.parquet") == 1
    assert _plan(QUERIES["award_priest"](spark, SMOKE)).count("lineitem.parquet") == 1
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", _formatted(QUERIES["awards_all"](spark, SMOKE)))
    assert any("GreaterThanOrEqual(l_shipdate" in f and "LessThan(l_shipdate" in f for f in pushed)


def test_home_region_lookback_is_a_pushed_range(spark):
    df = QUERIES["home_region_counts"](spark, SMOKE)
    text = _formatted(df)
    assert "l_shipdate" in " ".join(re.findall(r"PushedFilters: \[([^\]]*)\]", text))


def test_column_pruning_on_the_widest_table(spark):
    df = QUERIES["awards_all"](spark, SMOKE)
    text = _formatted(df)
    schema = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_shipdate" in s][0]
    assert "l_extendedprice" not in schema and "l_tax" not in schema


def test_date_range_reaches_both_event_and_attendance_scans(spark, tmpdir_path):
    import datetime as dt

    from rollcall.operators import facts as Fa
    from rollcall.sources import fixtures as X

    names = ("users", "att", "bd", "aos")
    frames = (X.normalised_users(spark, SMOKE), X.normalised_attendance(spark, SMOKE),
              X.normalised_beatdowns(spark, SMOKE), X.normalised_aos(spark, SMOKE))
    for n, df in zip(names, frames):
        df.write.parquet(f"{tmpdir_path}/{n}")
    t = [spark.read.parquet(f"{tmpdir_path}/{n}") for n in names]
    for df in (Fa.post_fact(*t, as_of=dt.date(1998, 10, 31)), Fa.event_posts(*t, since=dt.date(1998, 1, 1))):
        text = _formatted(df)
        scans = dict(re.findall(r"Location: InMemoryFileIndex \[file:[^\]]*/(\w+)\][^\n]*\n(?:[^\n]*\n)*?PushedFilters: \[([^\]]*)\]", text))
        assert "GreaterThanOrEqual(date,1998-01-01)" in scans["att"]
        assert "GreaterThanOrEqual(bd_date,1998-01-01)" in scans["bd"]
