"""Every filter of the national joins changes a registered query's rows when it is taken out."""

import pytest
from pyspark.sql import functions as F

from rollcall import queries as Q
from rollcall.constants import EXCLUDED_REGIONS_FACT
from rollcall.operators import facts as Fa
from rollcall.sources import fixtures as X
from rollcall.sources.tables import region_list

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def league(spark):
    from rollcall.session import stage_table

    return [stage_table(t, "league-test") for t in Q._league(spark, SF).as_tuple()]


def rows(df):
    return sorted(map(str, df.drop("user_name").collect()))


def posts(spark, league, listed=True, deny=EXCLUDED_REGIONS_FACT, **changed):
    from rollcall.plans.jobs import AttendanceTables

    tables = dict(zip(("users", "attendance", "beatdowns", "aos"), league)) | changed
    names = region_list(X.league_regions(spark, SF)) if listed else None
    t = AttendanceTables(**tables).restricted(names, deny)
    events = Fa.event_posts(*t.as_tuple(), since=X.FACT_AS_OF.replace(month=1, day=1), exclude=deny)
    return rows(Fa.valid_posts(events, X.FACT_AS_OF))


def test_each_filter_bites(spark, league):
    users, attendance, beatdowns, aos = league
    base = posts(spark, league)
    assert base == rows(Q.league_posts(spark, SF))
    without = {
        "prefix": posts(spark, league, listed=False),
        "deny list": posts(spark, league, deny=()),
        "system account": posts(spark, league, users=users.withColumn("user_name", F.lit("someone"))),
        "no email": posts(spark, league, users=users.withColumn("email", F.coalesce("email", F.lit("x")))),
        "unknown email": posts(spark, league, users=users.withColumn("email", F.when(F.col("email") == "none", "y").otherwise(F.col("email")))),
        "event without Q": posts(spark, league, beatdowns=beatdowns.withColumn("q_user_id", F.coalesce("q_user_id", F.lit("nobody")))),
        "lesson site": posts(spark, league, aos=aos.withColumn("ao", F.when(F.col("channel_id") == "6", "ao-6").otherwise(F.col("ao")))),
        "ruck site": posts(spark, league, aos=aos.withColumn("ao", F.when(F.col("channel_id") == "7", "ao-7").otherwise(F.col("ao")))),
    }
    assert [name for name, got in without.items() if got == base] == []
    assert len(base) > 1000


def test_report_has_leads_and_never_led(spark):
    noq = Q.league_noq(spark, SF).collect()
    assert len(noq) > 20 and any(r.site_q_user_id for r in noq) and not all(r.site_q_user_id for r in noq)
    assert {r.region for r in noq} & {"f3csra", "f3devcommunity", "x9"} == set()
