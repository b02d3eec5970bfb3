"""State of who ever led, kept month by month (U29 / A7 over all history).

"Never led" needs every event a person ever led. Instead of joining all
history each week, the led posts are reduced to one row per (month, account)
with the first date led in the month, in a table partitioned by event month. A
run refreshes only the months that gained, lost or changed rows, late
arrivals and corrections included: each such month is computed anew from its own
days and replaces its partition, so a refresh may be repeated. The table can be
rebuilt from scratch at any time with the same result.

Accounts are stored by (region, user id) and meet the users table when the
state is read, so a corrected email or name needs no refresh. A
change of the site table does: rebuild.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.constants import EXCLUDED_REGIONS_FACT, NO_EMAIL, SYSTEM_USER_NAME
from rollcall.functions import periods
from rollcall.operators.facts import led_posts
from rollcall.session import stage_table

#: ``month`` is the first day of the month, the partition column.
SCHEMA = "region string, user_id string, first_led date, month date"


def month_of(date: str):
    return F.trunc(date, "month")


def months_of(changed: DataFrame, *dates: str) -> list[_dt.date]:
    """The months of new, late, corrected or deleted rows; ``dates`` are the date columns that count (default ``date``).

    A corrected date changes two months: pass the old rows too. One row a month reaches the driver.
    """
    found = [changed.select(month_of(d).alias("month")) for d in dates or ("date",)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return sorted(r["month"] for r in rows.where(F.col("month").isNotNull()).distinct().collect())


def _state_rows(attendance: DataFrame, beatdowns: DataFrame, aos: DataFrame, exclude: Iterable[str]) -> DataFrame:
    led = led_posts(attendance, beatdowns, aos, exclude)
    rows = led.groupBy("region", "user_id", month_of("date").alias("month")).agg(F.min("date").alias("first_led"))
    return rows.select("region", "user_id", "first_led", "month")


def rebuild(attendance: DataFrame, beatdowns: DataFrame, aos: DataFrame, path: str, exclude: Iterable[str] = EXCLUDED_REGIONS_FACT) -> None:
    """Write the state of all history, replacing what is there."""
    rows = _state_rows(attendance, beatdowns, aos, exclude)
    rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("month").parquet(path)


def refresh(
    attendance: DataFrame,
    beatdowns: DataFrame,
    aos: DataFrame,
    path: str,
    months: Iterable[_dt.date],
    exclude: Iterable[str] = EXCLUDED_REGIONS_FACT,
) -> None:
    """Replace the partitions of ``months``; the tables are read for these months only (a pushed list of ranges).

    A month that lost its last led post is replaced too: each month gets one
    row without an account, so that its partition is written in any case.
    """
    months = sorted(set(months))
    if not months:
        return
    spark = attendance.sparkSession

    def within(date: str):
        cond = F.lit(False)
        for first in months:
            after = (first.replace(day=28) + _dt.timedelta(days=4)).replace(day=1)
            cond = cond | ((F.col(date) >= F.lit(first)) & (F.col(date) < F.lit(after)))
        return cond

    rows = _state_rows(attendance.where(within("date")), beatdowns.where(within("bd_date")), aos, exclude)
    marks = spark.createDataFrame([(None, None, None, m) for m in months], SCHEMA)
    # written apart first: the refreshed partitions may be among the inputs of a caller's plan
    ready = stage_table(rows.unionByName(marks), "led-months")
    ready.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def ever_led(spark: SparkSession, path: str, users: DataFrame, as_of: _dt.date | str) -> DataFrame:
    """Emails of accounts that led at least once up to ``as_of``: equal to ``facts.ever_led`` on that date.

    Months after ``as_of`` are not read (partition pruning). Columns: email.
    """
    state = spark.read.schema(SCHEMA).parquet(path).where(F.col("month") <= F.lit(periods.to_pydate(as_of)))
    led = state.where(F.col("user_id").isNotNull() & periods.not_after("first_led", as_of)).select("region", "user_id").distinct()
    valid = users.where((F.col("email") != NO_EMAIL) & (F.col("user_name") != SYSTEM_USER_NAME)).select("region", "user_id", "email")
    return valid.join(led, ["region", "user_id"]).select("email").distinct()
