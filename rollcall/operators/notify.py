"""Award notifications as rows (U22, U23, SNK6, SNK7): texts and targets, no delivery.

All text is built with column expressions (``concat``, ``when``), no UDFs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.constants import (
    AWARD_MESSAGE,
    LOG_CHANNEL_AO,
    RUN_SUMMARY_MESSAGE,
    SIX_PACK_AWARD_ID,
    SIX_PACK_REPEAT_MESSAGE,
)
from rollcall.functions.text import fill, ordinal_suffix

DEFAULT_BOT_NAME = "Rollcall"


def award_messages(ordinals: DataFrame, award_list: DataFrame, regions: DataFrame, compat: bool = False) -> DataFrame:
    """One notification per new award.

    Text (U22): the congratulation template; a repeat 6-pack award (award 13,
    n-th time > 1) gets the short text. ``compat=True`` reproduces the source,
    whose 6-pack test compares the user id with 13 and so never fires.
    Target (U23): the person (direct message) for a repeat 6-pack award,
    otherwise the region's award channel.
    Columns: region, achievement_id, pax_id, date_awarded, target, text.
    """
    lst = award_list.select("region", F.col("id").alias("achievement_id"), "name", "verb")
    j = ordinals.join(lst, ["region", "achievement_id"]).join(regions.select("region", "achievement_channel"), "region")
    nth = F.col("nth_time")
    suffix = ordinal_suffix(nth)
    repeat_six = (F.col("achievement_id") == SIX_PACK_AWARD_ID) & (nth > 1)
    generic = fill(
        AWARD_MESSAGE,
        pax=F.col("pax_id"),
        name=F.col("name"),
        verb=F.col("verb"),
        date=F.date_format("date_awarded", "yyyy-MM-dd"),
        total=F.col("total_awards"),
        nth=nth,
        suffix=suffix,
    )
    short = fill(SIX_PACK_REPEAT_MESSAGE, nth=nth, suffix=suffix)
    text = generic if compat else F.when(repeat_six, short).otherwise(generic)
    target = F.when(repeat_six, F.col("pax_id")).otherwise(F.col("achievement_channel"))
    return j.select("region", "achievement_id", "pax_id", "date_awarded", target.alias("target"), text.alias("text"))


def log_channels(aos: DataFrame) -> DataFrame:
    """SRC10: each region's log channel (site named 'paxminer_logs'; smallest id if several)."""
    return aos.where(F.col("ao") == LOG_CHANNEL_AO).groupBy("region").agg(F.min("channel_id").alias("log_channel"))


def run_summary(new: DataFrame, regions: DataFrame, logs: DataFrame, bot_name: str = DEFAULT_BOT_NAME) -> DataFrame:
    """SNK7: one summary row per processed region, zero counts kept.

    Columns: region, target, n_new, text.
    """
    counts = new.groupBy("region").agg(F.count(F.lit(1)).alias("n_new"))
    j = regions.select("region").join(counts, "region", "left").join(logs, "region", "left")
    n = F.coalesce(F.col("n_new"), F.lit(0)).cast("long")
    return j.select(
        "region",
        F.col("log_channel").alias("target"),
        n.alias("n_new"),
        fill(RUN_SUMMARY_MESSAGE, bot=bot_name, n=n).alias("text"),
    )
