"""Manual awards tagged in event write-ups.

Documentation-derived: the source documents a line "Achievement: CODE" in the
write-up that gives the award CODE of the region's list to the event's
attendees; its code does not implement it. Here the tags are extracted and
exploded per event, and only tagged events meet the attendance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line that tags an award code.
MANUAL_TAG_PATTERN = r"(?m)^Achievement: *(\S+)"


def tagged_events(beatdowns: DataFrame) -> DataFrame:
    """One row per event and code tagged in its write-up, the code in place of the write-up.

    Tags are read once per event, before the attendance is joined; events
    without a tag go no further.
    """
    others = [c for c in beatdowns.columns if c != "backblast"]
    codes = F.array_distinct(F.regexp_extract_all(F.col("backblast"), F.lit(MANUAL_TAG_PATTERN), 1))
    return beatdowns.select(*others, F.explode(codes).alias("backblast"))


def manual_awards(fact: DataFrame, award_list: DataFrame) -> DataFrame:
    """Awards of the region's list tagged by code; date_awarded = event date.

    ``fact`` is the post fact of ``tagged_events`` with the home region attached.
    Columns: achievement_id, code, email, region, ao_id, date_awarded.
    """
    lst = award_list.select("region", F.col("id").alias("achievement_id"), "code")
    tagged = fact.select("region", "email", "ao_id", "date", F.col("backblast").alias("code"))
    return tagged.join(lst, ["region", "code"]).select(
        "achievement_id", "code", "email", "region", "ao_id", F.col("date").alias("date_awarded")
    )
