"""Logical table schemas. Every region-scoped table carries ``region``."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

USERS = T.StructType(
    [
        T.StructField("region", S),
        T.StructField("user_id", S),
        T.StructField("email", S),
        T.StructField("user_name", S),
    ]
)

BD_ATTENDANCE = T.StructType(
    [
        T.StructField("region", S),
        T.StructField("user_id", S),
        T.StructField("ao_id", S),
        T.StructField("q_user_id", S),
        T.StructField("date", T.DateType()),
    ]
)

BEATDOWNS = T.StructType(
    [
        T.StructField("region", S),
        T.StructField("ao_id", S),
        T.StructField("bd_date", T.DateType()),
        T.StructField("q_user_id", S),
        T.StructField("coq_user_id", S),
        T.StructField("backblast", S),
    ]
)

AOS = T.StructType(
    [
        T.StructField("region", S),
        T.StructField("channel_id", S),
        T.StructField("ao", S),
        T.StructField("site_q_user_id", S),
    ]
)

REGIONS = T.StructType([T.StructField("schema_name", S)])

REGION_CONFIG = T.StructType(
    [
        T.StructField("paxminer_schema", S),
        T.StructField("achievement_channel", S),
        T.StructField("default_siteq", S),
        T.StructField("NO_POST_THRESHOLD", T.IntegerType()),
        T.StructField("NO_Q_THRESHOLD_WEEKS", T.IntegerType()),
        T.StructField("REMINDER_WEEKS", T.IntegerType()),
        T.StructField("NO_Q_THRESHOLD_POSTS", T.IntegerType()),
        T.StructField("HOME_AO_CAPTURE", T.IntegerType()),
    ]
)

ACHIEVEMENTS_LIST = T.StructType(
    [
        T.StructField("region", S),
        T.StructField("id", T.IntegerType(), False),
        T.StructField("name", S, False),
        T.StructField("description", S, False),
        T.StructField("verb", S, False),
        T.StructField("code", S, False),
    ]
)

ACHIEVEMENTS_AWARDED = T.StructType(
    [
        T.StructField("region", S),
        T.StructField("id", T.LongType(), False),
        T.StructField("achievement_id", T.IntegerType(), False),
        T.StructField("pax_id", S, False),
        T.StructField("date_awarded", T.DateType(), False),
        T.StructField("created", T.TimestampType(), False),
        T.StructField("updated", T.TimestampType(), False),
    ]
)

# the run that recorded an award, the partition a rerun replaces; NULL for manual entries and imports
RUN_DATE = T.StructField("run_date", T.DateType())
AWARDED_BY_RUN = T.StructType([*ACHIEVEMENTS_AWARDED.fields, RUN_DATE])

# flat post fact consumed by the award operators (after the home-region join)
POST_FACT = T.StructType(
    [
        T.StructField("email", S),
        T.StructField("user_name", S),
        T.StructField("ao_id", S),
        T.StructField("ao", S),
        T.StructField("date", T.DateType()),
        T.StructField("q_flag", T.IntegerType()),
        T.StructField("backblast", S),
        T.StructField("region", S),
    ]
)

FILE = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("filetype", S),
        T.StructField("mimetype", S),
        T.StructField("url_private", S),
        T.StructField("original_w", T.IntegerType()),
    ]
)

MESSAGES = T.StructType(
    [
        T.StructField("channel", S),
        T.StructField("ts", S),
        T.StructField("user", S),
        T.StructField("text", S),
        T.StructField("files", T.ArrayType(FILE)),
    ]
)

MEMBERS = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("profile", T.StructType([T.StructField("display_name", S), T.StructField("real_name", S)])),
    ]
)
