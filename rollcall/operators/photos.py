"""Monthly photo archive manifest from chat exports.

Input is a message export (``channel, ts, user, text, files[]``), a member
list and the files' bytes. Output is a manifest: which images to archive,
under which name, with which description, capture date and GPS tag.
Image decoding, face detection and the upload itself are out of scope.

Mentions (``<@ID>``) are rewritten with a join: each message's distinct
mentions are exploded, joined with the member table (no member map is
broadcast), folded back into a per-message map (bounded by the mentions of
one message) and applied with ``aggregate`` over the map entries.
Duplicate images are found by md5 of the bytes against the seen-checksum
table (anti join) and within the batch (earliest post wins; a partial
``min_by`` so a much re-posted image costs one row per map task).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.constants import (
    PHOTO_DESCRIPTION,
    PHOTO_DESCRIPTION_MAX_CHARS,
    PHOTO_EXIF_DATE_FORMAT,
    PHOTO_EXIF_OFFSET,
    SITE_GPS,
)
from rollcall.functions import periods
from rollcall.functions.text import fill

MENTION_PATTERN = r"<@[^<>]*>"


def flatten_files(messages: DataFrame) -> DataFrame:
    """One row per attached file; a message without ``files`` gives one row with NULL file fields.

    A message whose ``files`` list is empty gives no row (Q19). ``file_is_photo``
    is true when the file has an original width.
    """
    keep = F.col("files").isNull() | (F.size("files") > 0)
    flat = messages.where(keep).select("channel", "ts", "user", "text", F.explode_outer("files").alias("f"))
    return flat.select(
        "channel",
        "ts",
        "user",
        "text",
        F.col("f.id").alias("file_id"),
        F.col("f.filetype").alias("filetype"),
        F.col("f.mimetype").alias("mimetype"),
        F.col("f.url_private").alias("file_url"),
        F.coalesce(F.col("f.original_w").isNotNull(), F.lit(False)).alias("file_is_photo"),
    )


def ts_to_date(ts: str = "ts"):
    """Epoch-seconds string -> UTC calendar date (independent of the session time zone)."""
    return F.date_from_unix_date(F.floor(F.col(ts).try_cast("double") / F.lit(86400)).cast("int"))


def in_previous_month(messages: DataFrame, as_of: _dt.date | str) -> DataFrame:
    """F18/SRC11: messages posted in the calendar month before ``as_of`` (January handled)."""
    start, end = periods.previous_month_bounds(as_of)
    t = F.col("ts").try_cast("double")
    lo = (start - _dt.datetime(1970, 1, 1)).total_seconds()
    hi = (end - _dt.datetime(1970, 1, 1)).total_seconds()
    return messages.where((t >= F.lit(lo)) & (t < F.lit(hi)))


def member_names(members: DataFrame) -> DataFrame:
    """SRC12/PRJ9/PRJ10: (id, pax, mention): display name, or real name when it is empty; spaces -> '_'."""
    flat = members.select("id", "profile.display_name", "profile.real_name")
    name = F.when(F.col("display_name") == "", F.col("real_name")).otherwise(F.col("display_name"))
    pax = F.concat(F.lit("@"), F.regexp_replace(name, " ", "_"))
    # a member listed twice counts once, with the least name
    return flat.groupBy("id").agg(F.min(pax).alias("pax")).withColumn("mention", F.concat(F.lit("<@"), F.col("id"), F.lit(">")))


def rewrite_mentions(df: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """Replace every ``<@ID>`` of a known member in ``text`` with the member's ``@name``.

    Each distinct text is rewritten once, so repeated messages, and several
    or no file ids on one message, make no difference; rows meet their
    message's text by its digest.
    """
    own = df.withColumn("text_key", F.md5(text))
    texts = own.select("text_key", F.col(text).alias("message")).distinct()
    mentions = F.array_distinct(F.regexp_extract_all("message", F.lit(MENTION_PATTERN), 0))
    found = texts.select("text_key", F.explode(mentions).alias("mention"))
    known = found.join(names.select("mention", "pax").where(F.col("pax").isNotNull()), "mention")
    maps = known.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("mention", "pax"))).alias("m"))
    replaced = F.aggregate(
        F.map_entries(F.coalesce(F.col("m"), F.create_map().cast("map<string,string>"))),
        F.col("message"),
        lambda acc, e: F.replace(acc, e["key"], e["value"]),
    )
    rewritten = texts.join(maps, "text_key", "left").select(F.col("text_key").alias("key"), replaced.alias("new_text"))
    met = own.drop(text).join(rewritten, F.col("text_key").eqNullSafe(F.col("key")), "left")
    return met.select(*[F.col("new_text").alias(c) if c == text else F.col(c) for c in df.columns])


def photo_rows(flat: DataFrame, members: DataFrame) -> DataFrame:
    """Photo files with mentions rewritten, posting date and poster name.

    Columns: channel, ts, user, text, file_id, filetype, mimetype, file_url, date, pax.
    """
    names = member_names(members)
    photos = flat.where(F.col("file_is_photo")).drop("file_is_photo")
    photos = rewrite_mentions(photos, names)
    photos = photos.withColumn("date", ts_to_date("ts"))
    poster = names.select(F.col("id").alias("user"), "pax")
    return photos.join(poster, "user", "left").select(
        "channel", "ts", "user", "text", "file_id", "filetype", "mimetype", "file_url", "date", "pax"
    )


def dedup_photos(photos: DataFrame, contents: DataFrame, seen: DataFrame | None) -> DataFrame:
    """md5 of the bytes; drop checksums seen before and repeats within the batch (earliest kept).

    ``contents`` has (file_id, content). Photos without bytes are dropped (the
    download failed). The winner of each checksum is chosen on narrow
    rows, which carry the digest of their message; the texts, each distinct one once, are
    joined onto the winners. Output: photo columns + checksum.
    """
    keyed = photos.withColumn("text_key", F.md5("text"))
    narrow = [c for c in photos.columns if c != "text"]
    with_sum = keyed.select(*narrow, "text_key").join(contents.select("file_id", F.md5("content").alias("checksum")), "file_id")
    if seen is not None:
        with_sum = with_sum.join(seen.select("checksum"), "checksum", "left_anti")
    order = F.struct(F.col("ts").try_cast("double"), F.col("ts"), F.col("file_id"), F.col("channel"), F.col("user"), F.col("text_key"))
    best = with_sum.groupBy("checksum").agg(F.min_by(F.struct(*narrow, "text_key"), order).alias("p")).select("checksum", "p.*")
    texts = keyed.select("text_key", "text").distinct()
    return best.join(texts, best["text_key"].eqNullSafe(texts["text_key"]), "left").select(*photos.columns, "checksum")


def gps_table(spark: SparkSession) -> DataFrame:
    """Site channel -> EXIF GPS tags, from the fixed table (seven rows)."""
    def rational(dms) -> str:
        return ",".join(f"{n}/{d}" for n, d in dms)

    rows = [(channel, tags[1], rational(tags[2]), tags[3], rational(tags[4])) for channel, tags in SITE_GPS]
    return spark.createDataFrame(
        rows, "channel string, gps_lat_ref string, gps_lat string, gps_lon_ref string, gps_lon string"
    )


def photo_manifest(photos: DataFrame) -> DataFrame:
    """Archive name and type (png -> jpg), description (first 1000 characters), EXIF date, GPS.

    Columns: file_id, checksum, channel, target_name, target_filetype, description,
    exif_date, exif_offset, gps_lat_ref, gps_lat, gps_lon_ref, gps_lon.
    """
    gps = F.broadcast(gps_table(photos.sparkSession))  # fixed seven-row table
    is_png = F.lower(F.col("filetype")) == "png"
    target_type = F.when(is_png, F.lit("jpg")).otherwise(F.col("filetype"))
    description = fill(
        PHOTO_DESCRIPTION,
        pax=F.coalesce(F.col("pax"), F.lit("nan")),
        date=F.date_format("date", "yyyy-MM-dd"),
        channel=F.col("channel"),
        text=F.col("text"),
    )
    return photos.join(gps, "channel", "left").select(
        "file_id",
        "checksum",
        "channel",
        F.concat(F.col("file_id"), F.lit("."), target_type).alias("target_name"),
        target_type.alias("target_filetype"),
        F.substring(description, 1, PHOTO_DESCRIPTION_MAX_CHARS).alias("description"),
        F.date_format("date", PHOTO_EXIF_DATE_FORMAT).alias("exif_date"),
        F.lit(PHOTO_EXIF_OFFSET).alias("exif_offset"),
        "gps_lat_ref",
        "gps_lat",
        "gps_lon_ref",
        "gps_lon",
    )


def new_checksums(manifest: DataFrame) -> DataFrame:
    """SRC14: checksums to record in the seen state after a run (fixes the never-updated set)."""
    return manifest.select("checksum").distinct()
