"""Adapters from the driver's TPC-H-like tables to the logical attendance tables.

These are test fixtures: they map real, whole driver tables onto the shapes
the operators consume, so every query's work grows with the data. Each
adapter is mirrored by a SQL CTE in ``__spark_entry__.oracle_sql``.

* award fact    lineitem x supplier x part: person = supplier, site = line number
* normalised    lineitem x orders x customer -> users / bd_attendance / beatdowns / aos
* home fact     lineitem x orders x supplier: person = customer, region = supplier nation
* report fact   orders x customer: person = customer, site = order priority
* photos        documents (content), pages (file urls), grouped into messages
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.constants import AWARD_CATALOGUE

AWARD_AS_OF = _dt.date(1998, 10, 31)
AWARD_HISTORY_AS_OF = _dt.date(1998, 6, 30)
# driver-query thresholds (the reference defaults stay in AwardSpec)
DRIVER_THRESHOLDS = {1: 15, 5: 3, 6: 4, 10: 60, 11: 70, 12: 72, 14: 10}
HOME_AS_OF = _dt.date(2001, 6, 30)
FACT_AS_OF = _dt.date(1998, 10, 31)
REPORT_AS_OF = _dt.date(2001, 8, 1)
REPORT_WEEKS = {
    "NO_POST_THRESHOLD": 12,
    "NO_Q_THRESHOLD_WEEKS": 12,
    "REMINDER_WEEKS": 28,
    "NO_Q_THRESHOLD_POSTS": 12,
    "HOME_AO_CAPTURE": 52,
}
PHOTO_AS_OF = _dt.date(2000, 3, 15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ---------------------------------------------------------------------------
# awards
# ---------------------------------------------------------------------------

def award_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat post fact of all years, region = home region (POST_FACT columns)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"
    )
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    backblast = (
        F.when(F.col("l_quantity") == 50, F.lit(None).cast("string"))
        .when(F.col("l_quantity") <= 12, F.concat(F.lit("Q Source 1.1 "), F.col("p_name")))
        .otherwise(F.concat(F.lit("Regular workout "), F.col("p_name")))
    )
    return j.select(
        _s("l_suppkey").alias("email"),
        F.col("s_name").alias("user_name"),
        _s("l_linenumber").alias("ao_id"),
        F.concat(F.lit("ao-"), _s("l_linenumber")).alias("ao"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_returnflag") == "R").cast("int").alias("q_flag"),
        backblast.alias("backblast"),
        _s("s_nationkey").alias("region"),
    )


def award_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region user tables for the award fact: one account per supplier in its nation."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        _s("s_nationkey").alias("region"),
        F.concat(F.lit("U"), _s("s_suppkey")).alias("user_id"),
        _s("s_suppkey").alias("email"),
        F.col("s_name").alias("user_name"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region per nation (names are the nation keys)."""
    return table(spark, sf_dir, "nation").select(_s("n_nationkey").alias("region"), "n_regionkey")


def achievements_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region's award list: the 14 seeded awards; regions of world region 1 deleted award 4."""
    seed = F.array(
        *[
            F.struct(
                F.lit(i).alias("id"),
                F.lit(name).alias("name"),
                F.lit(desc).alias("description"),
                F.lit(verb).alias("verb"),
                F.lit(code).alias("code"),
            )
            for i, (name, desc, verb, code) in enumerate(AWARD_CATALOGUE, start=1)
        ]
    )
    lst = regions(spark, sf_dir).select("region", "n_regionkey", F.explode(seed).alias("a"))
    lst = lst.where(~((F.col("n_regionkey") == 1) & (F.col("a.id") == 4)))
    return lst.select("region", "a.id", "a.name", "a.description", "a.verb", "a.code")


def region_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-region settings; regions of world region 4 have no award channel (not signed up)."""
    n = table(spark, sf_dir, "nation")
    nk = _s("n_nationkey")
    default_siteq = (
        F.when(F.col("n_regionkey") == 1, F.concat(F.lit("UL"), nk, F.lit("-2")))
        .when(F.col("n_regionkey") == 2, F.concat(F.lit("C"), nk))
        .otherwise(F.concat(F.lit("UD"), nk))
    )
    cols = [
        nk.alias("region"),
        F.when(F.col("n_regionkey") == 4, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("CACH"), nk))
        .alias("achievement_channel"),
        default_siteq.alias("default_siteq"),
        F.concat(F.lit("CLOG"), nk).alias("log_channel"),
    ]
    cols += [F.lit(v).cast("int").alias(k) for k, v in REPORT_WEEKS.items()]
    return n.select(*cols)


def award_history_table(spark: SparkSession, sf_dir: str, as_of=AWARD_HISTORY_AS_OF) -> DataFrame:
    """``achievements_awarded`` as left by a first run at ``as_of``: every award earned by then."""
    from rollcall.functions import periods
    from rollcall.operators import awards as A
    from rollcall.operators import diff as D

    posts = award_posts(spark, sf_dir)
    fact = posts.where(periods.in_year_of("date", as_of) & periods.not_after("date", as_of))
    earned = A.earned_awards(fact, A.award_specs(DRIVER_THRESHOLDS))
    pax = D.attach_pax_id(earned, award_users(spark, sf_dir))
    ts = F.lit(_dt.datetime.combine(as_of, _dt.time(6, 0)))
    return pax.select(
        "region",
        F.xxhash64("region", "achievement_id", "pax_id", "period", "date_awarded").alias("id"),
        "achievement_id",
        "pax_id",
        "date_awarded",
        ts.alias("created"),
        ts.alias("updated"),
        F.lit(as_of).alias("run_date"),
    )


def award_aos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site tables of the award regions: only the log channel matters to the award run."""
    nk = _s("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        nk.alias("region"),
        F.concat(F.lit("CLOG"), nk).alias("channel_id"),
        F.lit("paxminer_logs").alias("ao"),
        F.lit(None).cast("string").alias("site_q_user_id"),
    )


# ---------------------------------------------------------------------------
# normalised attendance tables (for the joins of the national fact)
# ---------------------------------------------------------------------------

def _normalised_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.select(
        _s("c_nationkey").alias("region"),
        _s("o_custkey").alias("user_id"),
        _s("l_linenumber").alias("ao_id"),
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"),
        "l_orderkey",
        "l_quantity",
    )


def normalised_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    email = F.when(F.col("c_acctbal") < 0, F.lit("none")).otherwise(
        F.concat(F.lit("pax"), _s("c_custkey"), F.lit("@example.org"))
    )
    return c.select(
        _s("c_nationkey").alias("region"),
        _s("c_custkey").alias("user_id"),
        email.alias("email"),
        F.col("c_name").alias("user_name"),
    )


def normalised_beatdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _normalised_base(spark, sf_dir)
    g = base.groupBy("region", "ao_id", "date").agg(
        F.min("user_id").alias("q"),
        F.max("user_id").alias("mx"),
        F.min("l_quantity").alias("minq"),
        F.max("l_quantity").alias("maxq"),
    )
    # a manual award tag on its own line (one listed code, one unknown code)
    tag = (
        F.when(F.col("maxq") == 50, F.lit("\nAchievement: golden_boy"))
        .when(F.col("maxq") == 49, F.lit("\nAchievement: run_a_5k"))
        .otherwise(F.lit(""))
    )
    return g.select(
        "region",
        "ao_id",
        F.col("date").alias("bd_date"),
        F.col("q").alias("q_user_id"),
        F.when(F.col("mx") != F.col("q"), F.col("mx")).alias("coq_user_id"),
        F.concat(
            F.when(F.col("minq") <= 2, F.lit("Q Source 1.1 lesson")).otherwise(
                F.concat(F.lit("Regular workout at ao-"), F.col("ao_id"))
            ),
            tag,
        ).alias("backblast"),
    )


def normalised_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attendance rows; the recorded leader is the event's Q (even order key) or its co-Q when there is one.

    The event's Q / co-Q come from a window over the event key (one shuffle),
    equal to the ``normalised_beatdowns`` aggregate.
    """
    from pyspark.sql import Window

    base = _normalised_base(spark, sf_dir).select(
        "region", "user_id", "ao_id", "date", (F.col("l_orderkey") % 2 == 0).alias("even")
    )
    event = Window.partitionBy("region", "ao_id", "date")
    q = F.min("user_id").over(event)
    mx = F.max("user_id").over(event)
    coq = F.when(mx != q, mx)
    leader = F.when(F.col("even"), q).otherwise(F.coalesce(coq, q))
    return base.select("region", "user_id", "ao_id", leader.alias("q_user_id"), "date")


def normalised_aos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per (region, line number) that has events (same set as the distinct pairs of the base)."""
    return (
        normalised_beatdowns(spark, sf_dir)
        .select("region", "ao_id")
        .distinct()
        .select(
            "region",
            F.col("ao_id").alias("channel_id"),
            F.concat(F.lit("ao-"), F.col("ao_id")).alias("ao"),
            F.lit(None).cast("string").alias("site_q_user_id"),
        )
    )


# ---------------------------------------------------------------------------
# the league: the normalised tables with rows that every filter bites on
# ---------------------------------------------------------------------------

LEAGUE_NAMES = {3: "f3csra", 7: "f3devcommunity", 9: "x9", 11: "f3yellowhammer"}


def league_region(nation: str) -> Column:
    """Region names with the prefix, but for one without; two are on the deny list, one more on that of the awards."""
    name = F.concat(F.lit("f3r"), _s(nation))
    for key, other in LEAGUE_NAMES.items():
        name = F.when(F.col(nation) == key, F.lit(other)).otherwise(name)
    return name


def league_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(league_region("n_nationkey").alias("schema_name"))


def league_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(_s("n_nationkey").alias("region"), league_region("n_nationkey").alias("name"))
    return region_config(spark, sf_dir).join(names, "region").drop("region").withColumnRenamed("name", "region")


def league_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; some have no email or the one of the unknown, some accounts are the system's."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    email = F.when(key % 53 == 0, F.lit(None).cast("string")).when(F.col("c_acctbal") < 0, F.lit("none"))
    return c.select(
        league_region("c_nationkey").alias("region"),
        _s("c_custkey").alias("user_id"),
        email.otherwise(F.concat(F.lit("pax"), _s("c_custkey"), F.lit("@example.org"))).alias("email"),
        F.when(key % 97 == 0, F.lit("PAXminer")).otherwise(F.col("c_name")).alias("user_name"),
    )


def _league_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(_s("n_nationkey").alias("region"), league_region("n_nationkey").alias("name"))
    base = _normalised_base(spark, sf_dir).join(F.broadcast(names), "region")  # 25 nations at every size
    return base.drop("region").withColumnRenamed("name", "region")


def _league_leaders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The attendance base, and the two leaders of each site and year, so that most accounts never lead."""
    base = _league_base(spark, sf_dir).withColumn("year", F.year("date"))
    return base, base.groupBy("region", "ao_id", "year").agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))


def league_beatdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events; one in eleven has lost its Q, some have no write-up."""
    base, leaders = _league_leaders(spark, sf_dir)
    g = base.groupBy("region", "ao_id", "year", "date").agg(
        F.min("l_orderkey").alias("k"), F.min("l_quantity").alias("minq"), F.max("l_quantity").alias("maxq")
    )
    text = F.when(F.col("maxq") >= 49, F.lit(None).cast("string")).when(F.col("minq") <= 4, F.lit("QSource 2.1 lesson")).otherwise(F.lit("Beatdown in the rain"))
    return g.join(leaders, ["region", "ao_id", "year"]).select(
        "region",
        "ao_id",
        F.col("date").alias("bd_date"),
        F.when(F.col("k") % 11 != 0, F.col("lo")).alias("q_user_id"),
        F.when(F.col("hi") != F.col("lo"), F.col("hi")).alias("coq_user_id"),
        text.alias("backblast"),
    )


def league_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attendance rows; the recorded leader is the first of the site's two (even order key) or the second."""
    base, leaders = _league_leaders(spark, sf_dir)
    leader = F.when(F.col("l_orderkey") % 2 == 0, F.col("lo")).otherwise(F.col("hi"))
    return base.join(leaders, ["region", "ao_id", "year"]).select("region", "user_id", "ao_id", leader.alias("q_user_id"), "date")


def league_aos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven sites a region: the sixth is for lessons, the seventh for rucks; the first four have a lead."""
    n = table(spark, sf_dir, "nation").select(league_region("n_nationkey").alias("region"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("no"))
    ao = F.when(F.col("no") == 6, F.lit("3rd-F-QSource")).when(F.col("no") == 7, F.lit("ao-the-ruck")).otherwise(F.concat(F.lit("ao-"), _s("no")))
    lead = F.when(F.col("no") <= 4, F.concat(F.lit("UL"), F.col("region"), F.lit("-"), _s("no")))
    return n.select("region", _s("no").alias("channel_id"), ao.alias("ao"), lead.alias("site_q_user_id"))


# ---------------------------------------------------------------------------
# home region
# ---------------------------------------------------------------------------

def home_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, email, user_id, bd_date): one row per attendance, already joined (J1 output shape)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(
        _s("s_nationkey").alias("region"),
        _s("o_custkey").alias("email"),
        F.concat(F.lit("U"), _s("o_custkey"), F.lit("-"), F.col("o_orderstatus")).alias("user_id"),
        F.to_date("l_shipdate").alias("bd_date"),
    )


# ---------------------------------------------------------------------------
# inactivity report
# ---------------------------------------------------------------------------

def report_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National fact with home region and user id attached (after J4)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        _s("o_custkey").alias("email"),
        F.col("o_orderpriority").alias("ao_id"),
        F.concat(F.lit("ao-"), F.lower("o_orderpriority")).alias("ao"),
        F.to_date("o_orderdate").alias("date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("q_flag"),
        _s("c_nationkey").alias("region"),
        F.concat(F.lit("U"), _s("o_custkey")).alias("user_id"),
    )


def report_aos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of the report fact with their leads: '1-URGENT' has two leads, '5-LOW' none."""
    f = report_fact(spark, sf_dir).select("region", "ao_id", "ao").distinct()
    lead = F.concat(F.lit("UL"), F.col("region"), F.lit("-"), F.substring("ao_id", 1, 1))
    one = f.select(
        "region",
        F.col("ao_id").alias("channel_id"),
        "ao",
        F.when(F.col("ao_id") != "5-LOW", lead).alias("site_q_user_id"),
    )
    second = f.where(F.col("ao_id") == "1-URGENT").select(
        "region", F.col("ao_id").alias("channel_id"), "ao", F.concat(lead, F.lit("b")).alias("site_q_user_id")
    )
    return one.unionByName(second)


# ---------------------------------------------------------------------------
# photo archive: documents as images, pages as file URLs, four files per message
# ---------------------------------------------------------------------------

PHOTO_TS_BASE = 946684800  # 2000-01-01T00:00:00Z
PHOTO_TS_SPAN = 90 * 86400
FILES_PER_MESSAGE = 4


def photo_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all photo tables are made of: every document with the URL of the page of its id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return d.join(p, d.doc_id == p.page_id, "left").drop("page_id")


def photo_messages(base: DataFrame) -> DataFrame:
    """Chat export rows (channel, ts, user, text, files): every document is an attached file.

    Four consecutive documents form one message; a message of Spanish documents
    only has no ``files``; German documents are PDFs (no width, not photos).
    Channels of sources 0-6 are the sites with GPS tags.
    """
    from rollcall.constants import SITE_GPS

    dj = base.withColumn("msg", F.floor(F.col("doc_id") / FILES_PER_MESSAGE))
    lang = F.col("lang")
    file = F.struct(
        F.concat(F.lit("F"), _s("doc_id")).alias("id"),
        F.when(lang == "en", "jpg").when(lang == "fr", "png").when(lang == "de", "pdf").otherwise("PNG").alias("filetype"),
        F.when(lang == "en", "image/jpeg").when(lang == "de", "application/pdf").otherwise("image/png").alias("mimetype"),
        F.col("url").alias("url_private"),
        F.when(lang == "de", F.lit(None).cast("int")).otherwise(F.col("n_chars").cast("int")).alias("original_w"),
    )
    g = dj.groupBy("msg").agg(
        F.min_by("source", "doc_id").alias("source"),
        F.min_by("text", "doc_id").alias("text0"),
        F.sort_array(F.collect_list(F.struct("doc_id", file.alias("f")))).alias("fs"),
        F.min("lang").alias("lang_lo"),
        F.max("lang").alias("lang_hi"),
    )
    sites = F.array(*[F.lit(row[0]) for row in SITE_GPS])
    channel = F.coalesce(
        F.try_element_at(sites, F.substring("source", 4, 10).try_cast("int") + 1),
        F.concat(F.lit("ao-"), F.col("source")),
    )
    secs = F.lit(PHOTO_TS_BASE) + F.pmod(F.col("msg") * 104729, F.lit(PHOTO_TS_SPAN))
    ts = F.concat(_s(secs), F.lit("."), F.lpad(_s(F.pmod(F.col("msg"), F.lit(1000000))), 6, "0"))
    user = F.concat(F.lit("U"), F.upper("source"))
    text = F.concat(F.lit("Photos by <@"), user, F.lit("> with <@UX"), _s("msg"), F.lit("> "), F.col("text0"))
    only_es = (F.col("lang_lo") == "es") & (F.col("lang_hi") == "es")
    files = F.when(~only_es, F.transform("fs", lambda x: x["f"]))
    return g.select(channel.alias("channel"), ts.alias("ts"), user.alias("user"), text.alias("text"), files.alias("files"))


def photo_members(base: DataFrame) -> DataFrame:
    """Member list: one member per document source; sources ending in 0 or 5 have no display name."""
    src = base.select("source").distinct()
    blank = F.col("source").endswith("0") | F.col("source").endswith("5")
    return src.select(
        F.concat(F.lit("U"), F.upper("source")).alias("id"),
        F.struct(
            F.when(blank, F.lit("")).otherwise(F.concat(F.lit("Pax "), F.col("source"))).alias("display_name"),
            F.concat(F.lit("Real Name "), F.col("source")).alias("real_name"),
        ).alias("profile"),
    )


def photo_contents(base: DataFrame) -> DataFrame:
    """File bytes by file id (the document text, UTF-8)."""
    return base.select(F.concat(F.lit("F"), _s("doc_id")).alias("file_id"), F.encode("text", "UTF-8").alias("content"))


def photo_seen(base: DataFrame, as_of=PHOTO_AS_OF) -> DataFrame:
    """Seen-checksum state: md5 of every photo posted before the archived month."""
    from rollcall.functions import periods
    from rollcall.operators import photos as P

    start, _end = periods.previous_month_bounds(as_of)
    lo = (start - _dt.datetime(1970, 1, 1)).total_seconds()
    msgs = photo_messages(base).where(F.col("ts").try_cast("double") < F.lit(lo))
    flat = P.flatten_files(msgs).where(F.col("file_is_photo"))
    # hash before joining: only file ids and checksums are shuffled, not the bytes
    sums = photo_contents(base).select("file_id", F.md5("content").alias("checksum"))
    return flat.select("file_id").join(sums, "file_id").select("checksum").distinct()
