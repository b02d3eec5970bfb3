"""Readers: JSON exports, image bytes, schema conformance, region list, table fallback, column add."""

import json
import os

from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.operators import catalog as K
from rollcall.operators import photos as P
from rollcall.sources import tables as S


def test_json_exports_and_flatten(spark, tmpdir_path):
    msgs = [
        {"channel": "c1", "ts": "1736035200.000100", "user": "U1", "text": "hi <@U2>",
         "files": [{"id": "F1", "filetype": "png", "mimetype": "image/png", "url_private": "u", "original_w": 10}]},
        {"channel": "c1", "ts": "1736035300.000100", "user": "U2", "text": "no files"},
    ]
    members = [{"id": "U1", "profile": {"display_name": "", "real_name": "One Real"}},
               {"id": "U2", "profile": {"display_name": "Two", "real_name": "Two Real"}}]
    mdir, udir = os.path.join(tmpdir_path, "m"), os.path.join(tmpdir_path, "u")
    os.makedirs(mdir), os.makedirs(udir)
    for i, m in enumerate(msgs):  # two pages of history, as two files
        with open(os.path.join(mdir, f"page{i}.json"), "w") as f:
            f.write(json.dumps(m) + "\n")
    with open(os.path.join(udir, "members.json"), "w") as f:
        f.write("\n".join(json.dumps(m) for m in members))
    flat = P.flatten_files(S.read_messages(spark, mdir))
    assert flat.count() == 2
    rows = P.photo_rows(flat, S.read_members(spark, udir)).collect()
    assert [(r.text, r.pax) for r in rows] == [("hi @Two", "@One_Real")]


def test_image_bytes_source(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "img")
    os.makedirs(os.path.join(d, "2025-01"))
    for name, data in (("F1.png", b"abc"), ("F2.jpg", b"xyz")):
        with open(os.path.join(d, "2025-01", name), "wb") as f:
            f.write(data)
    df = S.read_image_bytes(spark, d)
    got = {r.file_id: r.checksum for r in df.select("file_id", F.md5("content").alias("checksum")).collect()}
    assert got == {"F1": "900150983cd24fb0d6963f7d28e17f72", "F2": "d16fb36f0911f878998c136191af705e"}
    assert S.read_image_bytes(spark, d, glob="*.png").count() == 1


def test_conform_adds_missing_columns_and_try_casts(spark):
    df = spark.createDataFrame([("r1", "S1", "ao", "x")], "region string, channel_id string, ao string, junk string")
    out = S.conform(df, schemas.AOS)
    assert out.columns == ["region", "channel_id", "ao", "site_q_user_id"]
    assert out.first().site_q_user_id is None
    att = spark.createDataFrame([("r1", "u", "S1", "q", "not a date")], "region string, user_id string, ao_id string, q_user_id string, date string")
    assert S.conform(att, schemas.BD_ATTENDANCE).first().date is None


def test_region_list_prefix_and_deny_list(spark):
    names = spark.createDataFrame([("f3alpha",), ("f3csra",), ("beta",), ("f3texarcana",)], "schema_name string")
    got = sorted(r.region for r in S.region_list(names, ["f3csra"]).collect())
    assert got == ["f3alpha", "f3texarcana"]
    df = spark.createDataFrame([("f3alpha", 1), ("f3texarcana", 2), ("zeta", 3)], "region string, v int")
    kept = S.restrict_regions(df, S.region_list(names), ["f3texarcana"])
    assert [r.region for r in kept.collect()] == ["f3alpha"]


def test_table_fallback_and_site_lead_column(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS achievement_awarded (id long, pax_id string) USING parquet")
    assert spark.table(K.resolve_table(spark, "achievements_awarded_missing", "achievement_awarded")).columns == ["id", "pax_id"]
    spark.sql("CREATE TABLE IF NOT EXISTS aos_t (region string, channel_id string, ao string) USING parquet")
    K.ensure_site_lead_column(spark, "aos_t")
    K.ensure_site_lead_column(spark, "aos_t")
    assert spark.table("aos_t").columns == ["region", "channel_id", "ao", "site_q_user_id"]


def _region(spark, root, name, **replaced):
    """One region's four tables as folders; ``replaced`` gives other DataFrames, or None for no table."""
    tables = {
        "users": spark.createDataFrame([("u1", "a@x", "A"), ("u2", "b@x", "B")], "user_id string, email string, user_name string"),
        "bd_attendance": spark.createDataFrame([("u1", "S1", "u2", "2025-03-01")], "user_id string, ao_id string, q_user_id string, date string"),
        "beatdowns": spark.createDataFrame([("S1", "2025-03-01", "u2", "Regular")], "ao_id string, bd_date string, q_user_id string, backblast string"),
        "aos": spark.createDataFrame([("S1", "ao-one")], "channel_id string, ao string"),
    } | replaced
    for table, df in tables.items():
        if df is not None:
            df.write.parquet(os.path.join(root, name, table))


def test_a_bad_region_is_reported_and_left_out(spark, tmpdir_path):
    _region(spark, tmpdir_path, "f3good")
    _region(spark, tmpdir_path, "f3also", aos=spark.createDataFrame([("S1", "ao-one", "u1")], "channel_id string, ao string, site_q_user_id string"))
    _region(spark, tmpdir_path, "f3nocolumn", users=spark.createDataFrame([("u1", "A")], "user_id string, user_name string"))
    _region(spark, tmpdir_path, "f3type", bd_attendance=spark.createDataFrame([("u1", "S1", "u2", 7.5)], "user_id string, ao_id string, q_user_id string, date double"))
    _region(spark, tmpdir_path, "f3nested", aos=spark.createDataFrame([(["S1"], "ao")], "channel_id array<string>, ao string"))
    _region(spark, tmpdir_path, "f3notable", beatdowns=None)
    _region(spark, tmpdir_path, "f3broken", aos=None)
    os.makedirs(os.path.join(tmpdir_path, "f3broken", "aos"))
    with open(os.path.join(tmpdir_path, "f3broken", "aos", "part-0.parquet"), "w") as f:
        f.write("not parquet")
    regions = ["f3good", "f3also", "f3nocolumn", "f3type", "f3nested", "f3notable", "f3broken", "f3absent"]
    found, failures = S.read_regions(spark, regions, S.parquet_regions(spark, tmpdir_path))
    bad = {(r.region, r.table) for r in failures.collect()}
    assert bad == {("f3nocolumn", "users"), ("f3type", "bd_attendance"), ("f3nested", "aos"), ("f3notable", "beatdowns"), ("f3broken", "aos")} | {("f3absent", t) for t in S.ATTENDANCE_TABLES}
    assert all(r.reason for r in failures.collect())
    reasons = {r.region: r.reason for r in failures.collect()}
    assert reasons["f3nocolumn"] == "no column email" and reasons["f3type"] == "column date is double, not date"
    for table in S.ATTENDANCE_TABLES:
        assert {r.region for r in found[table].collect()} == {"f3good", "f3also"}
        assert found[table].columns == getattr(schemas, table.upper()).fieldNames()
    assert {r.region: r.site_q_user_id for r in found["aos"].collect()} == {"f3good": None, "f3also": "u1"}


def test_no_good_region_gives_empty_tables(spark, tmpdir_path):
    found, failures = S.read_regions(spark, ["f3absent"], S.parquet_regions(spark, tmpdir_path))
    assert failures.count() == 4 and all(df.count() == 0 for df in found.values())


def test_tables_stored_by_event_join_without_an_exchange(spark):
    import datetime as dt

    from rollcall.operators import facts as Fa
    from rollcall.sources import fixtures as X

    sf = "/root/testdata/sf0.01"
    plain = {"users": X.normalised_users(spark, sf), "bd_attendance": X.normalised_attendance(spark, sf),
             "beatdowns": X.normalised_beatdowns(spark, sf), "aos": X.normalised_aos(spark, sf)}
    S.store_by_event(spark, plain, "rc_stored", buckets=4)
    stored = [spark.table(f"rc_stored.{t}") for t in S.ATTENDANCE_TABLES]
    want = sorted(map(tuple, Fa.event_posts(*plain.values()).collect()))
    posts = Fa.event_posts(*stored)
    assert sorted(map(tuple, posts.collect())) == want and len(want) > 1000
    keep = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1MB"}
    old = {k: spark.conf.get(k) for k in keep}
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        # users and sites are dimensions and may be broadcast; the two large tables are not
        large = [df.hint("merge") if name == "bd_attendance" else df for name, df in zip(S.ATTENDANCE_TABLES, stored)]
        plan = Fa.event_posts(*large, since=dt.date(1998, 1, 1))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    join = plan[plan.index("SortMergeJoin"):]
    assert "RLike" not in join.split("\n")[0] and "RLIKE" not in join.split("\n")[0]


def test_the_write_up_meets_no_attendance(spark):
    from rollcall.operators import facts as Fa
    from rollcall.sources import fixtures as X

    sf = "/root/testdata/sf0.001"
    tables = [spark.createDataFrame(df.collect(), df.schema) for df in (X.normalised_users(spark, sf), X.normalised_attendance(spark, sf), X.normalised_beatdowns(spark, sf), X.normalised_aos(spark, sf))]
    plan = Fa.event_posts(*tables)._jdf.queryExecution().optimizedPlan().toString()
    first = min(i for i, line in enumerate(plan.split("\n")) if "Join Inner" in line)
    for line in plan.split("\n")[: first + 1]:
        assert "backblast" not in line and "RLIKE" not in line.upper()
    assert all("RLIKE" not in line.upper() for line in plan.split("\n") if "Join " in line)
