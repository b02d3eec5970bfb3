"""Photo archive: file flattening, mention rewrite, dedup, manifest fields, month bounds."""

import datetime as dt

from rollcall.functions.periods import previous_month_bounds
from rollcall.operators import photos as P
from rollcall import schemas


def ts(d: dt.datetime) -> str:
    return f"{int((d - dt.datetime(1970, 1, 1)).total_seconds())}.000100"


def _messages(spark):
    f = lambda i, t, w: (i, t, "image/x", f"https://files/{i}", w)
    rows = [
        ("ao-the-bayou", ts(dt.datetime(2025, 1, 5, 12)), "U1", "hi <@U2> and <@U9>", [f("F1", "PNG", 640), f("F2", "pdf", None)]),
        ("general", ts(dt.datetime(2025, 1, 6, 12)), "U2", "no files", None),
        ("general", ts(dt.datetime(2025, 1, 7, 12)), "U2", "empty list", []),
        ("general", ts(dt.datetime(2025, 1, 8, 12)), "U3", "same bytes", [f("F3", "jpg", 100)]),
        ("general", ts(dt.datetime(2024, 12, 31, 23)), "U1", "last year", [f("F4", "jpg", 100)]),
    ]
    return spark.createDataFrame(rows, schemas.MESSAGES)


def _members(spark):
    return spark.createDataFrame(
        [("U1", ("", "Real One")), ("U2", ("Two Dee", "R2")), ("U3", (None, "R3"))], schemas.MEMBERS
    )


def test_flatten_null_versus_empty_files(spark):
    flat = P.flatten_files(_messages(spark)).collect()
    by_text = {}
    for r in flat:
        by_text.setdefault(r.text, []).append(r)
    assert len(by_text["no files"]) == 1 and by_text["no files"][0].file_is_photo is False
    assert "empty list" not in by_text
    assert [r.file_is_photo for r in sorted(by_text["hi <@U2> and <@U9>"], key=lambda r: r.file_id)] == [True, False]


def test_month_bounds_in_january():
    assert previous_month_bounds(dt.date(2025, 1, 15)) == (dt.datetime(2024, 12, 1), dt.datetime(2025, 1, 1))


def test_rows_dedup_and_manifest(spark):
    msgs = P.in_previous_month(_messages(spark), dt.date(2025, 2, 10))
    rows = P.photo_rows(P.flatten_files(msgs), _members(spark))
    got = {r.file_id: r for r in rows.collect()}
    assert set(got) == {"F1", "F3"}
    assert got["F1"].text == "hi @Two_Dee and <@U9>"  # unknown mention stays
    assert got["F1"].pax == "@Real_One"  # empty display name falls back to the real name
    assert got["F1"].date == dt.date(2025, 1, 5)
    assert got["F3"].pax is None
    contents = spark.createDataFrame([("F1", b"abc"), ("F3", b"abc"), ("F4", b"zzz")], "file_id string, content binary")
    dedup = P.dedup_photos(rows, contents, None).collect()
    assert [r.file_id for r in dedup] == ["F1"]  # same bytes: earliest post kept
    seen = spark.createDataFrame([("900150983cd24fb0d6963f7d28e17f72",)], "checksum string")
    assert P.dedup_photos(rows, contents, seen).count() == 0
    man = P.photo_manifest(P.dedup_photos(rows, contents, None)).first()
    assert man.target_name == "F1.jpg" and man.target_filetype == "jpg"
    assert man.exif_date == "2025:01:05 06:30:00"
    assert man.gps_lat_ref == "N" and man.gps_lat == "38/1,48/1,4513/100"
    assert man.description == "Posted by: @Real_One\nPosted on: 2025-01-05\nPosted in:ao-the-bayou\n\nhi @Two_Dee and <@U9>"


def test_description_is_cut_at_1000_characters(spark):
    long = "x" * 5000
    msgs = spark.createDataFrame([("c", ts(dt.datetime(2025, 1, 5)), "U1", long, [("F1", "jpg", "m", "u", 1)])], schemas.MESSAGES)
    rows = P.photo_rows(P.flatten_files(msgs), _members(spark))
    contents = spark.createDataFrame([("F1", b"q")], "file_id string, content binary")
    man = P.photo_manifest(P.dedup_photos(rows, contents, None)).first()
    assert len(man.description) == 1000


def test_repeated_messages_and_members_and_missing_file_ids(spark):
    f = lambda i: (i, "jpg", "image/x", "u", 1)
    when = ts(dt.datetime(2025, 1, 5))
    rows = [("c", when, "U1", "hi <@U2>", [f("F1"), f(None)]), ("c", when, "U1", "hi <@U2>", [f("F1"), f(None)]), ("c", when, "U1", None, [f("F2")])]
    members = _members(spark).unionByName(_members(spark))
    got = P.photo_rows(P.flatten_files(spark.createDataFrame(rows, schemas.MESSAGES)), members).collect()
    assert sorted(str(r.file_id) for r in got) == ["F1", "F1", "F2", "None", "None"]
    assert {r.text for r in got} == {"hi @Two_Dee", None} and {r.pax for r in got} == {"@Real_One"}
