"""Classifier edge cases: regex dialect, Kleene NULL logic, the 100-character window."""

import pytest
from pyspark.sql import functions as F

from rollcall.functions.classify import event_class, is_qsource, is_workout

CASES = [
    # (backblast, ao, is_qsource, is_workout)
    (None, "QSource", True, False),  # NULL write-up at a QSource site: passes on the site
    (None, "ao-park", False, False),  # NULL write-up at a workout site: in no class
    ("ran 3.1 miles today", "ao-park", True, False),  # optional q: "3.1 " counts as a lesson
    ("q\rsource lesson", "ao-park", True, False),  # '.' matches \r
    ("q\nsource lesson", "ao-park", False, True),  # '.' stops at \n
    ("lesson 3.1\u00a0done", "ao-park", True, False),  # no-break space after the number (Unicode white space)
    ("x" * 100 + "qsource", "ao-park", False, True),  # match only after character 100
    ("Q SOURCE 2.4 ", "ao-park", True, False),  # lower-cased first
    ("Regular beatdown", "Rucking Club", False, False),  # ruck site: not a workout
    ("Regular beatdown", "ao-the-q-source", True, False),  # site name alone makes a QSource
    ("ends with 3.1", "ao-park", False, True),  # needs white space after the number
]


@pytest.mark.parametrize("bb,ao,qs,w", CASES)
def test_classifier(spark, bb, ao, qs, w):
    df = spark.createDataFrame([(bb, ao)], "backblast string, ao string")
    row = df.select(is_qsource().alias("qs"), is_workout().alias("w"), event_class().alias("c")).first()
    assert (row.qs, row.w) == (qs, w)
    assert row.c == ("qsource" if qs else "workout" if w else "other")


def test_no_python_udf_in_plan(spark):
    df = spark.createDataFrame([("a", "b")], "backblast string, ao string").select(is_qsource(), is_workout())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert df.where(F.lit(True)).count() == 1
