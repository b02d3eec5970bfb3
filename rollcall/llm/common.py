"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.session import ensure_checkpoint_dir, stage_table

__all__ = ["WS", "ascii_words", "bind", "bounded_batches", "char_count", "clean_columns", "collected", "read", "remove_folder", "stage_table", "workspace", "write_table"]

#: ASCII white space: space and \x09-\x0D. Everything else is part of a word.
WS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once per row.

    An expression that is named inside a lambda would be evaluated for each
    element; as the element of a one-element array it is a bound variable.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def ascii_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; an empty array for a text without one."""
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t-\\r]+", -1)).otherwise(F.array().cast("array<string>"))


def char_count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns an operator is about to add (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def collected(table: DataFrame) -> list[np.ndarray]:
    """The columns, without nulls, of a table of bounded size, one array each.

    They come as Arrow batches whatever the session's settings: as rows, which
    ``toPandas`` falls back to, half a million counts take 300 MB of the driver.
    """
    return [c.to_numpy(zero_copy_only=False) for c in table.toArrow().combine_chunks().columns]


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch holds: very long texts would make a batch of the default 10,000 rows overflow a worker."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder, not made yet, under the session's shared checkpoint folder, for the tables of one run."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet to ``path`` and read back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of a run that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
