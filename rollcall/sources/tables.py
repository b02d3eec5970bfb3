"""Readers for the logical tables.

Every logical table carries a ``region`` column: one plan for all regions
instead of one query per region schema. Sources:

* Parquet / any file format (``read_table``), the default for tests and lakes.
* One folder or JDBC schema per region (``read_regions``): each opened and checked
  by itself, tagged with ``region`` and unioned lazily; a region that fails is
  reported and left out. JDBC reads are partitioned when a numeric column and bounds are given.
* Catalog tables, attendance and events bucketed by event (``store_by_event``).
* JSON exports (messages, members) and ``binaryFile`` image bytes (photos).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall import schemas
from rollcall.constants import REGION_PREFIX


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its file system; a path that cannot be examined raises."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def conform(df: DataFrame, schema) -> DataFrame:
    """Project ``df`` onto ``schema``: missing nullable columns become NULL, types are cast with try_cast.

    This is how a region whose ``aos`` table lacks ``site_q_user_id`` (added
    later by the set-up step) still takes part instead of failing the run.
    """
    cols = []
    present = set(df.columns)
    for field in schema.fields:
        if field.name in present:
            cols.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def region_list(regions: DataFrame, exclude: Iterable[str] = (), column: str = "schema_name") -> DataFrame:
    """Region schemas to process: ``LIKE 'f3%'`` and not in the deny list."""
    out = regions.where(F.col(column).startswith(REGION_PREFIX))
    exclude = list(exclude)
    if exclude:
        out = out.where(~F.col(column).isin(exclude))
    return out.select(F.col(column).alias("region"))


def restrict_regions(df: DataFrame, regions: DataFrame | None, exclude: Iterable[str] = ()) -> DataFrame:
    """Keep rows of selected regions (semi join with the region list) and drop deny-listed ones."""
    exclude = list(exclude)
    if exclude:
        df = df.where(~F.col("region").isin(exclude))
    if regions is not None:
        df = df.join(regions.select("region"), "region", "left_semi")
    return df


#: Columns that a region's table may lack: they are NULL then.
OPTIONAL_COLUMNS = {"aos": {"site_q_user_id"}, "beatdowns": {"coq_user_id", "backblast"}}
FAILURES = "region string, table string, reason string"
#: What a region's tables hold; ``region`` itself is added when they are read.
ATTENDANCE_TABLES = ("users", "bd_attendance", "beatdowns", "aos")


def schema_problem(df: DataFrame, target, optional: Iterable[str] = ()) -> str | None:
    """Why ``df`` cannot be read as ``target``: a column that is missing or of a type without the target's values. None if it can."""
    found = {f.name: f.dataType for f in df.schema.fields}
    for field in target.fields:
        if field.name == "region" or (field.name not in found and field.name in optional):
            continue
        if field.name not in found:
            return f"no column {field.name}"
        kind = found[field.name]
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            return f"column {field.name} is {kind.simpleString()}, not {field.dataType.simpleString()}"
        if isinstance(field.dataType, T.DateType) and not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.NullType)):
            return f"column {field.name} is {kind.simpleString()}, not date"
    return None


def read_regions(
    spark: SparkSession,
    regions: Iterable[str],
    open_table: Callable[[str, str], DataFrame],
    tables: Iterable[str] = ATTENDANCE_TABLES,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """SRC2 with failure isolation: (table name -> all good regions in one DataFrame, failures).

    ``open_table(region, table)`` opens one region's table, lazily. Each is
    opened and its schema checked before any plan is built: a region of which a
    table is missing, unreadable or of the wrong shape is left out with all
    its tables, and the run goes on without it. ``failures`` has a row for
    each table that failed (region, table, reason). The region list is small;
    the reads stay lazy and are unioned, so Spark runs them as parallel scans.
    """
    tables = list(tables)
    opened: dict[str, list[DataFrame]] = {t: [] for t in tables}
    failures = []
    for region in regions:
        found, before = {}, len(failures)
        for table in tables:
            target = getattr(schemas, table.upper())
            try:
                df = open_table(region, table)
                problem = schema_problem(df, target, OPTIONAL_COLUMNS.get(table, ()))
            except (PySparkException, Py4JError) as e:
                problem = str(e).strip().split("\n")[0]
            if problem is None:
                found[table] = conform(df.drop("region").withColumn("region", F.lit(region)), target)
            else:
                failures.append((region, table, problem))
        if len(failures) == before:
            for table, df in found.items():
                opened[table].append(df)
    out = {}
    for table, frames in opened.items():
        df = frames[0] if frames else spark.createDataFrame([], getattr(schemas, table.upper()))
        for more in frames[1:]:
            df = df.unionByName(more)
        out[table] = df
    return out, spark.createDataFrame(failures, FAILURES)


def parquet_regions(spark: SparkSession, root: str) -> Callable[[str, str], DataFrame]:
    """Opens ``<root>/<region>/<table>``, for ``read_regions``."""
    return lambda region, table: spark.read.parquet(f"{root.rstrip('/')}/{region}/{table}")


def jdbc_regions(
    spark: SparkSession,
    url: str,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
) -> Callable[[str, str], DataFrame]:
    """Opens ``<region>.<table>`` over JDBC, for ``read_regions``. Filters and projections applied later are pushed into each query."""

    def open_table(region: str, table: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"{region}.{table}")
        for k, v in (properties or {}).items():
            reader = reader.option(k, v)
        if partition_column and num_partitions:
            reader = (
                reader.option("partitionColumn", partition_column)
                .option("lowerBound", lower_bound)
                .option("upperBound", upper_bound)
                .option("numPartitions", num_partitions)
            )
        return reader.load()

    return open_table


def read_jdbc_region_tables(spark: SparkSession, url: str, region_schemas: Iterable[str], table: str, **options) -> DataFrame:
    """One table of every region over JDBC, tagged with ``region``; a region that fails fails the read (``read_regions`` isolates it)."""
    found, failures = read_regions(spark, region_schemas, jdbc_regions(spark, url, **options), [table])
    first = failures.first()
    if first is not None:
        raise ValueError(f"{first['region']}.{first['table']}: {first['reason']}")
    return found[table]


def store_by_event(spark: SparkSession, tables: dict[str, DataFrame], database: str, buckets: int) -> None:
    """The attendance tables as catalog tables; attendance and events bucketed and sorted by (region, site, date).

    The national join then meets both sides in their buckets, without an
    exchange: the history is shuffled once, when it is stored, instead of in
    every run. ``buckets`` should keep a bucket near the size of a task's memory share.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    keys = {"bd_attendance": ("region", "ao_id", "date"), "beatdowns": ("region", "ao_id", "bd_date")}
    for name, df in tables.items():
        writer = df.write.format("parquet").mode("overwrite")
        if name in keys:
            df = df.repartition(buckets, *keys[name])  # one file a bucket
            writer = df.write.format("parquet").mode("overwrite").bucketBy(buckets, *keys[name]).sortBy(*keys[name])
        writer.saveAsTable(f"{database}.{name}")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Chat message export (JSON lines) with the nested ``files`` list."""
    return spark.read.schema(schemas.MESSAGES).json(path)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Member list export (JSON lines) with the nested ``profile`` struct."""
    return spark.read.schema(schemas.MEMBERS).json(path)


def read_image_bytes(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    modified_after: str | None = None,
    modified_before: str | None = None,
) -> DataFrame:
    """Image files as (file_path, file_id, content) rows; the file name stem is the file id.

    ``modified_after`` / ``modified_before`` (``YYYY-MM-DDTHH:mm:ss``) prune files
    by modification time at listing, so a monthly run reads only that month's files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    if modified_before:
        reader = reader.option("modifiedBefore", modified_before)
    df = reader.load(path)
    return df.select(
        F.col("path").alias("file_path"),
        F.regexp_extract(F.col("path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("file_id"),
        "content",
    )
