"""Award catalogue, award tables, trophy view and sinks (U32, U33, SNK1-SNK6).

One table per logical table with a ``region`` partition column, instead of
one schema per region. Set-up is idempotent (``IF NOT EXISTS``; seeds only for
regions without a list); the source drops and recreates both award tables,
which is not reproduced. NOT NULL columns are enforced while writing
(``raise_error`` in the projection), since file tables do not enforce them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.constants import AWARD_CATALOGUE
from rollcall.functions import periods

LIST_TABLE = "achievements_list"
AWARDED_TABLE = "achievements_awarded"
AWARDED_TABLE_FALLBACK = "achievement_awarded"
VIEW_NAME = "achievements_view"
TEXT_LENGTH = 255


def catalogue_seed(spark: SparkSession) -> DataFrame:
    """U32: the 14 automatic awards, ids 1..14 in catalogue order."""
    rows = [(i, name, desc, verb, code) for i, (name, desc, verb, code) in enumerate(AWARD_CATALOGUE, start=1)]
    return spark.createDataFrame(rows, "id int, name string, description string, verb string, code string")


def seed_lists(regions: DataFrame) -> DataFrame:
    """The seed list for every region of ``regions`` (one row per region and award, via explode, no cross join)."""
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
    return regions.select("region", F.explode(seed).alias("a")).select("region", "a.*")


def not_null(df: DataFrame, columns: Iterable[str], table: str) -> DataFrame:
    """Fail the write on a NULL in a NOT NULL column (checked inside the write's own projection)."""
    checked = set(columns)
    cols: list[Column] = []
    for c in df.columns:
        if c in checked:
            cols.append(
                F.when(F.col(c).isNull(), F.raise_error(F.lit(f"NULL in NOT NULL column {table}.{c}")))
                .otherwise(F.col(c))
                .alias(c)
            )
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def _ddl(table: str, schema, location: str | None, partition: str = "region") -> str:
    cols = []
    for f in schema.fields:
        if f.name == partition:
            continue
        null = "" if f.nullable else " NOT NULL"
        cols.append(f"{f.name} {f.dataType.simpleString()}{null}")
    cols.append(f"{partition} {schema[partition].dataType.simpleString()}")
    loc = f" LOCATION '{location}'" if location else ""
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(cols)}) USING parquet PARTITIONED BY ({partition}){loc}"


def create_tables(spark: SparkSession, database: str | None = None, location: str | None = None) -> None:
    """SNK2: the two award tables, if they do not exist yet: lists by region, awards by the run that recorded them.

    A history kept under its older singular name is used as it is.
    """
    prefix = f"{database}." if database else ""
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    wanted = [(LIST_TABLE, schemas.ACHIEVEMENTS_LIST, "region")]
    if not spark.catalog.tableExists(prefix + AWARDED_TABLE_FALLBACK):
        wanted.append((AWARDED_TABLE, schemas.AWARDED_BY_RUN, "run_date"))
    for name, schema, partition in wanted:
        path = f"{location}/{name}" if location else None
        spark.sql(_ddl(prefix + name, schema, path, partition))


def seed_missing_lists(spark: SparkSession, regions: DataFrame, table: str = LIST_TABLE) -> None:
    """SNK3: insert the seed list for regions that have no list yet (re-running adds nothing).

    Regions that deleted awards from their list keep their edits.
    """
    existing = spark.table(table).select("region").distinct()
    todo = seed_lists(regions.join(existing, "region", "left_anti"))
    out = not_null(todo, ["id", "name", "description", "verb", "code"], table)
    out.select(*spark.table(table).columns).write.insertInto(table)


def ensure_column(spark: SparkSession, table: str, column: str, type_: str) -> bool:
    """Add a nullable column to a table; no-op when present, also when another session adds it meanwhile. True if it was added."""
    if column in spark.table(table).columns:
        return False
    try:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({column} {type_})")
    except AnalysisException:
        spark.catalog.refreshTable(table)
        if column not in spark.table(table).columns:
            raise
        return False
    return True


def ensure_site_lead_column(spark: SparkSession, table: str) -> None:
    """SNK4: add the nullable ``site_q_user_id`` column to a site table."""
    ensure_column(spark, table, "site_q_user_id", "string")


def resolve_table(spark: SparkSession, *names: str) -> str:
    """The first of the names that is a table or view of the catalog."""
    for name in names:
        if spark.catalog.tableExists(name):
            return name
    raise ValueError(f"no table {' or '.join(names)}")


def award_tables(spark: SparkSession, database: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """SRC4/SRC6: (award list, award history, name of the history table).

    Some regions have the history table under its older singular name; it is
    used when the plural one does not exist.
    """
    prefix = f"{database}." if database else ""
    name = resolve_table(spark, prefix + AWARDED_TABLE, prefix + AWARDED_TABLE_FALLBACK)
    return spark.table(resolve_table(spark, prefix + LIST_TABLE)), spark.table(name), name


def trophy_view(users: DataFrame, awarded: DataFrame, award_list: DataFrame) -> DataFrame:
    """Users x awarded x list, per region.

    Columns: region, pax, pax_id, name, description, date_awarded.
    """
    u = users.select("region", F.col("user_id").alias("pax_id"), F.col("user_name").alias("pax"))
    a = awarded.select("region", "pax_id", "achievement_id", "date_awarded")
    lst = award_list.select("region", F.col("id").alias("achievement_id"), "name", "description")
    return (
        u.join(a, ["region", "pax_id"])
        .join(lst, ["region", "achievement_id"])
        .select("region", "pax", "pax_id", "name", "description", "date_awarded")
    )


def create_trophy_view(spark: SparkSession, users: str, awarded: str, award_list: str, name: str = VIEW_NAME) -> None:
    """SNK5: CREATE OR REPLACE VIEW over three catalog tables: stored in the catalog, so every session sees it."""
    spark.sql(f"""
        CREATE OR REPLACE VIEW {name} AS
        SELECT u.region, u.user_name AS pax, u.user_id AS pax_id, l.name, l.description, a.date_awarded
        FROM {users} u
        JOIN {awarded} a ON u.region = a.region AND u.user_id = a.pax_id
        JOIN {award_list} l ON a.region = l.region AND a.achievement_id = l.id""")


def awarded_rows(new: DataFrame, created: Column | None = None) -> DataFrame:
    """SNK1 rows: award rows with id, created and updated filled like the table defaults.

    ``id`` is a 63-bit hash of the award row plus its position among identical
    rows (a per-site award can repeat), so re-running the write gives the same ids.
    """
    keys = ["region", "achievement_id", "pax_id", "date_awarded"]
    dup = Window.partitionBy(*keys).orderBy(*keys)
    ts = created if created is not None else F.current_timestamp()
    with_dup = new.select(*keys).withColumn("dup", F.row_number().over(dup))
    return with_dup.select(
        "region",
        F.xxhash64(*keys, "dup").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).alias("id"),
        F.col("achievement_id").cast("int").alias("achievement_id"),
        "pax_id",
        "date_awarded",
        ts.alias("created"),
        ts.alias("updated"),
    )


def record_run(rows: DataFrame, as_of, table: str | None = None, path: str | None = None) -> None:
    """SNK1: make ``rows`` the awards recorded by the run of ``as_of``, replacing that run's partition only.

    ``rows`` are all awards of the run, those an earlier attempt recorded
    included, and may not be read from the target itself (stage them). The rebalance
    hint keeps the files few and lets Spark split a region with very many awards.
    """
    run = periods.to_pydate(as_of)
    rows = not_null(rows, ["id", "achievement_id", "pax_id", "date_awarded", "created", "updated"], AWARDED_TABLE)
    rows = rows.hint("rebalance", "region")
    spark = rows.sparkSession
    if table is not None:
        columns = [c for c in spark.table(table).columns if c != "run_date"]
        if "run_date" not in spark.table(table).columns:
            raise ValueError(f"{table} has no run_date partition: recreate it with create_tables")
        view = f"run_{uuid.uuid4().hex}"
        rows.select(*columns).createOrReplaceTempView(view)
        try:
            spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (run_date = DATE'{run.isoformat()}') SELECT * FROM {view}")
        finally:
            spark.catalog.dropTempView(view)
    elif path is not None:
        dated = rows.drop("run_date").withColumn("run_date", F.lit(run))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)
    else:
        raise ValueError("table or path")


def append_notifications(notes: DataFrame, path: str, replace_run: bool = False) -> None:
    """SNK6: outgoing messages as rows (kind, region, target, text, run_date); delivery is a separate consumer.

    Partitioned by (kind, run_date). ``replace_run`` overwrites only this run's
    partitions (dynamic overwrite), so rerunning a job for the same date
    replaces its messages.
    """
    writer = notes.write.partitionBy("kind", "run_date")
    if replace_run:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)
