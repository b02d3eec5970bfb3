"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased. Keys of at least ``MIN_CHARS`` code points belong to the first
document that holds them: the least id of the first batch. All its lines with
the key stay, those of other documents go.

The keys seen so far are kept as runs: tables of 128-bit line hashes with the
owner's id, bucketed and sorted by hash. A batch is reduced to one row a key
(partial aggregates first, so a line that a third of all documents share
costs one row a task), shuffled once into the runs' buckets, and merged with
each run in turn; what no run holds is written as a new run of level 0. As soon
as a level has ``fanout`` runs they are merged into one of the next level, so
there are at most ``fanout - 1`` runs a level, a logarithmic number in all, and
a key is rewritten once a level. Neither runs nor batches cross the network a second time.

A line stays if its (document, hash) is an owner's, so lines are joined on a key
that begins with the document: a common line makes no hot key. Only ids, line numbers and
hashes are joined; a text meets the numbers of its lost lines and is cut once.

Defined results: a null or empty text is one empty line; rows with an equal id
are one document, each rewritten by itself; rows without an id count as one
document with the largest id; a text that loses every line becomes empty;
an empty table gives an empty table; columns that clash are replaced.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import WS, bind, clean_columns, remove_folder, workspace, write_table

MIN_CHARS = 10
#: Runs of a level that are merged into one of the next.
FANOUT = 3
#: Batches, in ascending order of the id, that a whole table is taken in.
BATCHES = 4
#: The id that rows without one are counted under.
NO_ID = 2**63 - 1
HASH = ["h1", "h2"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column) -> Column:
    """The key of each \\n-split line of a text, in order."""
    ascii_only = F.octet_length(text) == F.length(text)  # then the fast function does the same
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.transform(F.split(lowered, "\n", -1), lambda x: F.btrim(x, F.lit(WS)))


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` with its text made whole and the two columns that name a row: the id, and the text's hash, as equal ids may hold different texts."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"text": whole, "__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__version": F.xxhash64(whole)})


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(__doc, __version, pos, h1, h2) of every line whose key has at least ``min_chars`` code points."""
    lines = _identified(docs.select("doc_id", "text")).select("__doc", "__version", F.posexplode(line_keys(F.col("text"))).alias("pos", "key"))
    return lines.where(F.length("key") >= min_chars).select("__doc", "__version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(LOWER), "key").alias("h2"))


class LineRuns:
    """The hashes of all lines seen so far, in levelled sorted runs below ``root``.

    Each run is a bucketed, sorted external table; ``buckets`` should equal the
    session's shuffle partitions, then a batch meets the runs without a further shuffle.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.root = root or workspace(spark, "line-runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = defaultdict(list)

    def runs(self) -> list[DataFrame]:
        """The runs, those of the highest level (the largest) first."""
        return [self.spark.table(name) for level in sorted(self.levels, reverse=True) for name in self.levels[level]]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch (__doc, h1, h2) and return its run: the keys first seen in it, with their owners. It stays until the next batch."""
        self._compact()
        fresh = lines.groupBy(*HASH).agg(F.min("__doc").alias("__doc"))
        for run in self.runs():
            # an outer join: a plain anti join would be moved below the aggregate, where a common line is one row a document
            met = fresh.join(run.select(*HASH, F.col("__doc").alias("owner")).hint("merge"), HASH, "left")
            fresh = met.where(F.col("owner").isNull()).drop("owner")
        return self.spark.table(self._write(fresh, 0))

    def owned(self) -> DataFrame:
        """(h1, h2, __doc) of every key seen so far."""
        runs = self.runs()
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def drop(self) -> None:
        """Forget all runs and delete their files."""
        for names in self.levels.values():
            for name in names:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels.clear()
        remove_folder(self.spark, self.root)

    def _write(self, df: DataFrame, level: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(self.buckets, *HASH)
        out = df.write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH)
        out.option("path", f"{self.root}/level-{level}/{name}").saveAsTable(name)
        self.levels[level].append(name)
        return name

    def _compact(self) -> None:
        """Merge full levels upwards. The merged run is complete before those it is made of are deleted; until then a key is held twice, which no join minds."""
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names = self.levels[level]
            merged = self.spark.table(names[0])
            for name in names[1:]:
                merged = merged.unionByName(self.spark.table(name))
            # bucket by bucket: grouping by the bucket columns keeps a bucket's rows in one task
            self._write(merged.groupBy(*HASH).agg(F.min("__doc").alias("__doc")), level + 1)
            for name in names:
                self.spark.sql(f"DROP TABLE {name}")
                remove_folder(self.spark, f"{self.root}/level-{level}/{name}")
            self.levels[level] = []
            level += 1


def lost_lines(lines: DataFrame, owned: DataFrame) -> DataFrame:
    """(__doc, __version, lost): the ascending numbers of the lines whose key another document owns."""
    gone = lines.join(owned.select("__doc", *HASH), ["__doc", *HASH], "left_anti")
    return gone.groupBy("__doc", "__version").agg(F.sort_array(F.collect_set("pos")).alias("__lost"))


def _without(text: Column, lost: Column) -> Column:
    """The text without its lines numbered in ``lost`` (ascending): the slices between them, each line copied once."""

    def cut(lines: Column) -> Column:
        def parts(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(-1))
            return F.array_join(F.flatten(F.transform(ends, lambda p, i: F.slice(lines, before(i) + 2, p - before(i) - 1))), "\n")

        return bind(F.concat(lost, F.array(F.size(lines))), parts)

    return bind(F.split(text, "\n", -1), cut)


def drop_lines(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs`` with the lines numbered in ``lost`` cut out of ``text``, and n_lines (before) and n_dropped."""
    named = _identified(clean_columns(docs, "n_lines", "n_dropped", "__doc", "__version", "__lost"))
    met = named.join(lost, ["__doc", "__version"], "left")
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return met.withColumns(
        {
            "n_lines": n_lines.cast("long"),
            "n_dropped": F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).cast("long"),
            "text": F.when(F.col("__lost").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__lost"))),
        }
    ).drop("__doc", "__version", "__lost")


def dedup_batch(docs: DataFrame, runs: LineRuns, min_chars: int = MIN_CHARS) -> DataFrame:
    """One batch of documents against all batches before it, which ``runs`` remembers; its own lines are added to ``runs``."""
    folder = workspace(docs.sparkSession, "line-batch")
    lines = write_table(line_hashes(docs, min_chars), f"{folder}/lines")
    lost = write_table(lost_lines(lines, runs.add(lines)), f"{folder}/lost")
    remove_folder(docs.sparkSession, f"{folder}/lines")
    return drop_lines(docs, lost)


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS) -> DataFrame:
    """A whole table, taken in batches of ascending ids, so that each key stays with the least id that holds it.

    Returns ``docs`` with the rewritten ``text`` (null becomes empty), n_lines and n_dropped.
    """
    spark = docs.sparkSession
    folder = workspace(spark, "line-dedup")
    lines = write_table(line_hashes(docs, min_chars), f"{folder}/lines")
    cuts = lines.agg(F.percentile_approx("__doc", [i / batches for i in range(1, batches)]).alias("q")).first()["q"] or []
    edges = [None, *sorted(set(cuts)), None]
    runs = LineRuns(spark, f"{folder}/runs", fanout)
    for low, high in zip(edges, edges[1:]):
        batch = lines if low is None else lines.where(F.col("__doc") > low)
        runs.add(batch if high is None else batch.where(F.col("__doc") <= high))
    lost = write_table(lost_lines(lines, runs.owned()), f"{folder}/lost")
    runs.drop()
    remove_folder(spark, f"{folder}/lines")
    return drop_lines(docs, lost)
