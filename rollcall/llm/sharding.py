"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

How many rows each block of the input sends to each cell of the output is
drawn first, from the exact law that a uniform shuffle of all rows would give
(multivariate hypergeometric, block after block). Then every block permutes
its rows and sends the drawn counts, and every cell permutes what it has
received. A cell is a run of slots of one shard, so shard sizes are exact and
no task ever holds a whole shard. Law: ``rows``, counts at most one apart.

Blocks are made of the partitions in which the rows are read. For N rows
blocks and cells hold about N^0.65 of them each, so there are N^0.35 of both
and the matrix, the only thing the driver holds, has N^0.7 counts: 2,000 for
50,000 rows, 3e7 for 5e10, where a task sorts 9e6 narrow rows.

Defined results: a null text has size 1 and the CRC of no bytes; rows
without an id and repeated rows are rows like any other, each with a slot; an
empty table gives an empty table; more shards than rows leave shards empty.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollcall.llm.common import stage_table

SHARDS = 16
SEED = 20_240_601
#: Rows of a block, and slots of a cell, as a power of the number of rows.
POWER = 0.65


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement are among ``good``; any population size."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    # beyond numpy's range: invert the distribution over twelve deviations around the mode, from ratios of neighbours
    n = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    spread = 12 * (int(math.sqrt(max(1.0, draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1))))) + 1)
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    ratio = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(len(k) - 1, np.searchsorted(chance, rng.random() * chance[-1]))])


def communication_matrix(blocks: list[int], cells: list[int], seed: int = SEED) -> np.ndarray:
    """Counts sent from each block to each cell; rows sum to ``blocks``, columns to ``cells``."""
    if sum(blocks) != sum(cells):
        raise ValueError("blocks and cells must hold the same number of rows")
    rng = np.random.default_rng(seed)
    room = np.array(cells, np.int64)
    out = np.zeros((len(blocks), len(cells)), np.int64)
    for i, rows in enumerate(blocks):
        if room.sum() < 10**9:
            out[i] = rng.multivariate_hypergeometric(room, rows, method="marginals")
            room -= out[i]
            continue
        rest, left = int(room.sum()), int(rows)
        for j in range(len(room)):
            rest -= int(room[j])
            out[i, j] = hypergeometric(rng, int(room[j]), rest, left) if left else 0
            left -= int(out[i, j])
        room -= out[i]
    return out


def cells_of(rows: int, shards: int, cell: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, size) of every cell: shards at most one row apart, each cut into equal cells of about ``cell`` slots."""
    out = []
    for s in range(shards):
        size = rows // shards + (s < rows % shards)
        parts = max(1, -(-size // cell))
        cuts = [size * p // parts for p in range(parts + 1)]
        out += [(s, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return out


def shard_rows(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, cell: int | None = None) -> DataFrame:
    """``rows`` with shard and slot: a uniform random arrangement, every shard gapless from slot 0.

    The rows are written once to the shared folder so that counting and
    sending see the same blocks; pass narrow rows and join wide ones after.
    """
    spark: SparkSession = rows.sparkSession
    own = [c for c in rows.columns]
    kept = stage_table(rows.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "shard-rows")
    n = kept.count()
    if not n:
        return rows.withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    cell = cell or math.ceil(n**POWER)
    n_blocks = -(-n // cell)
    block = F.pmod(F.col("__part"), F.lit(n_blocks)) if n_blocks > 1 else F.lit(0)
    dealt = kept.withColumn("__block", block.cast("int"))
    counts = {r["__block"]: r["count"] for r in dealt.groupBy("__block").count().collect()}
    ids = sorted(counts)
    cells = cells_of(n, shards, cell)
    sent = communication_matrix([counts[b] for b in ids], [c[2] for c in cells], seed)
    ends = np.cumsum(sent, axis=1)
    plan = [(b, [int(x) for x in ends[i]]) for i, b in enumerate(ids)]
    spans = spark.createDataFrame(plan, "__block int, __ends array<long>")
    order = lambda salt: [F.xxhash64(F.lit(seed + salt), "__row"), F.col("__row")]
    at = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__block").orderBy(*order(1))) - 1)
    cell_of = F.size(F.filter("__ends", lambda e: e <= F.col("__at")))
    placed = at.join(spans, "__block").withColumn("__cell", cell_of).drop("__ends", "__at", "__block")
    where = spark.createDataFrame([(i, s, a) for i, (s, a, _) in enumerate(cells)], "__cell int, shard int, __first long")
    inner = F.row_number().over(Window.partitionBy("__cell").orderBy(*order(2))) - 1
    return placed.withColumn("__inner", inner).join(where, "__cell").select(*own, "shard", (F.col("__first") + F.col("__inner")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``)."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return shard_rows(narrow, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
