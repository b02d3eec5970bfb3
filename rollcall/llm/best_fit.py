"""Best-fit packing into bins of several permitted sequence lengths.

A document's length is its number of tokens (``count_tokens``). Documents longer
than the largest length are cut into full pieces and a rest. The pieces are dealt by hash to blocks of bounded size; in each block
they are placed longest first into the open bin with the least room that
still takes them. Where none does, a bin is opened at the permitted length
with the least cost for each token it can expect to hold, given what is left
to place; at the end every bin is downsized to the least permitted length
that holds its contents.

Defined results: a null or empty text has length 0 and takes no room: one
piece with no bin; repeated rows are pieces of their own; an empty table
gives an empty table. No piece is dropped and no text is cut off.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import ascii_words, bounded_batches, stage_table

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces a block is meant to hold; a block is one task's work.
BLOCK = 50_000


def attention_cost(length: int, hidden: int = 4096) -> float:
    """Training cost of a sequence in token units: linear layers, attention that grows with the square, a fixed share for each sequence."""
    return length * (1 + length / (6 * hidden)) + 32


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = attention_cost) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit of ``sizes`` (each 1 to max(lengths)), longest first: bin and offset of each size, and the length of each bin."""
    lengths = tuple(sorted(lengths))
    costs = [cost(x) for x in lengths]
    order = np.argsort(-sizes, kind="stable")
    at_bin, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    opened: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    left = int(sizes.sum())
    for i in order:
        size = int(sizes[i])
        j = bisect_left(rooms, size)
        if j < len(rooms):
            room = rooms[j]
            same = by_room[room]
            b = same.pop()
            if not same:
                del by_room[room], rooms[j]
        else:
            fits = range(bisect_left(lengths, size), len(lengths))
            best = min(fits, key=lambda c: (costs[c] / min(lengths[c], left), lengths[c]))
            b, room = len(opened), lengths[best]
            opened.append(room)
            used.append(0)
        at_bin[i], at[i] = b, used[b]
        used[b] += size
        left -= size
        room -= size
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return at_bin, at, [lengths[bisect_left(lengths, u)] for u in used]


@functools.lru_cache(maxsize=1)
def _encoding(ranks: bytes, pattern: str):
    """The encoder of a worker process, which serves all its tasks."""
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens) per row: the tokens of the whole text by a rank file, without special tokens; 0 for a null text.

    The file (under 1 MB) is read on the driver and broadcast. Each row is counted where it is read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(shared.value, pattern).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": [len(encode(t)) for t in batch["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(counted, "doc_id long, n_tokens long")


def pieces_of(docs: DataFrame, length: Column, largest: int) -> DataFrame:
    """(doc_id, piece, start, length): every document cut at multiples of ``largest``; a document without length has one empty piece."""
    n = F.greatest(F.ceil(length / largest), F.lit(1)).cast("int")
    cut = docs.select("doc_id", length.cast("long").alias("__total"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(largest), F.col("__total") - start).cast("int").alias("length"))


def best_fit_packing(docs: DataFrame, length: Column | None = None, lengths: tuple[int, ...] = LENGTHS, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, bin_offset, bin_length.

    ``length`` counts a document's tokens, as ``count_tokens`` does (by default its words). Only ids
    and lengths are shuffled. Blocks come from a hash of the piece and a
    running row number, so neither copies nor repeated ids gather in one; their
    number follows the count of pieces, so a block's memory does not grow.
    """
    length = F.size(ascii_words(F.coalesce("text", F.lit("")))) if length is None else length
    pieces = stage_table(pieces_of(docs, F.coalesce(length, F.lit(0)), max(lengths)).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") > 0)
    n_blocks = max(1, -(-full.count() // block))
    dealt = full.withColumn("__block", F.pmod(F.xxhash64("__row"), F.lit(n_blocks)))

    def packed(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, ends = pack(rows["length"].to_numpy(np.int64), lengths)
        out = rows[["doc_id", "piece", "start", "length"]].astype({"doc_id": "Int64"})
        return out.assign(bin_id=keys[0] * (1 << 32) + bins, bin_offset=offsets, bin_length=np.array(ends, np.int64)[bins])

    schema = "doc_id long, piece int, start long, length int, bin_id long, bin_offset long, bin_length long"
    none = F.lit(None).cast("long")
    empty = pieces.where(F.col("length") <= 0).select("doc_id", "piece", "start", "length", none.alias("bin_id"), none.alias("bin_offset"), none.alias("bin_length"))
    return dealt.groupBy("__block").applyInPandas(packed, schema).unionByName(empty)


__all__ = ["LENGTHS", "attention_cost", "best_fit_packing", "count_tokens", "pack", "pieces_of"]
