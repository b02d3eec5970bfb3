"""Near-duplicates by Order MinHash and banded alignment.

Words are hashed; a text's k-mers are its runs of five words, labelled by
occurrence so that repeats are distinct. Each of ``sketches`` hash orders
selects the ``ell`` least labelled k-mers; put back into text order and hashed
they are one band of the signature (texts of few k-mers, whose bands agree less often,
get twice as many). Texts that share a band are candidates. They are verified by
aligning their k-mer sequences: labels are unique within a text, so the
longest common subsequence is the longest increasing one among the shared
labels, searched within the band of diagonals that a similarity of
``threshold`` allows. With L aligned k-mers, similarity = L / (n1 + n2 - L).
Before their texts are fetched candidates are compared by 512 one-bit MinHash values: a
pair at the threshold differs in more bits than are allowed with a probability of 1e-12.

Scale: equal texts, whatever their ids, are first reduced to one. In every bucket
each member meets the one of the least number and the shortest one, which joins large groups of
copies, however large. After that only buckets that still hold several
classes are searched, and only between classes: those of at most ``SMALL`` members pair by pair.
Larger ones come from passages that many texts share; no pair within them is formed.
Their members go a second way, which is exact: a pair at the threshold must share a k-mer
among the rarest fifth of each text (the prefix filter of set similarity joins; any common order
is exact, and a table of counts of a fixed size tells what is frequent), and
how far down that fifth it comes bounds the other text's length. Where texts have enough k-mers of their
own, as texts with a common passage do, nothing is shared there, and they are
done. What is left are texts made of little else than common passages: if two of them are
similar, each is similar to a shorter one too, so members of a large bucket of a rare k-mer meet
its shortest ones, in turns, and leave as soon as no text is short enough for them.

Classes are the connected components of the links, found by spreading the
least number with pointer jumping; nothing but counts, ``SLOTS`` at most, reaches the driver. Only
texts that share a bucket are shuffled.

Defined results: a null text is the empty text, texts without words are one
class, and a text of one to four words has one k-mer; equal texts are one class whatever
their ids; rows with a repeated id each have the class of their own text (such an id names
a class only if no other id can); a row without an id has its text's class, which
is named null if no row of it has an id; ties of similarity at the threshold count; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import ascii_words, bounded_batches, collected, stage_table

K = 5
SKETCHES = 20
ELL = 3
THRESHOLD = 0.8
#: Texts of at most so many k-mers get twice as many bands.
SHORT = 8
#: Members of a bucket that is searched pair by pair; those of larger ones go the exact second way.
SMALL = 32
#: Members of a rare k-mer's bucket that is searched pair by pair, and the shortest ones that those of a larger one meet in a turn.
RARE, TURN = 256, 64
#: Slots of the table that k-mers are counted in, and those of it that are sent as one row; powers of two.
SLOTS, BLOCK = 1 << 20, 1 << 10
#: Bits of the sketch that candidates are compared by before their texts are fetched; a multiple of 64.
BITS = 512
#: Standard deviations by which the sketches of a pair at the threshold may differ more than expected.
SIGMAS = 7.0
SEED = 0x5DEECE66D
#: What a member is compared by: its length, its class, its sketch, and the number of its k-mers before the bucket's one.
HEAD = ("id", "n", "c", "sketch", "pos")
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * STEP
    return x ^ (x >> np.uint64(29))


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of a text's k-mers in text order, made distinct by the number of the occurrence."""
    w = words.astype(np.int64).view(np.uint64)
    if not len(w):
        return w
    width = min(k, len(w))
    h = np.zeros(len(w) - width + 1, np.uint64)
    for d in range(width):
        h = _mixed(h * MIX + w[d : d + len(h)] + np.uint64(d + 1))
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return h
    at = np.arange(len(h))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(occurrence > 0, _mixed(h + occurrence * MIX), h)


def signature(kmers: np.ndarray, sketches: int = SKETCHES, ell: int = ELL, seed: int = SEED) -> np.ndarray:
    """``sketches`` hashes of tuples: under each hash order the ``ell`` least k-mers, in text order."""
    if not len(kmers):
        return np.zeros(0, np.int64)
    seeds = _mixed(np.arange(1, sketches + 1, dtype=np.uint64) * MIX + np.uint64(seed))
    out = np.empty(sketches, np.uint64)
    rows = max(1, 2_000_000 // len(kmers))
    for i in range(0, sketches, rows):
        orders = (kmers[None, :] ^ seeds[i : i + rows, None]) * STEP
        if len(kmers) > ell:
            at = np.sort(np.argpartition(orders, ell - 1, axis=1)[:, :ell], axis=1)
            chosen = kmers[at]
        else:
            chosen = np.broadcast_to(kmers, orders.shape)
        code = seeds[i : i + rows].copy()
        for c in range(chosen.shape[1]):
            code = _mixed(code * MIX + chosen[:, c])
        out[i : i + rows] = code
    return out.view(np.int64)


def bit_sketch(kmers: np.ndarray, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """One bit of the least k-mer under each of ``bits`` hash orders, packed: two texts of Jaccard similarity J differ in (1 - J) / 2 of the bits."""
    seeds = _mixed(np.arange(1, bits + 1, dtype=np.uint64) * STEP + np.uint64(seed))
    least = np.empty(bits, np.uint64)
    rows = max(1, 500_000 // max(1, len(kmers)))
    for i in range(0, bits, rows):
        least[i : i + rows] = ((kmers[None, :] ^ seeds[i : i + rows, None]) * STEP).min(axis=1)
    return np.packbits((_mixed(least) & np.uint64(1)).astype(bool)).view(np.int64)


def most_differing_bits(threshold: float = THRESHOLD, bits: int = BITS) -> int:
    """Bits that the sketches of a pair at ``threshold`` differ in at most, ``SIGMAS`` deviations above the mean."""
    p = (1 - threshold) / 2
    return int(bits * p + SIGMAS * (bits * p * (1 - p)) ** 0.5)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two sequences of labelled k-mers by banded alignment; 0.0 as soon as it cannot reach ``threshold``."""
    order = np.argsort(a)
    return _aligned(a[order], order, b, threshold)


def _aligned(ranked: np.ndarray, order: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """``aligned`` for a first sequence given as its k-mers in ascending order and their positions."""
    n, m = len(ranked), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < threshold * max(n, m):
        return 0.0
    need = threshold / (1 + threshold) * (n + m)
    at = np.minimum(np.searchsorted(ranked, b), n - 1)
    ib = np.flatnonzero(ranked[at] == b)
    if len(ib) < need - 1e-9:
        return 0.0
    ia = order[at[ib]]
    ia = ia[np.abs(ia - ib) <= n + m - 2 * need + 1e-9]
    if len(ia) < need - 1e-9:
        return 0.0
    common = len(ia)
    if not (np.diff(ia) > 0).all():
        tails: list[int] = []
        for x in ia.tolist():
            j = bisect_left(tails, x)
            tails[j : j + 1] = [x]
        common = len(tails)
    return common / (n + m - common)


def _bands(k: int, sketches: int, ell: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kmers = [labelled_kmers(np.asarray(w, np.int64), k) for w in batch["words"]]
            signs = [signature(x, sketches * 2 if len(x) <= SHORT else sketches, ell) for x in kmers]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "n_kmers": [len(x) for x in kmers], "signature": signs})

    return of


def _sketches(k: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "sketch": [bit_sketch(labelled_kmers(np.asarray(w, np.int64), k)) for w in batch["words"]]})

    return of


def _slots(kmers: np.ndarray, slots: int) -> np.ndarray:
    return (_mixed(kmers * MIX) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def _slot_counts(k: int, slots: int):
    """How many k-mers fall into each slot, in blocks of ``BLOCK`` slots; a task adds up its texts before it sends them on."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            for w in batch["words"]:
                np.add.at(counts, _slots(labelled_kmers(np.asarray(w, np.int64), k), slots), 1)
        blocks = counts.reshape(-1, min(BLOCK, slots))
        at = np.flatnonzero(blocks.any(axis=1))
        yield pd.DataFrame({"block": at, "counts": list(blocks[at])})

    return of


def _block_sums(parts: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": parts["block"].iloc[:1], "counts": [np.sum(parts["counts"].tolist(), axis=0)]})


def _rarest(k: int, threshold: float, shared):
    """The rarest k-mers of each text by the counts of their slots, but those that are alone in theirs, as no other text has them."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for batch in batches:
            for i, w in zip(batch["id"], batch["words"], strict=True):
                kmers = labelled_kmers(np.asarray(w, np.int64), k)
                n, found = len(kmers), counts[_slots(kmers, len(counts))]
                order = np.lexsort((kmers, found))[: n - int(np.ceil(n * threshold - 1e-9)) + 1]
                alone = int(np.searchsorted(found[order], 1, "right"))
                for at in range(alone, len(order), 100_000):
                    part = order[at : at + 100_000]
                    yield pd.DataFrame({"band": kmers[part].view(np.int64), "id": i, "n": n, "pos": np.arange(at, at + len(part))})

    return of


def connected(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, class_id): the least id of each node's component. ``links`` (a, b) joins ids of ``nodes`` (id).

    In each round a node takes the least of its own class, its neighbours' and
    its class's class, until nothing changes. A node with very many
    links meets plain joins, which Spark splits, and partial minima.
    """
    both = stage_table(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    if both.isEmpty():
        return nodes.select("id", F.col("id").alias("class_id"))
    linked = both.select(F.col("a").alias("id")).distinct().withColumn("class_id", F.col("id"))
    while True:
        named = linked.select(F.col("id").alias("b"), F.col("class_id").alias("c"))
        near = both.join(named, "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        above = linked.select(F.col("id").alias("class_id"), F.col("class_id").alias("up"))
        met = linked.join(near, "id").join(above, "class_id")
        linked = stage_table(met.select("id", F.col("class_id").alias("before"), F.least("class_id", "c", "up").alias("class_id")), "classes")
        if linked.where(F.col("before") != F.col("class_id")).isEmpty():
            break
        linked = linked.select("id", "class_id")
    return nodes.join(linked.select("id", "class_id"), "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def _met(members: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a < b) of each bucket's members (band, HEAD) with its ``heads`` (band, heads: a bounded list) of other classes that lengths, places and sketches allow.

    A shared k-mer with i of a text's k-mers before it leaves n - i for what the two can share. The
    list is filtered before it is exploded: only what may be similar becomes a row.
    """

    def fits(h: Column) -> Column:
        shared = F.least(F.col("n") - F.col("pos"), h["n"] - h["pos"])
        need = (F.col("n") + h["n"]) * (threshold / (1 + threshold)) - 1e-6
        differing = sum((F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get(h["sketch"], F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
        near = (F.col("c") != h["c"]) & (F.least("n", h["n"]) >= threshold * F.greatest("n", h["n"])) & (shared >= need)
        return near & (differing <= most_differing_bits(threshold))

    met = members.join(heads, "band").select("id", F.explode(F.transform(F.filter("heads", fits), lambda h: h["id"])).alias("h"))
    return met.select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")).distinct()


def _split(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of the buckets that hold several classes, with their classes ``c``, the bucket's size and the length of its shortest member."""
    known = members.drop("c").join(classes.select("id", F.col("class_id").alias("c")), "id")
    open_ = known.groupBy("band").agg(F.count("*").alias("size"), F.min("n").alias("shortest"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return known.join(open_.where(F.col("c0") != F.col("c1")).select("band", "size", "shortest"), "band")


def _lists(members: DataFrame) -> DataFrame:
    """(band, heads): the members of each bucket as a list; for buckets of a bounded size only."""
    return members.groupBy("band").agg(F.collect_list(F.struct(*HEAD)).alias("heads"))


def _shortest(members: DataFrame, k: int) -> DataFrame:
    """The ``k`` shortest members of each bucket; tasks keep no more than these before they send them on."""
    order = Window.partitionBy("band").orderBy("n", "id")
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _prefixes(wide: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(band, id, n, pos) for each k-mer among the rarest of a text of ``wide`` (id) that another text may have among its rarest too.

    Any order that all texts share will do. Here: ascending by the number of k-mers in the k-mer's slot of a
    table of ``SLOTS``, which is never below the number of texts that have it, ties by the k-mer; with n k-mers
    the first n - ceil(threshold * n) + 1. ``pos`` k-mers of the text come before it. The table has a fixed size, so
    it is broadcast, and the others of a text's k-mers are neither written nor sent.
    """
    spark = texts.sparkSession
    chosen = stage_table(texts.join(wide, "id", "left_semi"), "wide-texts")
    schema = "block long, counts array<long>"
    parts = chosen.select("words").mapInPandas(_slot_counts(k, SLOTS), schema).groupBy("block").applyInPandas(_block_sums, schema)
    counts = np.zeros(SLOTS, np.int64)
    blocks = counts.reshape(-1, min(BLOCK, SLOTS))
    for block, sums in zip(*collected(parts), strict=True):
        blocks[block] = sums
    shared = spark.sparkContext.broadcast(counts)
    return chosen.mapInPandas(_rarest(k, threshold, shared), "band long, id long, n long, pos long")


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (id, class_id) after further ``links`` (a, b): the components of the classes that they join."""
    of_a = classes.select(F.col("id").alias("a"), F.col("class_id").alias("ca"))
    of_b = classes.select(F.col("id").alias("b"), F.col("class_id").alias("cb"))
    between = links.select("a", "b").join(of_a, "a").join(of_b, "b").where(F.col("ca") != F.col("cb"))
    between = stage_table(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "class-links")
    if between.isEmpty():
        return classes
    joined = between.select(F.col("a").alias("id")).union(between.select(F.col("b").alias("id"))).distinct()
    new = connected(between, joined).select(F.col("id").alias("class_id"), F.col("class_id").alias("into"))
    return stage_table(classes.join(new, "class_id", "left").select("id", F.coalesce("into", "class_id").alias("class_id")), "classes")


def _second_way(wide: DataFrame, sketches: DataFrame, classes: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Classes (id, class_id) after all texts of ``wide`` (id) have been compared by their rarest k-mers."""
    rare = stage_table(_prefixes(wide, texts, k, threshold), "rare")
    several = rare.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > 1).select("band")
    buckets = stage_table(rare.join(several, "band", "left_semi").join(sketches, "id"), "rare-buckets")
    while True:
        split = stage_table(_split(buckets, classes), "rare-split")
        if split.isEmpty():
            return classes
        small, large = split.where(F.col("size") <= RARE), split.where(F.col("size") > RARE)
        leaders = stage_table(_shortest(large, TURN), "leaders")
        heads = _lists(small).union(_lists(leaders))
        classes = _merged(classes, _verified(_met(split, heads, threshold), texts, k, threshold))
        rest = large.drop("size", "shortest").join(leaders.select("band", "id"), ["band", "id"], "left_anti")
        left = _split(rest, classes)
        # longer partners than this cannot share enough with what comes after the k-mer
        longest = (F.col("n") - F.col("pos")) * ((1 + threshold) / threshold) - F.col("n") + 1e-6
        buckets = stage_table(left.where(longest >= F.col("shortest")).drop("size", "shortest"), "later")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, words) are aligned to at least ``threshold``."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # texts of the batch and, while they are small, of those before it
        held = 0
        for batch in batches:
            sims = []
            if held > 2_000_000:
                known, held = {}, 0
            for a, x, b, y in zip(batch["a"], batch["x"], batch["b"], batch["y"], strict=True):
                for i, words in ((a, x), (b, y)):
                    if i not in known:
                        kmers = labelled_kmers(np.asarray(words, np.int64), k)
                        order = np.argsort(kmers)
                        known[i] = kmers, kmers[order], order
                        held += len(kmers)
                sims.append(_aligned(*known[a][1:], known[b][0], threshold))
            out = batch[["a", "b"]].assign(similarity=np.array(sims, float))
            yield out[out["similarity"] >= threshold - 1e-9]

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(check, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, sketches: int = SKETCHES, ell: int = ELL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id (the least id of its class), copy_of (the least id with an equal text)."""
    return _classed(docs.select("doc_id", "text"), k, threshold, sketches, ell).drop("__digest", "__class")


def _hashed(docs: DataFrame) -> DataFrame:
    words = ascii_words(F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(words, lambda w: F.hash(w)).alias("words"), F.md5(F.array_join(words, " ")).alias("digest"))


def _classed(docs: DataFrame, k: int, threshold: float, sketches: int, ell: int) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    hashed = _hashed(docs)
    signed = stage_table(hashed.mapInPandas(_bands(k, sketches, ell), "doc_id long, digest string, n_kmers long, signature array<long>"), "signatures")
    # one node for each distinct text, numbered when it is written
    owned = signed.groupBy("digest").agg(F.min("doc_id").alias("copy_of"))
    copies = stage_table(owned.select("digest", "copy_of", F.monotonically_increasing_id().alias("id")), "copies")
    bands = signed.dropDuplicates(["digest"]).join(copies.select("digest", "id"), "digest")
    bands = bands.select("id", F.col("n_kmers").alias("n"), F.posexplode("signature").alias("j", "code"))
    buckets = stage_table(bands.select("id", "n", F.xxhash64("j", "code").alias("band")), "buckets")
    least = stage_table(buckets.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.min(F.struct("n", "id"))["id"].alias("shortest")).where(F.col("size") > 1), "least")
    shared = stage_table(buckets.join(least.select("band"), "band"), "shared")
    nodes = stage_table(shared.select("id").distinct(), "nodes")
    involved = nodes.join(copies, "id").select("id", "digest")
    texts = stage_table(hashed.join(involved, "digest").dropDuplicates(["id"]).select("id", "words"), "member-texts")
    sketched = stage_table(texts.mapInPandas(_sketches(k), "id long, sketch array<long>"), "sketches")
    members = stage_table(shared.join(sketched, "id").select("band", "id", "n", F.col("id").alias("c"), "sketch", F.lit(0).cast("long").alias("pos")), "members")
    picked = least.select("band", F.explode(F.array_distinct(F.array("first", "shortest"))).alias("id"))
    heads = stage_table(_lists(members.join(picked, ["band", "id"], "left_semi")), "heads")

    links = stage_table(_verified(_met(members, heads, threshold), texts, k, threshold), "links-1")
    classes = stage_table(connected(links, nodes), "classes-1")
    split = stage_table(_split(members, classes), "split")
    small = split.where(F.col("size") <= SMALL)
    classes = _merged(classes, _verified(_met(small, _lists(small), threshold), texts, k, threshold))
    wide = stage_table(_split(split.where(F.col("size") > SMALL).drop("size", "shortest"), classes).select("id").distinct(), "wide")
    if not wide.isEmpty():
        classes = _second_way(wide, sketched, classes, texts, k, threshold)
    joined = stage_table(copies.join(classes, "id", "left").select("digest", "copy_of", F.coalesce("class_id", "id").alias("class")), "text-classes")
    rows = stage_table(signed.select("doc_id", "digest").join(joined, "digest"), "classed-rows")
    # an id of several texts names a class only if the class has no other
    whose = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("class") != F.max("class")).alias("several"))
    ids = rows.select("class", "doc_id").distinct().join(whose, "doc_id")
    named = ids.groupBy("class").agg(F.coalesce(F.min(F.when(~F.col("several"), F.col("doc_id"))), F.min("doc_id")).alias("class_id"))
    out = rows.join(stage_table(named, "class-names"), "class", "left")
    return out.select("doc_id", "class_id", "copy_of", F.col("digest").alias("__digest"), F.col("class").alias("__class"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each class with the columns of ``docs``: a row of the least id, of the least text digest where that id has several texts."""
    settings = {"k": K, "threshold": THRESHOLD, "sketches": SKETCHES, "ell": ELL} | options
    classed = _classed(docs.select("doc_id", "text"), **settings)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__digest")
    heads = classed.groupBy("__class").agg(F.min(order).alias("h")).select("h.doc_id", F.col("h.__digest").alias("digest"))
    renamed = docs.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")})
    digest = F.md5(F.array_join(ascii_words(F.coalesce("text", F.lit(""))), " "))
    keyed = renamed.withColumn("__digest", digest)
    met = keyed.join(heads, keyed["doc_id"].cast("long").eqNullSafe(heads["doc_id"]) & (keyed["__digest"] == heads["digest"]), "left_semi")
    # rows equal in id and words: one of them
    kept = met.dropDuplicates(["doc_id", "__digest"])
    return kept.select(*[F.col(c if c in ("doc_id", "text") else f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
