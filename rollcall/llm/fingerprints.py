"""Order MinHash fingerprints of texts, with DataFrame functions only.

A text is its sequence of words; its k-mers are runs of five words (one
shorter run for fewer words), each numbered by occurrence so that repeats are
distinct. The hash of a numbered k-mer deals it to one of ``bins`` bins; in
each bin the ``ell`` smallest are selected, put back into text order and
hashed as a tuple. Two texts agree in a bin only if they share these k-mers
in the same order, which falls with the edit distance and not only with the
overlap. One hash order dealt to bins, in place of one order per component,
keeps the work at n log n for a text. Bins empty in both texts say nothing
about them and are left out of the likeness.

Defined results: a null text counts as empty; texts without words have the
fingerprint of empty bins, alike (1.0) only to each other; equal texts have
equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollcall.llm.common import ascii_words, bind

K = 5
BINS = 16
ELL = 2


def _kmer_hashes(words: Column, k: int) -> Column:
    def of_words(w: Column) -> Column:
        last = F.greatest(F.size(w) - k, F.lit(0))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(k)]))
        )

    return bind(words, of_words)


def _numbered(hashes: Column) -> Column:
    """Sorted structs (h, i) of k-mers numbered by occurrence: h is the k-mer's hash, mixed with its number from the second on."""

    def by_occurrence(ranked: Column) -> Column:
        begins = F.transform(ranked, lambda x, i: F.when(F.coalesce(F.get(ranked, i - 1)["h"] == x["h"], F.lit(False)), F.lit(-1)).otherwise(i))
        counts = lambda s: F.flatten(F.transform(s, lambda a, j: F.sequence(F.lit(0), F.coalesce(F.get(s, j + 1), F.size(ranked)) - a - 1)))
        labelled = lambda occ: F.transform(
            ranked, lambda x, i: F.struct(F.when(F.get(occ, i) == 0, x["h"]).otherwise(F.xxhash64(x["h"], F.get(occ, i))).alias("h"), x["i"].alias("i"))
        )
        return bind(F.filter(begins, lambda x: x >= 0), lambda s: F.sort_array(bind(counts(s), labelled)))

    def ranked(h: Column) -> Column:
        plain = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), plain).otherwise(bind(plain, by_occurrence))

    return bind(hashes, ranked)


def order_minhash(text: Column, k: int = K, bins: int = BINS, ell: int = ELL) -> Column:
    """The fingerprint: for each bin with k-mers, ascending, a string of the bin (2 hexadecimal digits) and the tuple's hash (8).

    ``bins`` is a power of two up to 256. The top bits of a hash give its bin,
    so the bins are runs of the sorted k-mers and the first ``ell`` of each
    run are found in one pass.
    """
    shift = 64 - (bins.bit_length() - 1)
    bin_of = lambda x: F.shiftrightunsigned(x["h"], shift)

    def component(chosen: Column, head: Column, j: Column) -> Column:
        tail = F.slice(chosen, j + 1, ell)
        in_order = F.sort_array(F.transform(F.filter(tail, lambda x: bin_of(x) == bin_of(head)), lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"))))
        code = F.xxhash64(F.transform(in_order, lambda x: x["h"])).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.concat(F.lower(F.lpad(F.hex(bin_of(head)), 2, "0")), F.lower(F.lpad(F.hex(code), 8, "0")))

    def of_chosen(chosen: Column) -> Column:
        new_bin = lambda j: F.coalesce(bin_of(F.get(chosen, j - 1)) != bin_of(F.get(chosen, j)), F.lit(True))
        return F.sort_array(F.filter(F.transform(chosen, lambda x, j: F.when(new_bin(j), component(chosen, x, j))), lambda c: c.isNotNull()))

    def of_ranked(ranked: Column) -> Column:
        smallest = F.filter(ranked, lambda x, i: F.coalesce(bin_of(F.get(ranked, i - ell)) != bin_of(x), F.lit(True)))
        return bind(smallest, of_chosen)

    return bind(_numbered(_kmer_hashes(ascii_words(F.coalesce(text, F.lit(""))), k)), of_ranked)


def likeness(a: Column, b: Column) -> Column:
    """The share of the bins used by either fingerprint in which both agree; 1.0 for two fingerprints without bins."""
    used = F.size(F.array_union(F.transform(a, lambda x: F.left(x, F.lit(2))), F.transform(b, lambda x: F.left(x, F.lit(2)))))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def _blocks(docs: DataFrame, rows: int) -> list[int]:
    """Ids at which blocks of about ``rows`` documents begin, ascending, the least id first. One number a block reaches the driver."""
    ids = docs.agg(F.count("*").alias("n"), F.min("__key").alias("least")).first()
    if not ids["n"]:
        return []
    n = -(-ids["n"] // rows)
    cuts = docs.agg(F.percentile_approx("__key", [j / n for j in range(1, n)], max(10_000, 50 * n)).alias("cuts")).first()["cuts"] if n > 1 else []
    return sorted({ids["least"], *cuts})


def _block_of(key: Column, starts: list[int]) -> Column:
    """How many block starts are at most ``key``, less one, by binary search in the constant array."""
    table = F.lit(starts) if starts else F.array().cast("array<bigint>")
    steps = [1 << s for s in reversed(range(max(1, len(starts)).bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step < len(starts)) & (F.get(table, at + step) <= key), at + step).otherwise(at))


def with_next_text(docs: DataFrame, rows: int = 4096) -> DataFrame:
    """``doc_id, text, fp`` plus ``next_text, next_fp`` of the next document by ascending doc_id; after the last, the first.

    The documents go to blocks of consecutive ids, and the first document of
    a block also to the block before it, so each text crosses the network
    about once and no task holds more than a block. Null ids come first;
    equal ids are taken in the order of their texts.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    src = docs.withColumn("__key", key)
    starts = _blocks(src, rows)
    block = _block_of(F.col("__key"), starts)
    first = F.col("__key").isin(starts) if len(starts) < 64 else F.get(F.lit(starts), F.col("__block")) == F.col("__key")
    before = F.pmod(F.col("__block") - 1, F.lit(max(1, len(starts))))
    placed = src.withColumn("__block", block).withColumn(
        "__at", F.explode(F.when(first, F.array(F.struct(F.col("__block").alias("b"), F.lit(False).alias("copy")), F.struct(before.alias("b"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("__block").alias("b"), F.lit(False).alias("copy")))))
    )
    w = Window.partitionBy("__b").orderBy("__copy", "__key", "text")
    rest = [c for c in docs.columns]
    out = placed.select(*rest, "__key", F.col("__at.b").alias("__b"), F.col("__at.copy").alias("__copy"))
    return out.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)}).where(~F.col("__copy")).drop("__key", "__b", "__copy")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has the last floor(n/2) of the n code points replaced by
    the first as many (or all) of the next document.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", order_minhash(F.col("text")))
    pairs = with_next_text(base)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    out = pairs.withColumn("edited", edited).withColumn("edited_fp", order_minhash(F.col("edited")))
    return out.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("fp", ".").alias("fingerprint"),
        F.array_join("edited_fp", ".").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
