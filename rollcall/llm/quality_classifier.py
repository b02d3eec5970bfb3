"""Quality classifier by importance resampling.

Hashed n-gram generative models are counted for the target texts (labelled good)
and for all raw texts: one over the unigrams and one over the bigrams of the
lower-cased words, where a document counts once for each n-gram it holds, and one
over the bigrams of word shapes (runs of letters, of capitals, of digits, and the marks
between them; a sign for a word repeated at once), which mean the same in every
language and stay dense in small corpora. A document's log importance is made of the
log ratios of its n-grams, target to raw; adding Gumbel noise and taking the k largest
keys samples documents without replacement in proportion to their importance.

The ratios are shrunk towards the raw model. Shapes get pseudo-counts, and their mean
at a common length of ``SCALE`` n-grams counts (a plain sum would let length decide).
Most words are rare and differ by chance: their ratio is 0 unless the target holds at most
``1 / TELLING`` of what its share of the raw counts would be, and that is beyond
chance, against all raw texts or against the labelled ones among them, after a correction
for the n-grams whose counts suffice to show it (the rest cannot pass, so they are not
counted). What is left, insults above all, counts in full, once a document, however long
it is; then shapes like the target's count for nothing.

Texts are turned into arrays of code points, and hashed and counted by array operations in
tasks; no text crosses the network. The tables have a fixed size, so what reaches the
driver is bounded, and so is the broadcast set of labelled ids: at most ``LABELLED``, those of the least hashes.

Defined results: a null or wordless text has no n-grams and log ratio 0; all keys are
finite; rows without an id share one noise value; ties at the threshold are all
taken; repeated rows get equal results; without a target label all ratios
are 0; an empty table gives an empty table; columns that clash are replaced.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from rollcall.llm.common import WS, bounded_batches, clean_columns, collected, workspace, write_table

#: Buckets of the shapes' bigrams, and of the words' unigrams and bigrams each.
BUCKETS, WORD_BUCKETS = 1 << 12, 1 << 18
#: Pseudo-counts each bucket of shapes, and of words, gets in both models.
PRIOR, WORD_PRIOR = 20.0, 1.0
SEED = 17
#: Length, in n-grams, at which documents are compared by shapes, and n-grams of ratio 1 added to each.
SCALE, PADDING = 32.0, 8
#: Log importance below which a document counts as outside the target model: beyond four, Gumbel noise seldom makes up for it.
FLOOR = -4.0
#: How much rarer than in the raw texts a word n-gram must be in the target to count, and how many may do so by chance, over all.
TELLING, FALSE_WORDS = 4.0, 0.1
#: Labelled documents that the models are fitted to, at most; the raw models count every document.
LABELLED = 1_000_000
#: Code points that are held as arrays at once.
SLICE = 1 << 20
UNIGRAM, BIGRAM, SHAPE = 0, 1, 2
SIZES = (WORD_BUCKETS, WORD_BUCKETS, BUCKETS)
SPACE, LETTER, CAPITAL, DIGIT, MARK = range(5)
BASE = np.uint64(0x9E3779B97F4A7C15)
ADDED = ("n_grams", "log_ratio", "log_importance", "gumbel_key", "kept")


# -- n-grams of texts -------------------------------------------------------------

@functools.lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its kind, and its lower-case form where that is one code point."""
    of = {"Lu": CAPITAL} | {c: LETTER for c in ("Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me")} | {c: DIGIT for c in ("Nd", "Nl", "No")}
    kinds = np.array([of.get(unicodedata.category(chr(i)), MARK) for i in range(0x110000)], np.uint8)
    kinds[[ord(c) for c in WS]] = SPACE
    lower = np.arange(0x110000, dtype=np.uint64)
    for i in np.flatnonzero(kinds <= CAPITAL).tolist():
        c = chr(i).lower()
        if len(c) == 1:
            lower[i] = ord(c)
    return kinds, lower


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2 ** 64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _run_hashes(values: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start and a polynomial hash of each maximal run of positions ``inside``."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(20, len(values).bit_length())
    powers, inverses = _powers(size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values + np.uint64(1)) * powers[: len(values)], dtype=np.uint64)])
    return start, _mixed((total[end] - total[start]) * inverses[start] + (end - start).astype(np.uint64))


def _slices(texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The texts joined by \\n in slices of about SLICE code points, with the start of each part and the text it is of. Longer texts are divided at white space."""
    parts: list[tuple[int, str]] = []
    held = 0

    def joined() -> tuple[str, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) + 1 for _, p in parts])
        return "\n".join(p for _, p in parts), np.cumsum(lengths) - lengths, np.array([i for i, _ in parts])

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                found = [x for x in (text.find(c, at + SLICE) for c in WS) if x >= 0]
                end = min(found, default=end)
            parts.append((i, text[at:end]))
            held, at = held + end - at, end + (end < len(text))
            if held >= SLICE:
                yield joined()
                parts, held = [], 0
    if parts:
        yield joined()


def ngrams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For UNIGRAM, BIGRAM and SHAPE: the bucket of each n-gram in text order, and the number of the text it is of (ascending)."""
    kinds, lower = _alphabet()
    words, shapes = [], []
    for text, starts, owners in _slices(texts):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds[points]
        at, h = _run_hashes(lower[points], (kind != SPACE) & (kind != MARK))
        words.append((h, owners[np.searchsorted(starts, at, "right") - 1]))
        solid = kind != SPACE
        at, h = _run_hashes(points.astype(np.uint64), solid)
        # symbols of the shape: a kind, or the mark itself; runs of a kind collapse to one, of a mark to two
        symbol = np.where(kind == MARK, points.astype(np.uint64) + np.uint64(16), kind.astype(np.uint64))
        same = np.concatenate([[False], symbol[1:] == symbol[:-1]])
        dropped = same & (kind != MARK) & solid
        dropped[2:] |= same[2:] & same[1:-1] & (kind[2:] == MARK)
        kept = ~dropped
        _, shape = _run_hashes(symbol[kept], solid[kept])
        shapes.append((h, shape, owners[np.searchsorted(starts, at, "right") - 1]))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, of = map(np.concatenate, zip(*words)) if words else none
    raw, shape, of_shape = map(np.concatenate, zip(*shapes)) if shapes else (none[0], *none)
    follows = np.concatenate([[False], of[1:] == of[:-1]])[: len(of)]
    pair = _mixed(h[:-1] * BASE + h[1:])[follows[1:]] if len(h) else none[0]
    first = np.concatenate([[True], of_shape[1:] != of_shape[:-1]])[: len(of_shape)]
    again = ~first & np.concatenate([[False], raw[1:] == raw[:-1]])[: len(raw)]
    marked = np.where(again, _mixed(shape + np.uint64(1)), shape)
    before = np.where(first, np.uint64(0), np.concatenate([np.zeros(1, np.uint64), marked[:-1]])[: len(marked)])
    found = (h, of), (pair, of[follows]), (_mixed(before * BASE + marked), of_shape)
    return [((x >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64), o) for (x, o), n in zip(found, SIZES, strict=True)]


# -- the models -------------------------------------------------------------------

def classes(labels: DataFrame) -> DataFrame:
    """(doc_id, target): whether all labels of an id are of quality 1 and none is toxic."""
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(good).alias("target"))


def labelled_ids(labels: DataFrame, most: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """The labelled ids, ascending, and whether each is a target; of more than ``most`` those of the least hashes."""
    chosen = classes(labels).select(F.col("doc_id").cast("long").alias("doc_id"), "target").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids, target = collected(chosen)
    order = np.argsort(ids)
    return ids[order], target[order]


def _class(ids: pd.Series, labelled: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each id 0 if it is a target, 1 if it has another label, 2 if none."""
    known, (all_ids, target) = ids.notna().to_numpy(), labelled
    out = np.full(len(ids), 2)
    if len(all_ids):
        wanted = ids[known].to_numpy(np.int64)
        at = np.minimum(np.searchsorted(all_ids, wanted), len(all_ids) - 1)
        out[known] = np.where(all_ids[at] == wanted, np.where(target[at], 0, 1), 2)
    return out


def count_models(docs: DataFrame, labelled: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each model the counts of its buckets in the target, in the labelled and in all raw texts, and for the words the numbers of documents in the last row."""
    shared = docs.sparkSession.sparkContext.broadcast(labelled)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [np.zeros((n + 1, 3), np.int64) for n in SIZES]
        for batch in batches:
            kind = _class(batch["doc_id"], shared.value)
            grams = ngrams(batch["text"].tolist())
            for model in (UNIGRAM, BIGRAM):
                bucket, of = grams[model]
                last = np.zeros(WORD_BUCKETS, np.int64)
                edges = np.searchsorted(of, np.arange(len(batch) + 1))
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    at = np.arange(a, b)
                    last[bucket[a:b]] = at  # of repeated n-grams the last one stays
                    counts[model][bucket[a:b][last[bucket[a:b]] == at], kind[i] :] += 1
                counts[model][-1] += [(kind <= c).sum() for c in range(3)]
            bucket, of = grams[SHAPE]
            for c in range(3):
                counts[SHAPE][:-1, c] += np.bincount(bucket[kind[of] <= c], minlength=BUCKETS)
        for model, c in enumerate(counts):
            at = np.flatnonzero(c[:, 2])
            yield pd.DataFrame({"model": model, "bucket": at, "target": c[at, 0], "labelled": c[at, 1], "raw": c[at, 2]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = texts.mapInPandas(counted, "model int, bucket long, target long, labelled long, raw long")
    model, bucket, *sums = collected(parts.groupBy("model", "bucket").agg(*[F.sum(c).alias(c) for c in ("target", "labelled", "raw")]))
    out = [np.zeros((n + 1, 3), np.int64) for n in SIZES]
    for i, counts in enumerate(out):
        mine = model == i
        for c, column in enumerate(sums):
            counts[bucket[mine], c] = column[mine]
    return out


def shape_ratios(counts: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log ratio, target to raw, of each bucket of shapes; the models' last row is not a bucket."""
    target, _, raw = counts[:-1].T.astype(float)
    if not target.sum():
        return np.zeros(len(target))
    return np.log((target + prior) / (raw * (target.sum() / raw.sum()) + prior))


def beyond_chance(target: np.ndarray, held: np.ndarray, share: float, false_words: float) -> np.ndarray:
    """Whether so few of the ``held`` documents of a bucket are targets that chance explains at most ``false_words`` of all such buckets.

    Chance: the Chernoff bound at ``share`` of targets. A bucket cannot get
    below ``(1 - share) ** held``, so the test is corrected for the buckets only
    that can get below the level which their own number sets.
    """
    if not 0 < share < 1:
        return np.zeros(len(held), bool)
    ranked = np.sort(-np.log1p(-share) * held[held > 0])[::-1]
    unable = np.flatnonzero(ranked < np.log(np.arange(1, len(ranked) + 1) / false_words))
    number = max(1, unable[0] if len(unable) else len(ranked))
    q = np.where(held > 0, target / np.maximum(held, 1), share)
    with np.errstate(divide="ignore", invalid="ignore"):
        nats = held * (np.where(q > 0, q * np.log(q / share), 0.0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0.0))
    return (q < share) & (nats >= np.log(number / false_words))


def word_ratios(counts: np.ndarray, prior: float = WORD_PRIOR, telling: float = TELLING, false_words: float = FALSE_WORDS) -> np.ndarray:
    """Log ratio, target to raw, of each bucket of words that is telling, 0 for the others."""
    target, labelled, raw = counts[:-1].T.astype(float)
    targets, with_label, documents = counts[-1]
    if not targets:
        return np.zeros(len(target))
    ratio = np.log((target + prior) / (raw * (targets / documents) + prior))
    sure = beyond_chance(target, raw, targets / documents, false_words / 2) | beyond_chance(target, labelled, targets / with_label, false_words / 2)
    return np.where(sure & (ratio <= -np.log(telling)), ratio, 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> list[np.ndarray]:
    """The log ratios of the buckets of the three models. Every document counts for the raw models."""
    counts = count_models(docs, labelled_ids(labels))
    return [word_ratios(counts[UNIGRAM]), word_ratios(counts[BIGRAM]), shape_ratios(counts[SHAPE])]


def log_importances(texts: list[str], ratios: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the number of its shape n-grams, the sum of their log ratios, and the log importance."""
    grams, n = ngrams(texts), len(texts)
    bucket, of = grams[SHAPE]
    size = np.bincount(of, minlength=n)
    total = np.bincount(of, ratios[SHAPE][bucket], minlength=n)
    words = np.zeros(n)
    for model in (UNIGRAM, BIGRAM):
        bucket, of = grams[model]
        told = ratios[model][bucket] != 0
        once = np.unique(of[told] * WORD_BUCKETS + bucket[told])
        words += np.bincount(once // WORD_BUCKETS, ratios[model][once % WORD_BUCKETS], minlength=n)
    by_shapes = total * SCALE / (size + PADDING)
    return size, total, np.where(words < 0, np.minimum(by_shapes, 0.0) + words, by_shapes)


# -- sampling ---------------------------------------------------------------------

def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise fixed by the document's id."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles: -infinity first, NaN of positive sign last."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def kth_largest(rows: DataFrame, column: str, k: int, bits: int = 16) -> int | None:
    """The k-th largest value of a long column, exactly (the least one if there are fewer; None of no rows).

    Each of 64 / ``bits`` rounds counts the rows by their next digit, sends at most 2 ** ``bits`` counts
    to the driver, and goes on in the digit that holds the k-th.
    """
    # the sign bit flipped: then digits compare as numbers do
    flipped = rows.select(F.col(column).bitwiseXOR(F.lit(-(2**63))).alias("x")).where("x IS NOT NULL")
    prefix, above = 0, 0
    for shift in range(64 - bits, -1, -bits):
        at = flipped if shift + bits == 64 else flipped.where(F.shiftrightunsigned("x", shift + bits) == prefix)
        digit = F.shiftrightunsigned("x", shift).bitwiseAND(F.lit((1 << bits) - 1))
        digits, counts = collected(at.groupBy(digit.alias("d")).agg(F.count("*").alias("n")))
        if not len(digits):
            return None
        order = np.argsort(-digits)
        reached = above + np.cumsum(counts[order])
        if shift + bits == 64:
            k = min(k, int(reached[-1]))
        i = int(np.searchsorted(reached, k))
        above = int(reached[i - 1]) if i else above
        prefix = prefix << bits | int(digits[order[i]])
    return prefix - 2**63


def _scored(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """``docs`` with the added columns but ``kept``, and __order, the key as a whole number."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = clean_columns(docs, *ADDED, "__noise", "__order").withColumn("__noise", gumbel(F.col("doc_id"), seed))
    schema = StructType([f for f in rows.schema if f.name != "__noise"])
    for name in ADDED[:-1]:
        schema = schema.add(name, LongType() if name == "n_grams" else DoubleType())
    schema = schema.add("__order", LongType())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index("text")).to_pylist()]
            n_grams, total, importance = log_importances(texts, shared.value)
            key = importance + batch.column(names.index("__noise")).to_numpy()
            columns = [c for c, n in zip(batch.columns, names, strict=True) if n != "__noise"]
            added = [pa.array(n_grams, pa.int64()), *(pa.array(x, pa.float64()) for x in (total, importance, key)), pa.array(ordered(key), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + added, names=schema.names)

    return rows.mapInArrow(score, schema)


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, floor: float = FLOOR, keep_text: bool = False) -> DataFrame:
    """``docs`` (without text unless ``keep_text``) with n_grams, log_ratio (of the shapes), log_importance, gumbel_key and kept (the ``k`` largest keys).

    ``k`` is the sample's size; by default the number of documents whose log
    importance is at least ``floor``, the part of the corpus that the target
    model covers. ``labels`` (doc_id, quality, toxic) names the target: quality 1 and not toxic.
    """
    scored = _scored(docs, labels, seed)
    staged = write_table(scored if keep_text else scored.drop("text"), workspace(docs.sparkSession, "importance"))
    if k is None:
        k = staged.where(F.col("log_importance") >= floor).count()
    cut = kth_largest(staged, "__order", k) if k else None
    kept = F.lit(False) if cut is None else F.col("__order") >= F.lit(cut).cast("long")
    return staged.withColumn("kept", kept.cast(BooleanType())).drop("__order")


def resample_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The sampled documents with their texts and the columns of ``docs``."""
    named = docs.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")})
    kept = importance_resample(named, labels, keep_text=True, **options).where("kept")
    return kept.select(*[F.col(c if c in ("doc_id", "text") else f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
