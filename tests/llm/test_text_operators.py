"""Quality rules, byte-level BPE, fingerprints and the classifier against brute force and on awkward rows."""

import hashlib
import math
import re
import tracemalloc
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from compare_oracle import digest
from pyspark.sql import functions as F

from rollcall.llm import bpe, fingerprints, queries
from rollcall.llm import quality_classifier as qc
from rollcall.llm import quality_rules as qr

SMOKE = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- quality rules ----------------------------------------------------------

def base_measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_measures_of_awkward_rows(spark, awkward, table):
    for df in (awkward, table("documents")):
        out = qr.quality_rules(df.select("doc_id", "text", *[c for c in df.columns if c in ("kept", "n_words")])).collect()
        assert len(out) == df.count()
        for r in out:
            want = base_measures(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize(
    "line, fails",
    [
        ("Plain prose with a full stop.", False),
        ("- - - --- - -", True),
        ("this### is%%% noise***", True),
        ("SOLD!! OUT!! NOW!!", True),
        ("Home | News | Sport | About", True),
        ("Copyright (c) 2020 by somebody.", True),
        ("He licensed under pressure " + "and went on with a long tale " * 6, False),
        ("R&D at AT&T costs $5.", False),
    ],
)
def test_line_rules(spark, line, fails):
    got = spark.createDataFrame([(line,)], "x string").select(qr.line_fails(F.col("x")).alias("f")).first()["f"]
    assert got is fails


def test_cleaned_documents(spark, awkward, no_docs):
    rows = [(1, "Good words stand here, ten of them in all, yes indeed.\nHome | News | Sport | About\n\nA last line."), (2, "a | b | c | d\n" * 5 + "ten words that are fine but few in number, truly")]
    out = qr.keep_clean(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in out] == [(1, "Good words stand here, ten of them in all, yes indeed.\n\nA last line.", 68)]
    assert qr.keep_clean(no_docs).count() == 0
    kept = qr.keep_clean(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {6, 7, 8, None}


def test_quality_rules_query_matches_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMOKE}/documents.parquet'")
    got = queries.op1_quality_rules(spark, SMOKE)
    want = con.execute(queries.ORACLE["op1_quality_rules"])
    assert digest(got.columns, [tuple(r) for r in got.collect()]) == digest([c[0] for c in want.description], want.fetchall())


# -- byte-level BPE -----------------------------------------------------------

def test_bpe_equals_tiktoken_and_round_trips(spark, awkward, table, no_docs):
    path = public_tokenizers.path(queries.RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    odd = spark.createDataFrame([(100, "a\x00b\x1c \x85\u2003\u3000 don't I'LL ½ ٣ e\u0301 \u2581\U0010ffff\n\n \r\n"), (101, "<|endoftext|> " + "ab" * 30_000)], "doc_id long, text string")
    for df in (awkward.select("doc_id", "text"), odd, table("documents").select("doc_id", "text")):
        texts = Counter((r["doc_id"], r["text"] or "") for r in df.collect())
        out = bpe.encode_documents(df, path, public_tokenizers.PATTERN).collect()
        want = Counter()
        for (i, t), n in texts.items():
            ids = encoding.encode_ordinary(t)
            want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), tuple(ids))] += n
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in out) == want
    assert bpe.encode_documents(no_docs, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_cache_starts_afresh(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    codec = bpe.BytePairCodec(bpe.sentencepiece_model(ranks), sorted(ranks, key=ranks.get), public_tokenizers.PATTERN)
    for text in ("one two three four five", "six seven", "one eight", ""):
        assert codec.decode(codec.encode(text)).decode() == text


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        bpe.sentencepiece_model({b"a": 0, b"b": 2})


# -- fingerprints ---------------------------------------------------------------

def spark_hash(*values):
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else int(v).to_bytes(8 if abs(v) >= 2**31 or isinstance(v, Long) else 4, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed=seed % 2**64)
    return seed - 2**64 if seed >= 2**63 else seed


class Long(int):
    """An integer that Spark hashes as eight bytes."""


def brute_fingerprint(text, k=fingerprints.K, bins=fingerprints.BINS, ell=fingerprints.ELL):
    w = WORD.findall(text or "")
    if not w:
        return []
    seen, labelled = Counter(), []
    for i in range(max(len(w) - k, 0) + 1):
        h = spark_hash(*w[i : i + k])
        n = seen[h]
        seen[h] += 1
        labelled.append((h if not n else spark_hash(Long(h), n), i))
    out = []
    for b in range(bins):
        mine = sorted(x for x in labelled if (x[0] % 2**64) >> (64 - (bins.bit_length() - 1)) == b)[:ell]
        if mine:
            out.append(f"{b:02x}{spark_hash(*[Long(h) for h, _ in sorted(mine, key=lambda x: x[1])]) & 0xFFFFFFFF:08x}")
    return out


def alike(a, b):
    used = {x[:2] for x in a} | {x[:2] for x in b}
    return len(set(a) & set(b)) / len(used) if used else 1.0


def test_fingerprints_equal_brute_force(spark, awkward, table, no_docs):
    for df in (awkward, table("documents")):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = Counter()
        for i, (doc, t) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            f, e, n = brute_fingerprint(t), brute_fingerprint(edited), brute_fingerprint(after)
            want[(doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), ".".join(f), ".".join(e), alike(f, e), alike(f, n))] += 1
        assert Counter(tuple(r) for r in fingerprints.fingerprint_documents(df).collect()) == want
    assert fingerprints.fingerprint_documents(no_docs).count() == 0


def test_next_text_across_blocks(spark):
    rows = [(i * 7 - 300, f"text {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.array("text")).repartition(5)
    out = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next_text(df, rows=16).collect()}
    assert out == {d: rows[(i + 1) % 500][1] for i, (d, _) in enumerate(rows)}
    one = fingerprints.with_next_text(df.where("doc_id = -300"), rows=16).first()
    assert one["next_text"] == one["text"]


def test_likeness_falls_with_order_and_edits(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:390]), " ".join(words[200:] + words[:200]), " ".join(words[::-1])]
    prints = [r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fingerprints.order_minhash(F.col("t")).alias("f")).collect()]
    near, moved, turned = (alike(prints[0], p) for p in prints[1:])
    assert near > 0.7 and near > moved > turned


# -- quality classifier -----------------------------------------------------------

def brute_ngrams(text):
    """The words, their pairs, and the pairs of shapes of a text, character by character."""
    kind = lambda c: {"L": "A" if unicodedata.category(c) == "Lu" else "a", "M": "a", "N": "0"}.get(unicodedata.category(c)[0])
    words, run = [], ""
    for c in (text or "") + " ":
        if c not in WS and kind(c):
            run += c.lower() if len(c.lower()) == 1 else c
        elif run:
            words, run = [*words, run], ""
    shapes, before = [], None
    for token in WORD.findall(text or ""):
        shape = ""
        for c in token:
            x = kind(c)
            if x is None or not shape.endswith(x):
                shape += x or c
        shape = re.sub(r"([^aA0])\1+", r"\1\1", shape)
        shapes.append(shape + ("=" if token == before else ""))
        before = token
    return words, list(zip(words, words[1:])), list(zip(["", *shapes], shapes))


WS = " \t\n\x0b\x0c\r"


def same_partition(buckets, grams, size):
    """Whether equal n-grams, and only they (but for as many collisions as chance makes), share a bucket."""
    assert len(buckets) == len(grams)
    of = {}
    assert all(of.setdefault(g, b) == b for g, b in zip(grams, buckets, strict=True))
    return len(set(of.values())) >= 0.97 * size * (1 - (1 - 1 / size) ** len(of))


def test_ngrams_equal_brute_force(awkward, monkeypatch):
    texts = [r["text"] or "" for r in awkward.collect()] + ["Abc DEF ghi12, x!!! x!!! x!!!!", "Ärger ÄRGER straße STRASSE İ", "a\u00a0b c", "so so so", "."]
    for slice_, most in ((qc.SLICE, 100_000), (50, 3_000)):
        monkeypatch.setattr(qc, "SLICE", slice_)
        part = [t[:most] for t in texts]
        found = qc.ngrams(part)
        for i, text in enumerate(part):
            for (bucket, of), grams, size in zip(found, brute_ngrams(text), qc.SIZES, strict=True):
                assert same_partition(bucket[of == i].tolist(), grams, size)
    # one hash for one n-gram, whatever the texts around it
    assert [x.tolist() for x, _ in qc.ngrams(["an idiot!"])] == [x[of == 1].tolist() for x, of in qc.ngrams(["some other", "an idiot!"])]


def test_models_and_importance_equal_brute_force(spark, table):
    docs, labels = table("documents").select("doc_id", "text"), table("labels")
    rows, marks = [tuple(r) for r in docs.collect()], {}
    for r in labels.collect():
        marks[r["doc_id"]] = marks.get(r["doc_id"], True) and r["quality"] == 1 and not r["toxic"]
    grams = {i: qc.ngrams([t or ""]) for i, t in rows}
    counts = [np.zeros((n + 1, 3), np.int64) for n in qc.SIZES]
    for i, _ in rows:
        kind = 2 if i not in marks else 0 if marks[i] else 1
        for model in (qc.UNIGRAM, qc.BIGRAM):
            for b in set(grams[i][model][0].tolist()):
                counts[model][b, kind:] += 1
            counts[model][-1, kind:] += 1
        for b in grams[i][qc.SHAPE][0].tolist():
            counts[qc.SHAPE][b, kind:] += 1
    got = qc.count_models(docs.repartition(5), qc.labelled_ids(labels))
    for x, y in zip(got, counts, strict=True):
        assert (x == y).all()
    ratios = qc.fit(docs, labels)
    target, _, raw = counts[qc.SHAPE][:-1].T
    for b in range(0, qc.BUCKETS, 7):
        assert ratios[qc.SHAPE][b] == pytest.approx(math.log((target[b] + 20) / (raw[b] * target.sum() / raw.sum() + 20)))
    out = {r["doc_id"]: r for r in qc.importance_resample(docs, labels).collect()}
    for i, _ in rows:
        by_shape = sum(ratios[qc.SHAPE][b] for b in grams[i][qc.SHAPE][0].tolist())
        words = sum(ratios[m][b] for m in (qc.UNIGRAM, qc.BIGRAM) for b in set(grams[i][m][0].tolist()))
        mean = by_shape * 32 / (len(grams[i][qc.SHAPE][0]) + 8)
        assert out[i]["log_importance"] == pytest.approx(min(mean, 0) + words if words < 0 else mean)
    assert sum(r["kept"] for r in out.values()) == sum(r["log_importance"] >= -4 for r in out.values())
    assert min(r["gumbel_key"] for r in out.values() if r["kept"]) > max(r["gumbel_key"] for r in out.values() if not r["kept"])


def test_the_models_take_little_of_the_driver(spark):
    """The counts of nearly all buckets, collected as arrays whatever the session's settings."""
    text = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(400_000))
    docs = spark.createDataFrame([(i, text[i:]) for i in (0, 1)], "doc_id long, text string").localCheckpoint()
    labels = (np.array([0]), np.array([True]))
    setting = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    tracemalloc.start()
    try:
        counts = qc.count_models(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set(setting, before)
    assert sum((c[:, 2] > 0).sum() for c in counts) > 380_000
    assert peak < 80e6


def test_words_pass_beyond_chance_only():
    counts = np.zeros((qc.WORD_BUCKETS + 1, 3), np.int64)
    counts[-1] = 300, 400, 1000
    counts[0] = 0, 20, 50  # only in documents labelled otherwise
    counts[1] = 9, 12, 50  # near its share
    counts[2] = 0, 2, 5  # too few to tell
    counts[3] = 1, 15, 50
    counts[4] = 50, 50, 50
    ratios = qc.word_ratios(counts)
    assert np.flatnonzero(ratios).tolist() == [0, 3]
    assert ratios[0] == pytest.approx(math.log(1 / 16)) and ratios[3] == pytest.approx(math.log(2 / 16))
    counts[-1] = 0, 400, 1000
    assert not qc.word_ratios(counts).any()
    # without counter-examples nothing tells
    counts[-1] = 400, 400, 400
    assert not qc.word_ratios(counts).any()


@pytest.mark.parametrize("values", [[1.5, -2.0, 1.5, 0.0, -0.0, 7e300, -7e300], [float("-inf"), 1.0, 2.0, 3.0, 4.0], [float("inf"), float("-inf"), 0.0], [float("nan"), 1.0, float("inf")], [2.0] * 9, [5.0], []])
def test_kth_largest_ends_and_is_exact(spark, values):
    numbers = sorted(qc.ordered(np.array(values)).tolist(), reverse=True)
    df = spark.createDataFrame([(x,) for x in numbers], "x long")
    for k in (1, 2, len(values), len(values) + 5):
        assert qc.kth_largest(df, "x", k) == (numbers[min(k, len(numbers)) - 1] if numbers else None)
    finite = [v for v in values if v == v]
    assert sorted(finite) == [v for _, v in sorted(zip(qc.ordered(np.array(finite)).tolist(), finite, strict=True), key=lambda p: p[0])]


def test_kth_largest_of_many(spark):
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(997)) - 400).alias("x"))
    values = sorted((r["x"] for r in df.collect()), reverse=True)
    for k in (1, 2, 500, 4999, 5000, 9000):
        assert qc.kth_largest(df, "x", k) == values[min(k, 5000) - 1]


def held_out(spark, sf):
    """The keep rates by quality and toxic of the half of the labels that the models have not seen."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    out = qc.importance_resample(docs, half).join(labels.join(half, "doc_id", "left_anti"), "doc_id")
    return {(r["quality"], r["toxic"]): r["kept"] for r in out.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}


def test_sample_keeps_good_documents_and_leaves_junk(spark):
    # toxic documents are counted apart, below
    share = held_out(spark, "/root/testdata/sf0.01")
    assert share[1, 0] > 0.98 and share[0, 0] < 0.1 and share[0, 1] < 0.1


def test_sample_leaves_toxic_documents(spark):
    # a part of the toxic labels is on texts without a toxic word
    share = held_out(spark, "/root/testdata/sf0.1")
    assert share[1, 0] > 0.98 and share[1, 1] < 0.4


def test_sample_of_clean_documents_keeps_them(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    clean = docs.join(labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi")
    assert qc.resample_documents(clean, labels).count() > 0.98 * clean.count()


def test_very_telling_documents_end(spark):
    # each toxic document holds 200 telling words
    rows = [(i, " ".join(f"good{j} plain" for j in range(60)), 1, 0) for i in range(300)]
    rows += [(1000 + i, " ".join(f"bad{j}" for j in range(200)), 1, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    out = qc.importance_resample(df.select("doc_id", "text"), df).collect()
    assert all(np.isfinite(r["gumbel_key"]) for r in out)
    assert {r["doc_id"] for r in out if r["kept"]} == set(range(300))


def test_words_tell_toxic_texts_of_the_same_shapes(spark):
    rows = [(i, f"Word{i % 7} and some plain prose follow here, number {i}.", 1, 0) for i in range(60)]
    rows += [(100 + i, f"Word{i % 7} and some blunt prose follow here, number {i}.", 1, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    ratios = qc.fit(df, df)
    told = {g for g in ("blunt", "some", "plain", "number") if ratios[qc.UNIGRAM][qc.ngrams([g])[qc.UNIGRAM][0][0]]}
    assert told == {"blunt"}
    _, _, (plain, blunt) = qc.log_importances(["Quite plain, all of it.", "Quite BLUNT, all of it."], ratios)
    assert blunt < -1 < plain


def test_sample_size_and_awkward_rows(spark, awkward, no_docs, table):
    labels = table("labels")
    docs = table("documents")
    assert qc.importance_resample(docs, labels, k=50).where("kept").count() == 50
    out = qc.importance_resample(awkward, labels)
    assert out.count() == awkward.count() and out.columns.count("kept") == 1
    assert qc.resample_documents(awkward, labels).columns == awkward.columns
    assert out.select("n_grams", "log_ratio").where("doc_id = 1").first() == (0, 0.0)
    assert qc.resample_documents(awkward, labels.limit(0)).count() == awkward.count()
    assert qc.resample_documents(no_docs, labels).count() == 0
