"""URL filters: explicit host/path rules first, then association rules mined from labelled URLs.

Token combinations that go with a bad label are mined by Spark's FP-growth,
pruned by support, confidence and redundancy, and matched through an inverted
index: each rule is filed under its rarest token, so a URL meets only the
rules of its own tokens by an equi-join. DataFrame functions and Spark ML only.

Defined results: a null URL, or one without ``://``, has an empty host and
path, no rule and no tokens, and is allowed; repeated rows each get a row; no
labels, or none that agree with any combination, give no mined rules; a very
long URL, or one of very many parts, is judged whole; an empty table gives an
empty table. ``labels`` marks documents, not URLs: a page has the mark of the
document of its id, so on tables where the two have nothing in common few rules are found.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import stage_table

#: (action, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
EXPLICIT_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BAD = "label=bad"
GOOD = "label=good"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def explicit_rule(host: Column, path: Column, rules=EXPLICIT_RULES) -> Column:
    """Struct(rule, verdict) of the longest fitting rule, null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("verdict"))).otherwise(out)
    return out


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: its host labels and path segments, numbers as one class."""
    labels = F.transform(F.filter(F.split(host, r"[.:@-]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(
        F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != ""),
        lambda x: F.concat(F.lit("p:"), F.when(x.rlike(r"^\d+$"), F.lit("<n>")).otherwise(x)),
    )
    return F.array_distinct(F.concat(labels, parts))


def token_classes(baskets: DataFrame) -> DataFrame:
    """(t, rep): for each token the least one of those that are in exactly the same baskets (basket, items).

    Told by the number of its baskets and two sums of hashes of their numbers.
    """
    held = baskets.select("basket", F.explode(F.array_distinct("items")).alias("t"))
    signed = held.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.xxhash64("basket").cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit("second"), "basket")).alias("b"))
    reps = signed.groupBy("n", "a", "b").agg(F.min("t").alias("rep"))
    return signed.join(reps, ["n", "a", "b"]).select("t", "rep")


def _subsets(tokens: Column) -> Column:
    """All subsets of a sorted array but the empty one and itself, each sorted."""
    start = F.array(F.array().cast("array<string>"))
    every = F.aggregate(tokens, start, lambda found, t: F.concat(found, F.transform(found, lambda s: F.array_append(s, t))))
    return F.filter(every, lambda s: (F.size(s) > 0) & (F.size(s) < F.size(tokens)))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, partitions: int = 64) -> DataFrame:
    """Association rules ``tokens -> label`` from rows (tokens array, bad boolean).

    Kept: label as the consequent, at least ``min_support`` of the rows,
    ``min_confidence``, lift over 1, and more confidence than every label
    rule on a subset of its tokens (a longer rule must add something).
    Tokens that are in exactly the same rows, such as the parts of one site's common path, are mined as one: a set
    with two of them says no more than a set with one, and would only double the sets for each.
    Returns (rule_id, tokens, bad, confidence, support, alternatives); ``alternatives`` has for each
    of ``tokens`` all that stand for it.
    """
    label = F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))
    marked = labelled.where(F.col("bad").isNotNull()).select(F.monotonically_increasing_id().alias("basket"), F.col("tokens").alias("items"), label.alias("label"))
    marked = stage_table(marked, "url-baskets")
    empty = "rule_id long, tokens array<string>, bad boolean, confidence double, support double, alternatives array<array<string>>"
    if marked.isEmpty():
        return labelled.sparkSession.createDataFrame([], empty)
    classes = stage_table(token_classes(marked), "url-token-classes")
    held = marked.select("basket", "label", F.explode_outer(F.array_distinct("items")).alias("t")).join(classes, "t", "left")
    # a row without tokens still counts for the shares
    baskets = stage_table(held.groupBy("basket", "label").agg(F.collect_set("rep").alias("reps")).select(F.array_append("reps", F.col("label")).alias("items")), "url-mined")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=partitions).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0].isin(BAD, GOOD) & (F.col("lift") > 1))
    rules = found.select(
        F.xxhash64(F.sort_array("antecedent"), "consequent").alias("rule_id"), F.sort_array("antecedent").alias("tokens"), F.col("consequent").alias("side"), (F.col("consequent")[0] == BAD).alias("bad"), "confidence", "support"
    )
    rules = stage_table(rules, "url-rules")
    # a rule meets the rules on its subsets by their ids, not through shared tokens
    parts = rules.where(F.size("tokens") > 1).select("rule_id", "confidence", "side", F.explode(_subsets(F.col("tokens"))).alias("part"))
    looked = parts.select(F.xxhash64("part", "side").alias("shorter"), F.col("rule_id").alias("longer"), F.col("confidence").alias("c"))
    lesser = looked.join(rules.select(F.col("rule_id").alias("shorter"), F.col("confidence").alias("sc")), "shorter").where(F.col("c") <= F.col("sc"))
    kept = rules.drop("side").join(lesser.select(F.col("longer").alias("rule_id")).distinct(), "rule_id", "left_anti")
    same = classes.groupBy("rep").agg(F.sort_array(F.collect_set("t")).alias("same"))
    named = kept.select("rule_id", F.explode("tokens").alias("rep")).join(same, "rep")
    choices = named.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("rep", "same"))).alias("c"))
    return kept.join(choices, "rule_id").select("rule_id", "tokens", "bad", "confidence", "support", F.transform("c", lambda x: x["same"]).alias("alternatives"))


def match_rules(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Per matching row of ``urls`` (key, tokens): the most confident bad and good rule. Inverted index on the rarest token.

    A rule is met if the URL has one of each of its ``alternatives``.
    """
    common = rules.select(F.explode("tokens").alias("rep")).groupBy("rep").count()
    index = (
        rules.select("rule_id", "bad", "confidence", "alternatives", F.explode(F.arrays_zip("tokens", "alternatives")).alias("x"))
        .select("rule_id", "bad", "confidence", "alternatives", F.col("x.tokens").alias("rep"), F.col("x.alternatives").alias("same"))
        .join(common, "rep")
        .groupBy("rule_id")
        .agg(F.min(F.struct("count", "rep", "same"))["same"].alias("same"), F.first("alternatives").alias("alternatives"), F.first("bad").alias("bad"), F.first("confidence").alias("confidence"))
        .select("rule_id", "alternatives", "bad", "confidence", F.explode("same").alias("t"))
    )
    met = urls.select(key, "tokens", F.explode("tokens").alias("t")).join(index, "t").where(F.forall("alternatives", lambda a: F.arrays_overlap(a, F.col("tokens"))))
    return met.groupBy(key).agg(F.max(F.when(F.col("bad"), F.col("confidence"))).alias("bad_confidence"), F.max(F.when(~F.col("bad"), F.col("confidence"))).alias("good_confidence"))


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=EXPLICIT_RULES, min_support: float = 0.002, min_confidence: float = 0.6) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the confidences of the mined rules it meets.

    ``labels`` (doc_id, quality) marks the page of the same id: quality 0 is
    bad. The explicit rule decides where one fits; else the page is blocked
    if a mined bad rule is met with more confidence than any good one.
    """
    url = F.col("url")
    parsed = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path")).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("bad"))
    mined = mine_rules(parsed.join(marks, "page_id"), min_support, min_confidence)
    # pages with the same tokens meet the same rules: match each token set once
    sets = parsed.select(F.xxhash64(F.sort_array("tokens")).alias("token_set"), "tokens").groupBy("token_set").agg(F.first("tokens").alias("tokens"))
    met = stage_table(match_rules(sets, mined, "token_set"), "url-matches")  # a table, so that the join with many pages of one set can be split
    judged = parsed.withColumn("token_set", F.xxhash64(F.sort_array("tokens"))).join(met, "token_set", "left")
    fixed = explicit_rule(F.col("host"), F.col("path"), rules)
    blocked = F.coalesce(F.col("bad_confidence") > F.coalesce(F.col("good_confidence"), F.lit(0.0)), F.lit(False))
    return judged.withColumn("__fixed", fixed).select(
        "page_id",
        "host",
        "path",
        F.col("__fixed")["rule"].alias("rule"),
        F.coalesce(F.col("__fixed")["verdict"], F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "bad_confidence",
        "good_confidence",
    )
