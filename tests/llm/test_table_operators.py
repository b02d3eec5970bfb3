"""Packing, extraction, URL filters, archives, sharding and near-duplicates against brute force and on awkward rows."""

import base64
import hashlib
import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare_oracle import digest
from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import best_fit, bpe, html_extract, near_dedup, queries, sharding, url_filters, warc
from rollcall.session import stage_table

SMOKE = "/root/testdata/sf0.001"


# -- packing --------------------------------------------------------------------

def brute_pack(sizes, lengths, cost):
    """The same placement by plain search over all open bins."""
    bins, left = [], sum(sizes)
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= s]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += s
        else:
            bins.append([min((c for c in lengths if c >= s), key=lambda c: (cost(c) / min(c, left), c)), s])
        left -= s
    return Counter((min(c for c in lengths if c >= b[1]), b[1]) for b in bins)


def test_pack_equals_brute_force():
    rng = random.Random(1)
    for trial in range(60):
        sizes = [rng.randint(1, rng.choice([20, 100, 512])) for _ in range(rng.randint(0, 80))]
        at, offset, ends = best_fit.pack(np.array(sizes, np.int64), (64, 128, 512), lambda c: c + 0.002 * c * c)
        used = defaultdict(list)
        for s, b, o in zip(sizes, at, offset, strict=True):
            used[b].append((o, s))
        for b, parts in used.items():
            end = 0
            for o, s in sorted(parts):
                assert o == end
                end += s
            assert end <= ends[b]
        if len(set(sizes)) == len(sizes):
            assert Counter((ends[b], sum(s for _, s in p)) for b, p in used.items()) == brute_pack(sizes, (64, 128, 512), lambda c: c + 0.002 * c * c)


def test_packing_by_tokens(spark, awkward):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})
    counted = best_fit.count_tokens(awkward, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], len(enc.encode_ordinary(r["text"] or ""))) for r in awkward.collect())
    assert Counter(map(tuple, counted.collect())) == want
    out = queries.op2_best_fit_packing(spark, SMOKE).collect()
    used, total = Counter(), Counter()
    for r in out:
        total[r["doc_id"]] += r["length"]
        if r["bin_id"] is not None:
            used[r["bin_id"], r["bin_length"]] += r["length"]
    assert all(n <= length <= max(best_fit.LENGTHS) for (_, length), n in used.items())
    for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect():
        assert total[r["doc_id"]] == len(enc.encode_ordinary(r["text"]))


def test_packing_covers_every_token(awkward, no_docs):
    out = best_fit.best_fit_packing(awkward, block=5).collect()
    want = Counter()
    for r in awkward.collect():
        want[r["doc_id"]] += len((r["text"] or "").split())
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
        assert r["start"] == r["piece"] * 4096 and (r["bin_id"] is None) == (r["length"] == 0)
    assert got == want
    bins = defaultdict(list)
    for r in out:
        bins[r["bin_id"], r["bin_length"]].append((r["bin_offset"], r["length"]))
    for (b, length), parts in bins.items():
        if b is not None:
            total = sum(x for _, x in parts)
            assert total <= length == min(c for c in best_fit.LENGTHS if c >= total)
            assert sorted(parts)[0][0] == 0 and all(a[0] + a[1] == c[0] for a, c in zip(sorted(parts), sorted(parts)[1:], strict=False))
    assert best_fit.best_fit_packing(no_docs).count() == 0


# -- HTML -------------------------------------------------------------------------

def test_blocks_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">We use cookies</div><main><h1>A  title</h1><p>One <b>bold</b>&nbsp;word &amp; more<p>Two<br>lines
    <aside>Side</aside><script>if (a < b) x("</p>");</script><!-- hidden <p>no</p> --><form><input>Search</form>
    <section id="comments"><p>Reader says</p></section><p>Last &lt;one&gt; <span class=ad>Buy</span> end</p></main><footer>Foot</footer>"""
    found = html_extract.blocks(page)
    assert [t for t, s in found if s == html_extract.MAIN] == ["A title", "One bold word & more", "Two", "lines", "Last <one>", "end"]
    assert {t for t, s in found if s == html_extract.GONE} == {"Site", "Menu", "We use cookies", "Side", "Search", "Reader says", "Foot", "Buy"}
    assert html_extract.blocks("") == [] and html_extract.blocks("plain <text") == [("plain <text", html_extract.OPEN)]


def test_shared_lines_equal_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 14))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = html_extract.shared_lines(a, b)
        assert len(at) == best[len(a)][len(b)] and at == sorted(set(at))
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in at)


def test_differencing_deletes_the_template_and_keeps_copies(spark):
    page = lambda body: f"<div>Site name</div><div>Menu line</div>{body}<div>Imprint</div>"
    rows = [(1, "http://a.org/x/1", page("<div>First story of its own.</div>")), (2, "http://a.org/x/2", page("<div>Second story, another.</div>")), (3, "http://b.org/1", page("<div>Alone here.</div>")),
            (4, "http://c.org/1", "<article><p>Copied.</p></article>"), (5, "http://c.org/2", "<article><p>Copied.</p></article>"), (6, "http://d.org/1", "<p>Same page.</p>"), (7, "http://d.org/2", "<p>Same page.</p>"),
            (8, None, None), (9, "no url", ""), (2, "http://a.org/x/2", page("<div>Second story, another.</div>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit("x"), "shared": F.lit(2)})
    out = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_main_text(df).collect())
    texts = {1: "First story of its own.", 2: "Second story, another.", 3: "Site name\nMenu line\nAlone here.\nImprint", 4: "Copied.", 5: "Copied.", 6: "Same page.", 7: "Same page.", 8: "", 9: ""}
    assert out == sorted((i, texts[i], len(texts[i])) for i, *_ in rows)
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "kept"),
    [
        ('<div class="layout with-sidebar"><h1>Title</h1><article><p>Story.</p></article><div class="sidebar">Side</div></div>', "Title Story."),
        ('<article class="post no-comments"><p>Story.</p><div class="share">Share</div></article>', "Story."),
        ('<form id="page"><div class="ad-free"><main><p>Story.</p></main></div></form>', "Story."),
        ('<main><p>Story.</p></main><div class="related"><article>Other</article></div><section id="comments"><article class="comment">Reader, at some length</article></section>', "Story."),
        ('<div class="layout with-sidebar"><p>A story without an article element.</p><div class="sidebar">Side</div></div>', "A story without an article element."),
        ('<p>Here is the story itself, in full.</p><div class="sidebar">Side</div><nav><article>Menu</article></nav>', "Here is the story itself, in full."),
    ],
)
def test_wrappers_with_listed_words_keep_their_article(html, kept):
    assert " ".join(t for t, s in html_extract.blocks(html) if s != html_extract.GONE) == kept


def test_template_of_short_articles_goes_and_copies_stay(spark):
    heavy = "".join(f"<div>A long line {i} of the template that is on each page of this site.</div>" for i in range(20))
    story = "".join(f"<p>Line {i} of a long story that two pages of the host hold.</p>" for i in range(20))
    pages = {"http://a.org/1": heavy + "<p>Short one.</p>", "http://a.org/2": heavy + "<p>Short two.</p>", "http://a.org/3": heavy + "<p>Short three.</p>",
             "http://b.org/1": heavy + "<p>Only one.</p>", "http://b.org/2": heavy + "<p>Only two.</p>",
             "http://c.org/a": "<p>Site</p><p>Unlike.</p>", "http://c.org/s1": f"<p>Site</p>{story}<p>First copy.</p>", "http://c.org/s2": f"<p>Site</p>{story}<p>Second copy.</p>", "http://c.org/t": "<p>Site</p><p>Another.</p>"}
    df = spark.createDataFrame([(n, u, h) for n, (u, h) in enumerate(pages.items())], "page_id long, url string, html string")
    got = {r["url"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
    assert [got[f"http://a.org/{i}"] for i in (1, 2, 3)] == ["Short one.", "Short two.", "Short three."]
    assert [got[f"http://b.org/{i}"] for i in (1, 2)] == ["Only one.", "Only two."]
    for url in ("http://c.org/s1", "http://c.org/s2"):
        lines = got[url].split("\n")
        assert len(lines) == 21 and "Site" not in lines


def test_articles_of_the_driver_pages(spark, table):
    import re
    from html import unescape

    want = {}
    for r in table("pages").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        lines = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", article)]
        want[r["page_id"]] = "\n".join(x for x in lines if x)
    assert {r["page_id"]: r["text"] for r in queries.op4_html_extract(spark, SMOKE).collect()} == want


# -- URL filters --------------------------------------------------------------------

@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://www.example.com/de/x", "www.example.com", "/de/x", "example.com/de/", "block"),
        ("http://badexample.com/de/x", "badexample.com", "/de/x", None, "allow"),
        ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.net?u=http://y.org/fr/", "x.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_explicit_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(url,)], "url string").select(url_filters.url_host(F.col("url")).alias("h"), url_filters.url_path(F.col("url")).alias("p"))
    r = df.withColumn("x", url_filters.explicit_rule(F.col("h"), F.col("p"))).first()
    assert (r["h"], r["p"], r["x"] and r["x"]["rule"]) == (host, path, rule)
    assert r["x"] is None or r["x"]["verdict"] == verdict


def brute_rules(baskets, support, confidence):
    """All token sets up to three by counting, pruned as documented."""
    n, found = len(baskets), {}
    for bad in (True, False):
        base = sum(b == bad for _, b in baskets) / n
        sets = Counter(c for t, _ in baskets for k in (1, 2, 3) for c in combinations(sorted(t), k))
        hits = Counter(c for t, b in baskets if b == bad for k in (1, 2, 3) for c in combinations(sorted(t), k))
        for c, h in hits.items():
            if h >= support * n and h / sets[c] >= confidence and h / sets[c] / base > 1:
                found[c, bad] = h / sets[c]
    return {(c, b): v for (c, b), v in found.items() if not any(b2 == b and set(c2) < set(c) and v <= v2 for (c2, b2), v2 in found.items())}


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(3)
    baskets = [([t for t in "abc" if rng.random() < 0.5], False) for _ in range(300)]
    baskets = [(t, ("a" in t and "b" in t) if rng.random() < 0.9 else rng.random() < 0.5) for t, _ in baskets]
    df = spark.createDataFrame(baskets, "tokens array<string>, bad boolean")
    got = {(tuple(r["tokens"]), r["bad"]): r["confidence"] for r in url_filters.mine_rules(df, 0.02, 0.6).collect()}
    want = brute_rules(baskets, 0.02, 0.6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    urls = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(baskets)], "page_id long, tokens array<string>")
    met = {r["page_id"]: (r["bad_confidence"], r["good_confidence"]) for r in url_filters.match_rules(urls, url_filters.mine_rules(df, 0.02, 0.6), "page_id").collect()}
    for i, (t, _) in enumerate(baskets):
        best = [max((v for (c, b), v in want.items() if b is side and set(c) <= set(t)), default=None) for side in (True, False)]
        assert met.get(i, (None, None)) == tuple(best)


def test_tokens_of_a_common_path_are_mined_as_one(spark):
    path = [f"p:part{i}" for i in range(40)]
    rows = [(["h:site", *path, f"p:own{i}"], True) for i in range(100)] + [(["h:site", "p:clean"], False) for _ in range(50)] + [(["h:other"], False) for _ in range(50)]
    start = time.time()
    rules = url_filters.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6)
    got = {(tuple(map(tuple, r["alternatives"])), r["bad"]): r["confidence"] for r in rules.collect()}
    assert time.time() - start < 60
    assert got == {((tuple(sorted(path)),), True): 1.0, ((("h:site",),), True): 100 / 150, ((("p:clean",),), False): 1.0, ((("h:other",),), False): 1.0}
    urls = spark.createDataFrame([(1, [path[7], "x"]), (2, ["h:site"]), (3, ["x"]), (4, ["h:site", "p:clean"]), (5, path * 20)], "page_id long, tokens array<string>")
    met = {r["page_id"]: (r["bad_confidence"], r["good_confidence"]) for r in url_filters.match_rules(urls, rules, "page_id").collect()}
    assert met == {1: (1.0, None), 2: (100 / 150, None), 4: (100 / 150, 1.0), 5: (1.0, None)}


def test_very_long_urls(spark):
    long = "http://Long.Example.COM/de/" + "part/" * 20_000 + "end?q=1"
    pages = spark.createDataFrame([(1, long), (2, "http://x.net/" + "y" * 1_000_000)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filters.url_verdicts(pages, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")).collect()}
    assert got[1]["host"] == "long.example.com" and got[1]["path"] == "/de/" + "part/" * 20_000 + "end" and (got[1]["rule"], got[1]["verdict"]) == ("example.com/de/", "block")
    assert (got[2]["rule"], got[2]["verdict"]) == ("net/", "block")


def test_url_verdicts_on_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "http://spam.org/buy/1"), (3, "http://spam.org/buy/1"), (None, "http://spam.org/buy/2"), (4, "http://fine.org/read/1")] + [(i, f"http://spam.org/buy/{i}") for i in range(5, 20)] + [(i, f"http://fine.org/read/{i}") for i in range(20, 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(0), "tokens": F.lit(0), "rule": F.lit(0)})
    labels = spark.createDataFrame([(i, 0, 0) for i in range(5, 15)] + [(i, 1, 0) for i in range(20, 35)] + [(None, 0, 0), (50, None, None)], "doc_id long, quality int, toxic int")
    out = Counter((r["page_id"], r["verdict"]) for r in url_filters.url_verdicts(pages, labels).collect())
    assert out[3, "block"] == 2 and out[None, "block"] == 1 and out[4, "allow"] == 1 and out[1, "allow"] == 1 and sum(out.values()) == len(rows)
    assert {r["verdict"] for r in url_filters.url_verdicts(pages, labels.limit(0)).collect()} == {"allow"}
    assert url_filters.url_verdicts(pages.limit(0), labels).count() == 0


# -- WARC ---------------------------------------------------------------------------

def test_archives_round_trip(spark, tmpdir_path):
    odd = "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nünï\x00 end\r\n"
    rows = [(1, "http://B.org/b?q=1#f", "same"), (2, "http://a.org/", "same"), (3, "http://a.org/", "same"), (4, None, None), (5, "http://a.org/\r\nx", ""), (6, "http://c.org/", odd), (6, "http://c.org/", odd), (7, "http://d.org", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit(1), "response": F.lit(2)})
    out = warc.archive_and_index(df).collect()
    top = {}
    for i, _, html in rows:
        top[html or ""] = max(i, top.get(html or "", i))
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        first = top[html or ""]
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want
    keys = [(r["url_key"], r["warc_date"], r["page_id"]) for r in out]
    assert keys == sorted(keys) and keys[-1][0] == "org,d)" and ("org,b)/b?q=1") in {k[0] for k in keys}
    few = warc.archive_and_index(df, min_bytes=5).collect()
    assert {r["page_id"] for r in few if r["record_type"] == "revisit"} == set()
    assert warc.archive_and_index(df.limit(0)).count() == 0


def test_payloads_of_a_repeated_id_are_judged_apart(spark):
    rows = [(5, "x"), (9, "x"), (5, "only here"), (7, "p"), (7, "q"), (8, "p"), (12, "q"), (12, "q"), (None, "x"), (None, "no other")]
    df = spark.createDataFrame([(i, f"http://a.org/{n}", html) for n, (i, html) in enumerate(rows)], "page_id long, url string, html string")
    out = warc.archive_and_index(df).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out)
    responses = [(9, 1), (5, 9), (8, 1), (12, 1), (12, 1), (None, 8)]
    revisits = [(5, 1, 9), (7, 1, 8), (7, 1, 12), (None, 1, 9)]
    assert got == Counter([(i, n, "response", None) for i, n in responses] + [(i, n, "revisit", to) for i, n, to in revisits])


def test_a_damaged_archive_is_refused():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nshort"
    with pytest.raises(ValueError):
        list(warc.parse_archive([gzip.compress(record)]))


def test_loser_tree_merges_any_runs():
    rng = random.Random(4)
    for k in range(12):
        runs = [sorted((rng.randint(0, 50), i) for _ in range(rng.randint(0, 20))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_warc_query_matches_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMOKE}/pages.parquet'")
    got = queries.op8_warc(spark, SMOKE)
    want = con.execute(queries.ORACLE["op8_warc"])
    assert digest(got.columns, [tuple(r) for r in got.collect()]) == digest([c[0] for c in want.description], want.fetchall())


# -- sharding -------------------------------------------------------------------------

def check_shards(rows, n, shards=16):
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n and max(sizes.values(), default=0) - min((sizes[s] for s in range(shards)), default=0) <= 1
    assert {(r["shard"], r["slot"]) for r in rows} == {(s, i) for s in sizes for i in range(sizes[s])}


def test_shards_are_exact_and_gapless(spark, awkward, no_docs, table):
    import zlib

    for df in (awkward, table("documents"), awkward.limit(0)):
        n = df.count()
        rows = sharding.shard_documents(df.withColumn("slot", F.lit(1))).collect()
        check_shards(rows, n)
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    rows = sharding.shard_rows(spark.range(3000).repartition(7), 5, cell=100).collect()
    check_shards(rows, 3000, 5)


def test_matrix_has_the_law_of_a_uniform_shuffle():
    blocks, cells = [5, 3, 4], [4, 4, 4]
    rng = random.Random(5)
    drawn, shuffled = Counter(), Counter()
    owners = [b for b, n in enumerate(blocks) for _ in range(n)]
    for seed in range(4000):
        m = sharding.communication_matrix(blocks, cells, seed)
        assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == cells
        drawn[m[0, 0], m[1, 1]] += 1
        rng.shuffle(owners)
        shuffled[owners[:4].count(0), owners[4:8].count(1)] += 1
    assert all(abs(drawn[k] - shuffled[k]) < 5 * (drawn[k] + shuffled[k] + 4) ** 0.5 for k in drawn.keys() | shuffled.keys())


def test_large_populations():
    rng = np.random.default_rng(6)
    good, bad, draws = 3 * 10**9, 5 * 10**9, 2 * 10**9
    x = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(60)], float)
    mean = draws * good / (good + bad)
    deviation = (mean * (bad / (good + bad)) * ((good + bad - draws) / (good + bad - 1))) ** 0.5
    assert abs(x.mean() - mean) < 5 * deviation / 60**0.5 and 0.6 < x.std() / deviation < 1.5


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a<a", "<!x", "<?x", "<head>", "<a '\"", "</a ", "<a>\"<b '"])
def test_broken_tags_take_time_in_proportion(unit):
    start = time.time()
    html_extract.blocks(unit * (1_000_000 // len(unit)))
    assert time.time() - start < 20


def test_tags_after_a_broken_one_are_still_found():
    page = "<p>one <b <i two</p><p class='x>y'>three</p>&lt;<nav>gone</nav><p>four</p><a 'open"
    whole = "<p>one</p><p class='x>y'>three</p>&lt;<nav>gone</nav><p>four</p>"
    assert [t for t, state in html_extract.blocks(whole) if state == html_extract.OPEN] == ["one", "three", "<", "four"]
    got = [t for t, state in html_extract.blocks(page) if state == html_extract.OPEN]
    assert got[1:3] == ["three", "<"] and got[3] == "four" and "gone" not in " ".join(got)
    # after the first tag without an end both ways of finding tags agree
    slow, rng = html_extract._Tags(""), random.Random(3)
    bits = ["<a", "<p>", "</p>", ">", '"', "'", " ", "x", "<!--", "-->", "<!d>", "text", "/", "=", "<b c='d>'>"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))
        plain, slow = html_extract._Tags(text), html_extract._Tags(text)
        slow.broken = True
        at = 0
        while True:
            a, b = plain.find(at), slow.find(at)
            assert a == b, text
            if a is None:
                break
            at = a[1]


def test_a_long_page_and_a_page_without_an_id(spark):
    article = "".join(f"<p>Sentence number {i} of a very long article.</p>" for i in range(100_000))
    rows = [(None, "http://x.org/a", "<nav>Menu</nav><article><p>Short one.</p></article>"), (1, "http://x.org/b", f"<nav>Menu</nav><article>{article}</article>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[None] == "Short one." and got[1].count("\n") == 99_999


# -- near-duplicates --------------------------------------------------------------------

def brute_similarity(a, b, k=5):
    """Longest common subsequence of occurrence-labelled k-mers over their union, by dynamic programming."""

    def kmers(t):
        w, seen = (t or "").split(), Counter()
        out = []
        for i in range(max(len(w) - k, 0) + 1 if w else 0):
            x = tuple(w[i : i + k])
            out.append((x, seen[x]))
            seen[x] += 1
        return out

    x, y = kmers(a), kmers(b)
    if not x or not y:
        return float(len(x) == len(y))
    row = [0] * (len(y) + 1)
    for u in x:
        new = [0]
        for j, v in enumerate(y):
            new.append(row[j] + 1 if u == v else max(row[j + 1], new[-1]))
        row = new
    return row[-1] / (len(x) + len(y) - row[-1])


def brute_classes(rows, threshold=0.8):
    class_of = {i: i for i, _ in rows}

    def find(i):
        while class_of[i] != i:
            i = class_of[i]
        return i

    grams = {i: {tuple((t or "").split()[j : j + 5]) for j in range(max(len((t or "").split()) - 4, 1))} for i, t in rows}
    for (i, s), (j, t) in combinations(rows, 2):
        if len(grams[i] & grams[j]) >= 0.3 * max(len(grams[i]), len(grams[j])) and brute_similarity(s, t) >= threshold - 1e-9:
            a, b = sorted((find(i), find(j)))
            class_of[b] = a
    return {i: find(i) for i, _ in rows}


def test_alignment_equals_dynamic_programming():
    rng = random.Random(7)
    for _ in range(400):
        words = [str(rng.randint(0, rng.choice([3, 40]))) for _ in range(rng.randint(1, 60))]
        other = list(words)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(other))
            other[at : at + rng.randint(0, 2)] = [str(rng.randint(0, 9)) for _ in range(rng.randint(0, 2))]
        if not other:
            continue
        number = lambda ws: near_dedup.labelled_kmers(np.array([int(w) + 1 for w in ws], np.int64))
        want = brute_similarity(" ".join(words), " ".join(other))
        got = near_dedup.aligned(number(words), number(other))
        assert abs(got - want) < 1e-9 if want >= 0.8 else got < 0.8


def corpus(seed=8, groups=40, size=6):
    """Texts with copies and near copies: each member of a group changes a word or cuts an end of the group's text."""
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 200))]
        for _ in range(rng.randint(1, size)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 80))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            if rng.random() < 0.3:
                w = w[: len(w) - len(w) // 12]
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark):
    for rows in (corpus(), [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect() if len(r["text"]) < 6000]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
        assert got == brute_classes(rows)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        w = list(words)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{i}_{j}" for j in range(60)) + " " + " ".join(words[:40])) for i in range(50)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 600 else i for i, _ in rows}


@pytest.mark.parametrize("small, turn", [(near_dedup.SMALL, near_dedup.TURN), (4, 2)])
def test_buckets_of_unlike_texts_lose_no_link(spark, monkeypatch, small, turn):
    """Texts about a similarity of 0.8 apart in one family, and a passage in many texts, some of them alike besides it."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "RARE", small)
    monkeypatch.setattr(near_dedup, "TURN", turn)
    rng = random.Random(12)
    family, passage = [f"w{i}" for i in range(90)], [f"p{i}" for i in range(60)]
    texts = []
    for i in range(70):
        w = list(family)
        for at in rng.sample(range(90), rng.choice([1, 2, 3])):
            w[at] = f"x{i}_{at}"
        texts.append(" ".join(w))
    for i in range(60):
        own = [f"y{i}_{j}" for j in range(30)]
        texts.append(" ".join(own[:15] + passage + own[15:]))
        if i % 4 == 0:
            texts.append(" ".join(own[:15] + passage + own[15:29] + ["end"]))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("small, turn", [(near_dedup.SMALL, near_dedup.TURN), (4, 2)])
def test_texts_of_little_else_than_common_passages(spark, monkeypatch, small, turn):
    """Two passages, alone and together, with own words before and after that make texts just alike, or just not."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "RARE", small)
    monkeypatch.setattr(near_dedup, "TURN", turn)
    rng = random.Random(31)
    one, two = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(30)]
    texts = []
    for i in range(150):
        middle = rng.choice([one, one, one + two, two + one, two])
        own = [f"y{i}_{j}" for j in range(rng.choice([3, 6, 8, 10, 12, 14, 20]))]
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + middle + own[at:]))
        if rng.random() < 0.3:  # shares a part of its own words too
            texts.append(" ".join(own[:at] + middle + [f"z{i}_{j}" for j in range(len(own) - at)]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert got == want and 5 < len(set(want.values())) < 140


def test_the_search_is_linear_in_the_texts_with_a_common_passage(spark, monkeypatch):
    """No pair within the bucket of a passage is formed, whatever the number of texts that hold it."""
    verified = []
    plain = near_dedup._verified

    def counted(pairs, *rest):
        pairs = stage_table(pairs, "counted")
        verified.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    passage = " ".join(f"p{i}" for i in range(60))
    for n in (300, 1200):
        rows = [(i, " ".join(f"y{i}_{j}" for j in range(40)) + " " + passage) for i in range(n)]
        verified.clear()
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {(r["doc_id"], r["class_id"]) for r in got.collect()} == {(i, i) for i in range(n)}
        assert sum(verified) < n


@pytest.mark.parametrize("slots", [near_dedup.SLOTS, 16])
def test_of_common_passages_the_rarest_kmers_only_are_listed(spark, monkeypatch, slots):
    """Of the texts of a large bucket at most a fifth of the k-mers becomes rows; with too few slots to tell k-mers apart links stay whole."""
    monkeypatch.setattr(near_dedup, "SLOTS", slots)
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    plain, staged = near_dedup.stage_table, []

    def counted(df, name):
        staged.append((name, plain(df, name)))
        return staged[-1][1]

    monkeypatch.setattr(near_dedup, "stage_table", counted)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(80):
        own = [f"y{i // 2 if i < 20 else i}_{j}" for j in range(19)]
        rows.append((i, " ".join(passage + own + ["end"] * (i % 2))))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) == 70
    after = [n for n, _ in staged].index("wide") + 1
    kmers = sum(len(t.split()) - 4 for _, t in rows)
    assert len(staged) > after and max(df.count() for _, df in staged[after:]) <= kmers // 5 + len(rows)


def test_near_duplicates_on_awkward_rows(spark, awkward, no_docs):
    out = near_dedup.near_duplicates(awkward)
    got = Counter((r["doc_id"], r["class_id"], r["copy_of"]) for r in out.collect())
    assert got[1, 1, 1] == got[2, 1, 1] == got[3, 1, 1] == 1 and got[6, 6, 6] == 2 and got[7, 6, 6] == 1 and got[8, 6, 8] == 1 and got[None, 6, 6] == 1
    assert sum(got.values()) == awkward.count()
    kept = near_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 6, 9, 10, -5, 2**62])
    assert near_dedup.keep_one(no_docs).count() == 0
    repeated = spark.createDataFrame([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g"), (3, "h i j k l m n")], "doc_id long, text string")
    assert Counter((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(repeated).collect()) == Counter([(1, 2), (1, 3), (2, 2), (3, 3)])
    assert near_dedup.keep_one(repeated).count() == 2
    nameless = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (None, "other words here"), (1, None), (None, "")], "doc_id long, text string")
    assert Counter((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(nameless).collect()) == Counter({(None, None): 3, (1, 1): 1, (None, 1): 1})
    assert near_dedup.keep_one(nameless).count() == 3


# -- pipeline -----------------------------------------------------------------------------

def test_pipeline_stages(spark, awkward, table, no_docs):
    for start in (table("documents"), awkward, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage_table(stage(spark, docs, SMOKE), name)
            assert after.columns == docs.columns
            assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
            docs = after
        if start is not awkward and start is not no_docs:
            ids = {r["doc_id"] for r in docs.collect()}
            texts = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"]) < 6000]
            assert all(c == i for i, c in brute_classes(texts).items())
            packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMOKE).collect()
            assert {r["doc_id"] for r in packed} == ids
    assert corpus_pipeline.run(spark, SMOKE).count() >= len(ids)
