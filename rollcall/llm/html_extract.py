"""Main text of HTML pages by nearest-URL page differencing.

Every page is cut into text blocks (lines). Within each host the pages are put
in order of URL path, each is paired with its nearest neighbour (the longer
common path prefix of the two beside it), the lines of the two are aligned by
their longest common subsequence, and shared lines, the site's template, are
deleted. Markup that names its purpose settles the rest: lines inside menus,
headers, footers, asides, forms, adverts, notices and comments go even where
the pair differs there, and lines inside ``article`` or ``main`` stay even
where the neighbour shares them, since copies of an article are not template.
Names in class or id and forms only mark a part: one that holds the page's
article or main (of several, those under the fewest marks), or most of the text
of a page without either, is a wrapper and keeps its text.

A pair in which most of a page's open text is shared may be two copies of one
page or a short article in a long template. Without a differing line they are
copies, and nothing is deleted. Else the neighbour on the other side tells: what
it shares too is template. Without one, the pair must have lines of its own too.

Only line hashes travel for the pairing (a few per cent of the pages); the
texts are shuffled once, to meet the decisions. Neighbours are found in a
global order of narrow rows cut into blocks, so a host with a third of all
pages is spread like any other.

Defined results: null or empty HTML, and pages whose blocks all go, have the
empty text; a null URL has an empty host and path; rows that repeat an id
each get a row, with the text of their own HTML (decisions are by id and
line); an empty table gives an empty table; nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollcall.llm.common import bounded_batches, stage_table
from rollcall.llm.url_filters import url_host, url_path

#: Elements (of the HTML standard) whose content is no text.
RAW = frozenset("script style template noscript iframe svg math object canvas audio video select option datalist textarea button head title".split())
#: Elements that are no part of an article.
ASIDE = frozenset("nav header footer aside dialog menu".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that flow inside a line; every other one begins and ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Words in class or id that mark parts which are no part of an article (own list).
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars "
    "footer header masthead cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login form comment comments reply replies disqus respond "
    "related recommended share sharing social widget toolbar pagination pager".split()
)
#: Shared share of the open text above which a pair may be two copies.
COPY_SHARE = 0.8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<![^>]*>|<\?[^>]*>", re.S)
_NAME_END = re.compile(r"[\s/>]")
_SPECIAL = re.compile(r"[>\"']")
_HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
_MARKS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
MAIN, OPEN, GONE = 2, 1, 0
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class _Tags:
    """The tags of a page, found in time proportional to its length, broken ones included.

    A well-formed tag is one match of the pattern. From the first tag that does
    not end on, for which the pattern would run to the end of the page again and again, tags are found
    by looking up where things end: the end of a name, the next bracket or quote, and the
    end of a tag from there, each place once.
    """

    def __init__(self, html: str):
        self.html, self.broken = html, False
        self.next: dict[str, int] = {}
        self.ends: dict[int, int] = {}

    def find(self, pos: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the first tag at or after ``pos``, without a name for a comment or declaration."""
        html = self.html
        while (pos := html.find("<", pos)) >= 0:
            after = html[pos + 1 : pos + 2]
            if after.isascii() and (after.isalpha() or after in ("/", "!", "?")) and after:
                if not self.broken:
                    m = _TOKEN.match(html, pos)
                    if m:
                        return pos, m.end(), m[1] or "", m[2] or "", m[3] or ""
                    self.broken = after != "/" or html[pos + 2 : pos + 3].isalpha()
                if self.broken and (found := self._slow(pos, after)):
                    return found
            pos += 1
        return None

    def _seek(self, kind: str, pos: int) -> int:
        """The first place of a kind at or after ``pos``, which only grows; the page's length if there is none."""
        at = self.next.get(kind, -1)
        if at < pos:
            if kind in "\"'>":
                at = self.html.find(kind, pos)
            else:
                m = (_NAME_END if kind == "name" else _SPECIAL).search(self.html, pos)
                at = m.start() if m else -1
            at = self.next[kind] = len(self.html) if at < 0 else at
        return at

    def _slow(self, pos: int, after: str) -> tuple[int, int, str, str, str] | None:
        html, size = self.html, len(self.html)
        if html.startswith("<!--", pos):
            end = html.find("-->", pos + 4)
            return pos, size if end < 0 else end + 3, "", "", ""
        if after in "!?":
            end = self._seek(">", pos + 2)
            return None if end == size else (pos, end + 1, "", "", "")
        slash = "/" if after == "/" else ""
        first = pos + 1 + len(slash)
        if not (html[first : first + 1].isascii() and html[first : first + 1].isalpha()):
            return None
        name_end = self._seek("name", first)
        end = self._tag_end(self._seek("special", name_end))
        return None if end == size else (pos, end + 1, slash, html[first:name_end], html[name_end:end])

    def _tag_end(self, at: int) -> int:
        """Where the tag whose next bracket or quote is at ``at`` ends; the page's length if it does not."""
        html, size, path = self.html, len(self.html), []
        while at < size and html[at] != ">" and at not in self.ends:
            path.append(at)
            close = html.find(html[at], at + 1)
            m = _SPECIAL.search(html, close + 1) if close >= 0 else None
            at = m.start() if m else size
        end = self.ends.get(at, at)
        self.ends.update(dict.fromkeys(path, end))
        return end


def _is_aside(name: str, attributes: str) -> bool:
    if name in ASIDE:
        return True
    if "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", attributes, re.I):
        return True
    return False


def _is_marked(name: str, attributes: str) -> bool:
    if name == "form":
        return True
    for found in _MARKS.findall(attributes):
        if not ASIDE_WORDS.isdisjoint(_WORDS.findall("".join(found).lower())):
            return True
    return False


def blocks(html: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each MAIN (inside article or main), OPEN or GONE (inside a part that is no article)."""
    out, wrappers = _parse(html, frozenset())
    return _parse(html, wrappers)[0] if wrappers else out


def _parse(html: str, wrappers: frozenset[int]) -> tuple[list[tuple[str, int]], frozenset[int]]:
    """The blocks, where marked parts that begin at ``wrappers`` keep their text, and the places of all marked parts that are wrappers."""
    out: list[tuple[str, int]] = []
    held: dict[int, int] = {}
    marked: list[tuple[int, int]] = []
    within: list[list[int]] = []
    hidden, total = -1, 0
    line: list[str] = []
    stack: list[tuple[str, int]] = []
    state, line_state, pos, size = OPEN, OPEN, 0, len(html)

    def end_line() -> None:
        nonlocal total
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            out.append((text, line_state))
            if hidden < 0:
                total += len(text)
                for at, _ in marked:
                    held[at] += len(text)
        line.clear()

    def left() -> None:
        nonlocal hidden
        if hidden > len(stack):
            hidden = -1
        while marked and marked[-1][1] > len(stack):
            marked.pop()

    tags, headless = _Tags(html), False
    while pos < size:
        tag = tags.find(pos)
        upto = tag[0] if tag else size
        if upto > pos:
            line_state = state
            line.append(unescape(html[pos:upto]))
        if not tag:
            break
        start, pos, slash, name, attributes = tag
        name = name.lower()
        if not name:
            continue
        if name not in INLINE:
            end_line()
        if slash:
            at = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][0] == name), None)
            if at is not None and (name in CLOSES_P or name not in INLINE or not any(n not in INLINE for n, _ in stack[at + 1 :])):
                if line and (state != stack[at][1] or marked and marked[-1][1] > at):
                    end_line()
                state = stack[at][1]
                del stack[at:]
                left()
            continue
        if name in RAW:
            if attributes.endswith("/"):
                continue
            if name in ("head",):
                # a head holds no text; it ends with its tag or where the body begins
                stop = None if headless else _HEAD_END.search(html, pos)
                headless = stop is None
                pos = pos if stop is None else stop.end() if stop[0][1] == "/" else stop.start()
            else:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, pos)
                pos = size if stop is None else stop.end()
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in CLOSES_P and stack:
            at = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][0] not in INLINE), None)
            if at is not None and stack[at][0] == "p":
                state = stack[at][1]
                del stack[at:]
                left()
        stack.append((name, state))
        if hidden < 0 and name not in ("html", "body"):
            if _is_aside(name, attributes):
                if line:
                    end_line()
                hidden, state = len(stack), GONE
            else:
                if _is_marked(name, attributes):
                    if line:
                        end_line()
                    marked.append((start, len(stack)))
                    held[start] = 0
                    if start not in wrappers:
                        state = GONE
                if name in ("article", "main"):
                    within.append([at for at, _ in marked])
        if state == OPEN and name in ("article", "main"):
            state = MAIN
    end_line()
    if within:
        least = min(map(len, within))
        return out, frozenset(at for path in within if len(path) == least for at in path)
    return out, frozenset(at for at, n in held.items() if 2 * n > total)


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Indexes in ``a`` of a longest common subsequence with ``b``; common ends are stripped, the rest is found in rows of bits."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    both = set(x) & set(y)
    ix = [i for i, v in enumerate(x) if v in both]
    yy = [v for v in y if v in both]
    where: dict[int, int] = {}
    for j, v in enumerate(yy):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(yy)) - 1
    rows, row = [], full
    for i in ix:
        hit = row & where[x[i]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found, j = [], len(yy)
    for r in range(len(ix) - 1, -1, -1):
        # a cleared bit below j in this row but not in the one above: the match that made the length grow
        below = (1 << j) - 1
        before = rows[r - 1] if r else full
        if bin(~rows[r] & below).count("1") > bin(~before & below).count("1"):
            found.append(head + ix[r])
            gained = where[x[ix[r]]] & below
            need = bin(~rows[r] & below).count("1")
            j = next(p for p in range(gained.bit_length() - 1, -1, -1) if gained >> p & 1 and bin(~before & ((1 << p) - 1)).count("1") == need - 1)
    return [*range(head), *sorted(found), *range(len(a) - tail, len(a))]


def template_lines(hashes: list[int], states: list[int], sizes: list[int], other: list[int], beyond: list[int] | None = None) -> list[int]:
    """Lines of a page to delete as shared with its pair: of its open lines; where most of their text is shared, see the module's text. ``beyond`` is the neighbour on the other side."""
    common = shared_lines(hashes, other)
    opened = [i for i, s in enumerate(states) if s == OPEN]
    shared = [i for i in common if states[i] == OPEN]
    if sum(sizes[i] for i in shared) <= COPY_SHARE * sum(sizes[i] for i in opened):
        return shared
    if len(shared) == len(opened):
        return []
    if beyond is not None:
        also = set(shared_lines(hashes, beyond))
        return [i for i in shared if i in also]
    return shared if len(other) > len(common) else []


def _line_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for batch in batches:
        found = [blocks(x) for x in batch["html"]]
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"],
                "host": batch["host"],
                "path": batch["path"],
                "hashes": [[np.uint64(xxhash.xxh64_intdigest(t)).astype(np.int64) for t, _ in b] for b in found],
                "states": [[s for _, s in b] for b in found],
                "sizes": [[len(t) for t, _ in b] for b in found],
            }
        ).astype({"page_id": "Int64"})


def _ranked(lines: DataFrame) -> DataFrame:
    """``lines`` with ``rank``, the place of each row in the order of host, path and id, gapless over all rows."""
    order = ["host", "path", "page_id"]
    n = lines.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = stage_table(lines.repartitionByRange(int(n), *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "page-order")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    # one row for each partition of the order
    spans = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(F.broadcast(spans.select("part", "first", "before")), "part").withColumn("rank", F.col("before") + F.col("row") - F.col("first")).drop("part", "row", "first", "before")


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _decide(run: pd.DataFrame, begins: int, ends: int) -> list[tuple[int, list[int]]]:
    rows = list(run.sort_values("rank")[["rank", "page_id", "host", "path", "hashes", "states", "sizes"]].itertuples(index=False, name=None))
    out = []
    for i, (rank, page, host, path, hashes, states, sizes) in enumerate(rows):
        if not begins <= rank < ends or page is None or pd.isna(page):
            continue
        beside = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows) and rows[j][2] == host and rows[j][1] != page]
        if beside:
            pair = max(beside, key=lambda r: _common_prefix(path, r[3]))  # the one before on a tie
            beyond = next((list(r[4]) for r in beside if r is not pair), None)
            gone = template_lines(list(hashes), list(states), list(sizes), list(pair[4]), beyond)
            if gone:
                out.append((int(page), [int(hashes[j]) for j in gone]))
    return out


def template_of_pages(pages: DataFrame, block: int = 512) -> DataFrame:
    """(page_id, shared): the hashes of the lines that each page shares with its nearest page of the host."""
    bounded_batches(pages.sparkSession)
    src = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # written once: a range partitioning reads its input twice, and the pages would be parsed twice
    lines = stage_table(src.mapInPandas(_line_hashes, "page_id long, host string, path string, hashes array<long>, states array<byte>, sizes array<int>"), "page-lines")
    ranked = _ranked(lines)
    at = F.floor(F.col("rank") / block)
    # the rows at a block's edges also go to the block beside it, so that every page meets both neighbours
    edge = F.pmod("rank", F.lit(block))
    to = F.when(edge == 0, F.array(at, at - 1)).when(edge == block - 1, F.array(at, at + 1)).otherwise(F.array(at))
    placed = ranked.withColumn("__block", F.explode(to))

    def decided(keys: tuple, run: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_decide(run, keys[0] * block, (keys[0] + 1) * block), columns=["page_id", "shared"])

    found = placed.where(F.col("__block") >= 0).groupBy("__block").applyInPandas(decided, "page_id long, shared array<long>")
    return found.groupBy("page_id").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for batch in batches:
        texts = []
        for html, shared in zip(batch["html"], batch["shared"], strict=True):
            gone = set() if shared is None else {int(x) & (2**64 - 1) for x in shared}
            texts.append("\n".join(t for t, s in blocks(html) if s == MAIN or s == OPEN and xxhash.xxh64_intdigest(t) not in gone))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_template": batch["n_template"]}).astype({"page_id": "Int64"})


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_template (lines deleted as shared with the nearest page)."""
    shared = stage_table(template_of_pages(pages), "page-template")
    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).join(shared, "page_id", "left").withColumn("n_template", F.coalesce(F.size("shared"), F.lit(0)))
    return src.mapInPandas(_texts, "page_id long, url string, text string, n_chars long, n_template int")
