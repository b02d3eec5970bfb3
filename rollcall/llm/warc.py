"""WARC archives with revisit records, and a capture index merged from sorted runs.

Records are plain text lines of Spark's own text writer, whose line separator
is the blank line that ends a WARC record: each part file is one gzipped
archive, written by any executor to any file system Spark knows and committed
with the job, so lost tasks are simply run again. Reading goes by each
record's Content-Length. Every archive gives a run of captures that is sorted
locally by URL key and timestamp; the runs are merged by a loser tree in each
range of keys, which gives the captures in one global order.

Defined results: null HTML is the empty payload; a null URL is the empty URI;
records with equal payloads (of at least ``min_bytes``) refer to the one with
the largest page_id, rows without an id too; rows that repeat an id are
records of their own, each judged by its own payload, and all rows of the
largest id with that payload write responses; an empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import bounded_batches, stage_table
from rollcall.llm.url_filters import url_host
from rollcall.session import ensure_checkpoint_dir

END = "\r\n\r\n"
EPOCH = 1_700_000_000
#: Records after which an archive is closed; keeps a reader's memory bounded.
ARCHIVE_ROWS = 20_000


def base32(sha1_hex: Column) -> Column:
    """RFC 4648 base32 of a SHA-1 given as 40 hexadecimal digits: eight characters for each ten digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(4):
        bits = F.conv(F.substring(sha1_hex, 10 * i + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(alphabet), F.shiftright(bits, 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*out)


def surt_key(url: Column) -> Column:
    """URL key: host labels reversed and joined by commas, ``)``, then path and query without the fragment, lower-cased."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(url_host(u), r"\.")), ","), F.lit(")"), F.lower(rest))


def archive_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, record): the text of each page's WARC record, response or revisit, without the blank line that ends it."""
    html = F.coalesce("html", F.lit(""))
    src = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"))
    big = F.col("bytes") >= min_bytes
    leader = src.where(big).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    # a mark belongs to a payload of an id: another payload of the same id is a record of its own
    same = F.col("sha1").eqNullSafe(F.col("__sha1")) & F.col("page_id").eqNullSafe(F.col("__id"))
    marks = src.where(big).select("page_id", "sha1").join(leader, "sha1").where(~F.col("page_id").eqNullSafe(F.col("response")))
    marks = marks.select(F.col("page_id").alias("__id"), F.col("sha1").alias("__sha1"), "response").distinct()
    joined = src.join(marks, same, "left")
    revisit = F.col("response").isNotNull()
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(F.col("url"), r"[\r\n]", " ")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("X-Payload-Length", F.col("bytes")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("response").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
    )
    return joined.select("page_id", F.concat(head, F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Write the records of ``pages`` as gzipped WARC files under ``path``; returns the path."""
    records = archive_records(pages, min_bytes).select("record")
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_ROWS).mode("errorifexists").text(path)
    return path


def parse_archive(data: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, payload) of each record of an archive given as chunks of its gzipped bytes."""
    unzip, buffer, pos = zlib.decompressobj(31), bytearray(), 0
    chunks = iter(data)

    def more() -> bool:
        nonlocal unzip
        chunk = next(chunks, None)
        if chunk is None:
            return False
        while chunk:
            buffer.extend(unzip.decompress(chunk))
            chunk = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
        return True

    while True:
        end = buffer.find(b"\r\n\r\n", pos)
        while end < 0:
            seen = max(pos, len(buffer) - 3)
            if not more():
                if bytes(buffer[pos:]).strip():
                    raise ValueError("archive ends inside a record's header")
                return
            end = buffer.find(b"\r\n\r\n", seen)
        lines = bytes(buffer[pos:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        header = dict(x.split(": ", 1) for x in lines[1:])
        begin = end + 4
        stop = begin + int(header["Content-Length"])
        while len(buffer) < stop + 4:
            if not more():
                raise ValueError("archive ends inside a record")
        yield header, bytes(buffer[begin:stop])
        pos = stop + 4
        if pos > 1 << 20:
            del buffer[:pos]
            pos = 0


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures in the archives under ``path``: page_id, url, warc_date, payload_bytes, payload_digest, record_type, refers_to, run.

    A response whose payload does not have the length and digest of its header
    fails the job. Archives are no larger than a scan partition, which is what a task holds of them.
    """

    def number(urn: str) -> int | None:
        digits = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, run in zip(batch["content"], batch["run"], strict=True):
                view, rows = memoryview(content), []
                for header, payload in parse_archive(bytes(view[i : i + 65536]) for i in range(0, len(view), 65536)):
                    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind, size = header["WARC-Type"], int(header["X-Payload-Length"])
                    if kind == "response" and (len(payload), digest_of(payload)) != (size, digest):
                        raise ValueError(f"payload of {header['WARC-Record-ID']} is damaged")
                    refers = number(header["WARC-Refers-To"]) if "WARC-Refers-To" in header else None
                    rows.append((number(header["WARC-Record-ID"]), header["WARC-Target-URI"], header["WARC-Date"], size, digest, kind, refers, run))
                out = pd.DataFrame(rows, columns=["page_id", "url", "warc_date", "payload_bytes", "payload_digest", "record_type", "refers_to", "run"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content", F.xxhash64("path").alias("run"))
    schema = "page_id long, url string, warc_date string, payload_bytes long, payload_digest string, record_type string, refers_to long, run long"
    return files.mapInPandas(captures, schema)


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, so that the next item costs one match a level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(runs)
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else self.k - 1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if not self._beats(w, self.losers[node]):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def merged_index(captures: DataFrame) -> DataFrame:
    """``captures`` in global order of url_key, warc_date and page_id: each partition is a range of keys, merged from the runs' sorted parts."""
    spark = captures.sparkSession
    keyed = captures.withColumn("url_key", surt_key(F.col("url")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["url_key", "warc_date", "page_id"]
    runs = keyed.repartitionByRange(n, *key).sortWithinPartitions("run", *key)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        keys = list(zip(rows["url_key"], rows["warc_date"], rows["page_id"].fillna(-1), strict=True))
        sorted_runs = [iter([(keys[i], i) for i in at]) for at in rows.groupby("run", sort=False).indices.values()]
        order = [i for _, i in LoserTree(sorted_runs)]
        yield rows.iloc[order].astype({"page_id": "Int64", "refers_to": "Int64"})

    return runs.mapInPandas(merge, runs.schema)


def archive_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def archive_and_index(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back and merge their runs: one row per page in the order of the index."""
    spark = pages.sparkSession
    bounded_batches(spark)
    path = write_archives(pages, path or archive_path(spark), min_bytes)
    # written once: the range partitioning would read the archives twice
    return merged_index(stage_table(read_archives(spark, path), "captures"))
