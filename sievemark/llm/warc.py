"""WARC archives and a globally ordered capture index, by external merge of sorted runs.

Pages are written as WARC records by Spark's text writer, whose line separator is the blank line that ends a record, so
that the files go wherever Spark writes and a lost task is written anew. The archives are read back as whole files, each a
bounded number of records. Every archive gives one run of the index, sorted by URL key, timestamp and page; ranges of the
key are dealt over the tasks by count, and each task merges the runs' parts in its range with a loser tree. Only index
rows are shuffled. A URL that holds a third of all captures is spread over ranges by timestamp and page.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_KEYS, materialise, scratch_path, small_batches, text_or_empty

CRLF = "\r\n"
#: Fixed value: the alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Timestamp of page 0 where the table has none; page n follows n seconds later, up to these, after which it starts anew.
FIRST_CAPTURE = "2024-01-01T00:00:00Z"
CAPTURE_SECONDS = 250 * 365 * 86400
#: An archive is read back as one value; so many bytes at most, where no record is larger by itself.
ARCHIVE_BYTES = 512 << 20
INDEX = (
    "run string, place long, url_key string, captured string, page_id string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to string, offset long, length long"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hexadecimal digits make four characters."""
    def letters(digest: Column) -> Column:
        five = lambda i: F.conv(F.substr(digest, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("long")
        place = lambda i: F.pmod(F.floor(five(i) / F.pow(32, 3 - i % 4)), F.lit(32)).cast("int") + 1
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substr(F.lit(BASE32), place(i), F.lit(1))), "")

    # through an array of one element the digest is worked out once, not for each letter
    return F.element_at(F.transform(F.array(F.sha1(payload.cast("binary"))), letters), 1)


def write_warc(pages: DataFrame, path: str, min_payload: int = 0, records_per_file: int = 1000) -> None:
    """Write one record per row of ``pages (page_id, url, html)``.

    Of the rows with equal payloads of ``min_payload`` bytes or more, those with the smallest ``page_id`` are responses and
    the others revisits of it; shorter payloads are always responses. A null html is an empty payload, a null url an empty
    one; a null ``page_id`` comes after all others. Repeated rows are written each, alike. Ends of lines in a url are written
    as %0D and %0A. An archive has ``records_per_file`` records, fewer where pages are so large that it would grow too long.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text_or_empty("html").alias("html")
    )
    size, last = F.octet_length("html"), F.lit(2**63 - 1)
    own = own.withColumn("digest", base32_sha1(F.col("html"))).withColumn("size", size).withColumn("rank", F.coalesce("page", last))
    # map-side combined: a payload that most pages share sends one row for each task
    firsts = own.where(F.col("size") >= min_payload).groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("other"))
    firsts = firsts.where("first < other").select("digest", "first")
    revisits = own.select("digest", "rank", "size").where(F.col("size") >= min_payload).join(firsts, "digest").where("rank > first")
    revisits = revisits.select("digest", "rank", F.col("first").cast("string").alias("refers_to")).distinct()
    revisits = materialise(revisits, "revisits")
    few = revisits.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS  # then pages need not move; beyond it they are dealt by key
    marked = own.join(F.broadcast(revisits) if few else revisits, ["digest", "rank"], "left")

    page = F.coalesce(F.col("page").cast("string"), F.lit("null"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    again = F.col("refers_to").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_CAPTURE), "yyyy-MM-dd'T'HH:mm:ss'Z'") + F.pmod(F.coalesce("page", F.lit(0)), F.lit(CAPTURE_SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")), F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)
    largest = own.agg(F.max("size")).first()[0] or 0
    records_per_file = max(1, min(records_per_file, ARCHIVE_BYTES // (largest + 2000)))
    marked.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)")


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: captures of one page sort together, and so do those of one domain."""
    found = _HOST.match(url.lower())
    if not found:
        return url.lower()
    labels = found[1].removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (found[2] or "/")


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an archive; lengths are followed, blank lines in blocks not."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end].decode().split(CRLF)
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in head[1:] if line)}
        stop = end + int(headers["content-length"])
        yield at, stop + 4 - at, headers, data[end:stop]
        at = stop + 4


def _page_of(urn: str | None) -> str | None:
    return urn and urn.removeprefix("<urn:page:").removesuffix(">")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run for each archive; a response's payload is digested again."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows = []
            for offset, length, headers, block in records(content.as_py()):
                digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["warc-payload-length"])
                if headers["warc-type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                rows.append((
                    url_key(headers["warc-target-uri"]), headers["warc-date"], _page_of(headers["warc-record-id"]),
                    headers["warc-type"], size, digest, _page_of(headers.get("warc-refers-to")), offset, length,
                ))
            rows.sort(key=_order)
            columns = list(zip(*rows)) or [[]] * 9
            names = [p.split()[0] for p in INDEX.split(", ")]
            types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), *[pa.string()] * 2, *[pa.int64()] * 2]
            values = [[path.as_py()] * len(rows), list(range(len(rows))), *columns]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)


def _order(row: tuple) -> tuple:
    return row[0], row[1], len(row[2]), row[2]


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so one row costs log2(k) comparisons."""

    def __init__(self, runs: list[list[tuple]], key) -> None:
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads: list[Any] = [key(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            run = self.losers[0]
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self.key(self.runs[run][self.at[run]]) if self.at[run] < len(self.runs[run]) else None
            self._replay(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range of keys, whose number is bounded: the parts of the runs, merged."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).sort_by([("run", "ascending"), ("place", "ascending")])
    names = [n for n in table.schema.names]
    rows = list(zip(*(table.column(n).to_pylist() for n in names)))
    runs: dict[str, list[tuple]] = {}
    for row in rows:
        runs.setdefault(row[0], []).append(row)
    merged = list(LoserTree(list(runs.values()), lambda r: _order(r[2:5])))
    columns = list(zip(*merged))
    yield pa.RecordBatch.from_arrays([pa.array(c, table.schema.field(i).type) for i, c in enumerate(columns)], schema=table.schema)


def read_index(spark: SparkSession, path: str, rows_per_range: int = 50_000) -> DataFrame:
    """The capture index of the archives under ``path``, in order of URL key, timestamp and page over all partitions."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = materialise(files.mapInArrow(_runs, INDEX), "warc-runs")
    ranges = max(1, math.ceil(runs.count() / rows_per_range))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", F.length("page_id"), "page_id")
    return dealt.mapInArrow(_merge, INDEX)


def archive_pages(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder, read them back, and return the merged index.

    An empty table writes no record and gives an empty index. Other columns, whatever their names, are ignored; payloads
    of any length are written whole. Ties of URL and timestamp are ordered by page.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_payload)
    return read_index(pages.sparkSession, path)
