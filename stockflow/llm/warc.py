"""WARC archives: write, read back, and index as capture histories.

Pages become WARC/1.1 records; of equal payloads of ``LEAST`` bytes or more the
one with the smallest page_id is a response and the others are revisits of it
without a payload. Spark's text writer writes the archives (a record is a
value, the record separator its line separator), so a lost task is simply
written again. Reading back, Spark's text reader streams an archive in pieces,
from which records are put together one at a time: of an archive a task holds a
batch of pieces and the record at hand. The captures of an archive are a run.
Runs are dealt into ranges of (URL key, timestamp, page_id), so that a much
captured URL spans several ranges, and Spark sorts each run's part of a range
(spilling to disk where need be); a loser tree then merges the sorted runs of
the range by their keys and copies rows in bounded pieces.

The pages carry no capture time; unless a column is named, page_id seconds
after 1970 stand for it, so page_id order is capture order. Times before 1970
and after 9999 (ids below zero or of over 253 billion) are set to the first
and last of these seconds, where page_id alone orders the captures.

Defined cases: null html is an empty payload; null url has no target URI and an
empty URL key; line ends in a url are percent-encoded; a null page_id never
names a response; rows that repeat page_id and payload are all responses or
all revisits; empty table: no rows. Reads page_id, url and html only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm.common import materialize
from stockflow.session import scratch_table_path

LEAST = 100          # payload bytes from which equal ones become revisits
RECORDS = 2_000      # of an archive file at most
CAPTURES = 50_000    # of a range, on average
BATCH = 1_000        # captures handed over at once
LAST_SECOND = 253_402_300_799  # of the year 9999
END = "\r\n"

CAPTURE = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("at", pa.int64()), ("size", pa.int64())])
_DDL = "run string, url_key string, captured string, page_id long, url string, record_type string, refers_to long, " \
       "payload_bytes long, payload_digest string, at long, size long"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit(END)), F.lit(""))


def write_archives(pages: DataFrame, captured: str | None = None) -> str:
    """Writes all pages as gzip-compressed WARC files and returns their folder."""
    html = F.coalesce(F.col("html"), F.lit(""))
    seconds = F.col("page_id").cast("long") if captured is None else F.unix_seconds(F.col(captured).cast("timestamp"))
    seconds = F.least(F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)), F.lit(LAST_SECOND))
    when = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("html"),
                        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
                        F.octet_length(html).cast("long").alias("bytes"), F.sha2(html.cast("binary"), 256).alias("digest"))
    first = rows.filter(F.col("bytes") >= LEAST).groupBy(F.col("digest").alias("of_digest")).agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(first, F.col("digest") == F.col("of_digest"), "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    payload = F.when(again, "").otherwise(F.col("html"))
    record = F.concat(
        F.lit("WARC/1.1" + END),
        _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        _header("WARC-Date", F.col("captured")),
        _header("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Refers-To", F.when(again, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        _header("X-Payload-Length", F.col("bytes")),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", F.octet_length(payload)),
        F.lit(END), payload)
    folder = scratch_table_path(pages.sparkSession, "warc")
    rows.select(record.alias("value")).write.option("lineSep", END * 2).option("compression", "gzip") \
        .option("maxRecordsPerFile", RECORDS).text(folder)
    return folder


def url_key(url: str | None) -> str:
    """Host labels from the last, then path and query, in lower case."""
    if not url or "://" not in url:
        return ""
    host, slash, rest = url.split("://", 1)[1].partition("/")
    return (",".join(reversed(host.split("."))) + ")" + slash + rest).lower()


class Records:
    """The records of an archive, from consecutive pieces of its bytes: at most the
    record at hand is held."""

    def __init__(self):
        self.held, self.at, self.need, self.head = bytearray(), 0, 0, None

    def feed(self, piece: bytes) -> Iterator[dict]:
        self.held += piece
        while len(self.held) >= self.need:
            if self.head is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                first, *lines = bytes(self.held[:end]).decode("utf-8", "replace").split(END)
                if first != "WARC/1.1":
                    raise ValueError(f"no WARC record at byte {self.at}")
                self.head = {name: value for name, _, value in (x.partition(": ") for x in lines)}
                self.start, self.need = end + 4, end + 8 + int(self.head["Content-Length"])
                continue
            payload, tail = bytes(self.held[self.start:self.need - 4]), self.held[self.need - 4:self.need]
            if tail != b"\r\n\r\n":
                raise ValueError(f"the record at byte {self.at} doesn't end where it says")
            yield {"headers": self.head, "payload": payload, "at": self.at, "size": self.need}
            del self.held[:self.need]
            self.at, self.need, self.head = self.at + self.need, 0, None
            if not self.held:
                return

    def close(self) -> None:
        if self.held:
            raise ValueError(f"the record at byte {self.at} is cut short")


def _page(value: str | None) -> int | None:
    digits = value[len("<urn:page:"):-1] if value else ""
    return int(digits) if digits else None


def _capture(run: str, r: dict) -> dict:
    h = r["headers"]
    digest, n = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
    if h["WARC-Type"] == "response":
        if (len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest()) != (n, digest):
            raise ValueError(f"the payload at byte {r['at']} of {run} doesn't have its digest")
    url = h.get("WARC-Target-URI")
    return {"run": run, "url_key": url_key(url), "captured": h["WARC-Date"], "page_id": _page(h["WARC-Record-ID"]), "url": url,
            "record_type": h["WARC-Type"], "refers_to": _page(h.get("WARC-Refers-To")), "payload_bytes": n, "payload_digest": digest,
            "at": r["at"], "size": r["size"]}


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives, in the order of their records."""
    def captures(batches):
        path, found, reader = None, [], Records()
        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != path:
                    reader.close()
                    path, reader = name, Records()
                # Every piece ended with the separator that the reader took off.
                found += [_capture(path.rsplit("/", 1)[-1], r) for r in reader.feed(piece.as_py() + b"\r\n\r\n")]
                if len(found) >= BATCH:
                    yield pa.RecordBatch.from_pylist(found, schema=CAPTURE)
                    found = []
        reader.close()
        yield pa.RecordBatch.from_pylist(found, schema=CAPTURE)

    pieces = spark.read.option("lineSep", END * 2).text(folder)
    return pieces.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece")).mapInArrow(captures, _DDL)


def merge_runs(runs: list, key) -> Iterator:
    """k-way merge of sorted runs by a loser tree: each inner node keeps the loser
    of its match, so a new head replays one path of log2(k) matches."""
    k = len(runs)
    if not k:
        return
    top = (1,)  # after every key: a run that has ended
    heads = [((0, key(r[0])) if r else top) for r in runs]
    at = [0] * k
    tree = [0] * k          # losers; tree[0] is the winner

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        win, tree[node] = (a, b) if (heads[a], a) <= (heads[b], b) else (b, a)
        return win

    tree[0] = build(1)
    while heads[tree[0]] != top:
        w = tree[0]
        yield runs[w][at[w]]
        at[w] += 1
        heads[w] = (0, key(runs[w][at[w]])) if at[w] < len(runs[w]) else top
        node = (w + k) // 2
        while node:
            if (heads[tree[node]], tree[node]) < (heads[w], w):
                w, tree[node] = tree[node], w
            node //= 2
        tree[0] = w


def capture_histories(captures: DataFrame) -> DataFrame:
    """All captures in global order of (url_key, captured, page_id, run, at), a null page_id
    first: ranges in the order of the partitions, each merged from its runs."""
    keys = ["url_key", "captured", "page_id", "run", "at"]

    def merge(batches):
        table = pa.Table.from_batches(list(batches), schema=CAPTURE).combine_chunks()
        if not len(table):
            return
        ids = table["run"].combine_chunks().dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1, append=ids[-1] + 1))
        columns = [table[c].to_pylist() for c in keys]

        def key(i: int) -> tuple:
            url, when, page, run, at = (c[i] for c in columns)
            return url, when, page is not None, page or 0, run, at

        order = np.fromiter(merge_runs([range(a, b) for a, b in zip(cuts, cuts[1:])], key), np.int64, len(table))
        for k in range(0, len(order), BATCH):
            yield from table.take(order[k:k + BATCH]).combine_chunks().to_batches()

    ranges = max(1, -(-captures.count() // CAPTURES))
    # The place of a record deals out even rows that repeat page_id and url.
    dealt = captures.repartitionByRange(ranges, *keys)
    return dealt.sortWithinPartitions("run", "url_key", "captured", "page_id", "at").mapInArrow(merge, _DDL)


def archive(pages: DataFrame, captured: str | None = None) -> DataFrame:
    """Writes the pages as archives, reads these back and returns the histories."""
    spark = pages.sparkSession
    return capture_histories(materialize(read_archives(spark, write_archives(pages, captured)), "captures"))
