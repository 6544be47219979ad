"""Helpers shared by the corpus operators.

Row identity: a document is known by ``doc_id`` together with a hash of its
text (``text_key``), so repeated rows and repeated ids keep defined results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.session import materialize

__all__ = ["CHUNK_BYTES", "WordHashes", "chunks", "connected_components", "documents", "keyed_texts", "materialize",
           "mix64", "narrow", "pack_sorted", "per_batch", "unpack_sorted", "widen", "with_groups",
           "word_codes"]

# A group of over one row in so many is hot; there are at most so many hot groups.
HOT_SHARE = 1024
# Text bytes that a Python task works on at once; longer texts are a chunk of their own.
CHUNK_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text; null text hashes as null) and the
    whole text as UTF-8 ``body`` (null text: null). Other columns are dropped,
    so extra columns of the input can't clash with working names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                       F.col("text").cast("binary").alias("body"))


def chunks(bodies: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``limit`` bytes (one text at least)."""
    start = total = 0
    for i, b in enumerate(bodies):
        n = len(b) if b else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(bodies):
        yield start, len(bodies)


def per_batch(f: Callable[[dict], dict | None], schema: pa.Schema, limit: int = CHUNK_BYTES) -> Callable:
    """A mapInArrow function from one over the columns of a chunk of rows.

    ``f`` gets ``{column: list}`` of at most ``limit`` bytes of ``body`` and
    returns the columns of its output rows, or None for none."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            size_by = cols.get("body") or [None] * batch.num_rows
            for a, b in chunks(size_by, limit):
                out = f({k: v[a:b] for k, v in cols.items()})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in schema], schema=schema)
    return run


class WordHashes(dict):
    """Word (bytes) -> XXH64, computed once per word; emptied when it grows
    beyond ``most`` entries so that memory stays bounded."""

    def __init__(self, most: int = 1 << 18):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def word_codes(bodies: list) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of texts (null: none), A-Z lower-cased, split at ASCII white space: the
    different words, which of them stands at each place, and each text's number of words."""
    texts = [(b or b"").lower() for b in bodies]
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    turn = np.flatnonzero(np.diff(inside, prepend=False))  # where words begin and end; the last byte is in none
    first, end = turn[::2], turn[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), np.diff(ends, prepend=0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and odd multiplications)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted non-negative integers (repeats allowed) as byte-wise gaps: a gap is
    any number of bytes 255 and one smaller byte, whose sum it is."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    long, rest = np.divmod(gaps, 255)
    ends = np.cumsum(long + 1) - 1
    out = np.full(int(ends[-1]) + 1, 255, np.uint8)
    out[ends] = rest
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def narrow(x: np.ndarray) -> bytes:
    """Small integers in two bytes each if they fit, else in four; the last byte tells."""
    wide = bool(len(x) and x.max() >= 1 << 16)
    return x.astype(np.uint32 if wide else np.uint16).tobytes() + bytes([4 if wide else 2])


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data[:-1], np.uint32 if data[-1] == 4 else np.uint16).astype(np.int64)


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) with the columns of their group, null where there is none.
    ``groups`` is unique by ``key``, ``size`` its number of rows. Hot groups are at most
    ``HOT_SHARE`` and joined by broadcast, so no key brings many rows to one task."""
    limit = total / HOT_SHARE
    hot, cold = groups.filter(F.col(size) > limit), groups.filter(F.col(size) <= limit)
    found = rows.join(F.broadcast(hot), key, "left")
    return found.filter(F.col(size).isNotNull()).unionByName(
        found.filter(F.col(size).isNull()).select(*rows.columns).join(cold, key, "left"))


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long), root being the smallest
    node of its component. Alternating large-star and small-star rounds: each
    round joins every node to its smallest neighbour by a grouped minimum, so
    a node of any degree is never gathered, and each round's edges are a
    written table (short lineage). Ends when a round changes nothing."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b")
        if large:
            both = both.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        to = both.join(least, "a")
        if large:
            return to.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return to.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))).filter("a > b")

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .filter("a > b").distinct(), name)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = materialize(star(star(now, True), False).distinct(), name)
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
