"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint is eight positional bytes. Two fingerprints within ``max_bits``
(at most two) differ in at most two bytes, so they share at least six
positional bytes: the guaranteed minimum of the count filter. The index
therefore posts a fingerprint under each choice of six positions with their
bytes; a pair meets in a posting list exactly if its tally of shared bytes
reaches the minimum. The two free bytes bound a list to 65,536 different
fingerprints, whatever the input, and exact copies are one entry. A list emits
a spanning set of verified links, never all its pairs: fingerprints within one
bit of a common value are within two bits of each other, so each is linked to
the smallest of them. The tally and the bit distance of every emitted link
are then checked as columns, and components join the links.

Defined cases: null or empty text has fingerprint zero and is linked like any
other; fewer words than a shingle: the whole sequence is the one shingle; a
null doc_id gets a component but never names one; repeated rows each keep
their row; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import connected_components, keyed_texts, materialize, per_batch

SHINGLE_BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(body: bytes | None, words: int) -> int:
    """The 64-bit fingerprint of one text as a signed integer."""
    w = (body or b"").lower().split()
    if not w:
        return 0
    text = b" ".join(w)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(words, len(w))
    a, b = starts[: len(w) - size + 1].tolist(), ends[size - 1:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for k in range(0, len(a), SHINGLE_BLOCK):
        raw = b"".join([digest(text[i:j], 42) for i, j in zip(a[k:k + SHINGLE_BLOCK], b[k:k + SHINGLE_BLOCK])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(a)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit fingerprint), one row per input row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    f = per_batch(lambda c: {"doc_id": c["doc_id"], "fp": [fingerprint(x, shingle_words) for x in c["body"]]}, schema)
    return keyed_texts(docs).select("doc_id", "body").mapInArrow(f, "doc_id long, fp long")


def spanning_links(values: list[int], max_bits: int) -> list[tuple[int, int]]:
    """Links (each within ``max_bits``) that connect what direct links would
    connect in one posting list; at most one fewer than its values."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []

    def link(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((values[i], values[j]))

    if len(values) <= 40 or max_bits != 2:
        bits = [v & 0xFFFFFFFFFFFFFFFF for v in values]
        for i, x in enumerate(bits):
            for j in range(i):
                if (x ^ bits[j]).bit_count() <= max_bits:
                    link(j, i)
        return out
    # The list differs in two bytes only: flip their bits around each value.
    v = np.array(values, np.int64)
    free = int(np.bitwise_or.reduce(v ^ v[0])) & 0xFFFFFFFFFFFFFFFF
    first: dict[int, int] = {}
    flips = [0, *(1 << k for k in range(64) if free >> k & 1)]
    for i, x in enumerate(values):
        x &= 0xFFFFFFFFFFFFFFFF
        for f in flips:
            link(first.setdefault(x ^ f, i), i)
    return out


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): verified links between different fingerprints of ``fps`` (fp, distinct)
    whose closure is that of all pairs within ``max_bits``."""
    if not 0 <= max_bits <= 2:
        raise ValueError("six shared positional bytes are guaranteed up to two differing bits")
    masks = [sum(255 << 8 * p for p in keep) for keep in combinations(range(8), 8 - 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posted = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed]))
                        .alias("choice", "shared"))
    lists = posted.groupBy("choice", "shared").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(cols: dict) -> dict | None:
        pairs = [p for values in cols["fps"] for p in spanning_links(sorted(values), max_bits)]
        return {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]} if pairs else None

    pairs = lists.select("fps").mapInArrow(per_batch(found, schema), "a long, b long").distinct()
    differ = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum(F.when(F.shiftrightunsigned(differ, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(8))
    return pairs.filter((tally >= 8 - 2) & (F.bit_count(differ) <= max_bits))


def simhash_groups(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id
    reachable over links of at most ``max_bits`` bits), one row per input row."""
    marked = materialize(fingerprints(docs, shingle_words), "simhash_fingerprints")
    firsts = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash_distinct")
    groups = connected_components(links(firsts, max_bits), "simhash_links")
    rooted = firsts.join(groups, firsts.fp == groups.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each component, with all columns: that of the smallest
    doc_id (one row, should its doc_id be repeated). Documents without a doc_id
    stay only where no member of the component has one."""
    groups = simhash_groups(docs, shingle_words, max_bits)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(
        F.col("doc_id").alias("_kept_id")).agg(F.count("*").alias("_kept_rows"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))  # so no column's name can clash
    found = rows.join(kept, F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("_kept_id")))
    once = found.filter("_kept_rows = 1").select("_doc")
    more = found.filter("_kept_rows > 1").groupBy("_kept_id").agg(F.first("_doc").alias("_doc")).select("_doc")
    return once.unionAll(more).select("_doc.*")
