"""Best-fit packing with certified bin counts.

Documents become token ids and one end id; longer ones are cut into full
sequences and a rest. The rests are dealt into bounded groups by hash. Each
group packs by best-fit decreasing and certifies its bin count by lower bounds
from dual-feasible functions: sums of f(size) never exceed 1 for what fits a
bin, so their total over a group bounds its bins from below. Groups whose
count meets the bound are done. Groups with a gap give back their bins that are
not full; those documents are dealt anew, fewer groups at a time, and
best-fit decreasing is run again, for ``ROUNDS`` rounds; what is left unfilled
in the last round stays so. A group holds ``GROUP`` pieces on average whatever
the input, so no task sees more.

Defined cases: null text is empty and has the end id alone; repeated rows are
packed each; rows with a null doc_id are packed too; empty table: no rows.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.bpe import WordEncoder
from stockflow.llm.common import keyed_texts, materialize, per_batch

GROUP = 16_384   # pieces of a group, on average
ROUNDS = 3
BIN_BITS = 24    # of a sequence's number for its place in the group

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def pieces(docs: DataFrame, tokenizer: str, sequence: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, uid (a hash by which pieces are dealt)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("uid", pa.int64())])

    def cut(encoder: WordEncoder):
        def of(cols: dict) -> dict:
            words = [(b or b"").split() for b in cols["body"]]
            flat, n_ids = encoder.of([w for ws in words for w in ws])
            n_words = np.cumsum([0] + [len(ws) for ws in words])
            edge = np.concatenate([[0], np.cumsum(n_ids)])[n_words]
            flat = flat.astype("<u4")
            out = {x.name: [] for x in schema}
            for i, doc in enumerate(cols["doc_id"]):
                ids = np.append(flat[edge[i]:edge[i + 1]], np.uint32(0)).astype("<u4")
                for k in range(0, len(ids), sequence):
                    part = ids[k:k + sequence]
                    for name, v in zip(out, (doc, k // sequence, k, len(part), zlib.crc32(part.tobytes()), cols["uid"][i] + k // sequence)):
                        out[name].append(v)
            return out
        return of

    def run(batches):
        yield from per_batch(cut(WordEncoder(tokenizer)), schema)(batches)

    rows = keyed_texts(docs).select("doc_id", "body", F.shiftright(F.xxhash64("doc_id", "text_key"), 1).alias("uid"))
    return rows.mapInArrow(run, PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that ``sizes`` need at least: the best of the total, and of the
    dual-feasible functions that round large sizes up to whole bins (threshold
    t: over C - t counts as C, under t as 0) or to multiples of C / k."""
    best = math.ceil(sizes.sum() / capacity)
    counts = np.bincount(sizes, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    for t in range(1, capacity // 2 + 1, max(1, capacity // 64)):
        f = np.where(size > capacity - t, capacity, np.where(size < t, 0, size))
        best = max(best, math.ceil(int((f * counts).sum()) / capacity))
    for k in range(1, 9):  # u(k): x(k+1)/C whole stays x, else floor((k+1)x/C)/k
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        total = int((np.where(whole, size * k, scaled // capacity * capacity) * counts).sum())
        best = max(best, math.ceil(total / (k * capacity)))
    return int(best)


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size: largest first, into the fullest bin that it fits."""
    bins = [-1] * len(sizes)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bitmap = 0  # rooms that some bin has
    opened = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fits = bitmap >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                bitmap &= ~(1 << room)
        else:
            b, room, opened = opened, capacity, opened + 1
        bins[i] = b
        if room > s:
            by_room[room - s].append(b)
            bitmap |= 1 << (room - s)
    return bins


def pack(rows: DataFrame, sequence: int = 2048, rounds: int = ROUNDS, group: int = GROUP) -> DataFrame:
    """Adds sequence_id, offset, and the certificate of the group that placed the
    piece: bins and lower_bound (the group's, at its last packing)."""
    left, done = rows, []
    schema = rows.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long, bins long, lower_bound long, open boolean"

    def place(last: bool, tag: int):
        def of(key, table):
            table = table.drop_columns(["part"]).sort_by([("length", "descending"), ("uid", "ascending"), ("piece", "ascending")])
            sizes = table.column("length").to_numpy()
            bins = np.array(best_fit_decreasing(sizes.tolist(), sequence), np.int64)
            count, bound = int(bins.max()) + 1, lower_bound(sizes, sequence)
            order = np.lexsort((np.arange(len(bins)), bins))
            ends = np.cumsum(sizes[order])
            first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
            offset = np.empty(len(bins), np.int64)
            offset[order] = ends - sizes[order] - np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
            filled = np.bincount(bins, weights=sizes)
            again = (not last) & (count > bound) & (filled[bins] < sequence)
            number = (key[0].as_py() << BIN_BITS | bins) * rounds + tag
            for col, v in (("sequence_id", pa.array(number)), ("offset", pa.array(offset)),
                           ("bins", pa.array([count] * len(bins), pa.int64())), ("lower_bound", pa.array([bound] * len(bins), pa.int64())),
                           ("open", pa.array(again))):
                table = table.append_column(col, v)
            return table
        return of

    for r in range(rounds):
        n = left.count()
        if not n:
            break
        dealt = left.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(max(1, math.ceil(n / group)))))
        packed = materialize(dealt.groupBy("part").applyInArrow(place(r == rounds - 1, r), schema), f"packed_{r}")
        done.append(packed.filter("not open").drop("open"))
        left = packed.filter("open").select(*rows.columns)
    if not done:
        return left.sparkSession.createDataFrame([], schema).drop("open")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def best_fit_packing(docs: DataFrame, tokenizer: str, sequence: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, bins, lower_bound."""
    return pack(materialize(pieces(docs, tokenizer, sequence), "pieces"), sequence).drop("uid")
