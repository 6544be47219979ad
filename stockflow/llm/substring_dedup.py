"""Substring dedup over word windows with a count-min prefilter.

Pass 1: every partition sketches its windows (two hash rows, counts saturating
at two); the partitions' sketches travel as gap-coded cells, are merged by
slices of the cell space, and leave one bit a cell: counted twice or more.
Counts are only ever overestimated. The number of cells follows the number of
words up to ``MAX_LOG_CELLS``, which bounds the broadcast of the bits (128 MB
at most); beyond it the filter passes more windows and results stay the same.

Pass 2 hashes all windows again and sends on only those estimated repeated,
with 96 bits of two independent hashes, grouped exactly. Within a chunk of
documents a sequence is sent once, with its smallest document: later copies in
the chunk are already known to go and are sent by their document instead, so a
sequence that a third of all documents share costs its group one entry a chunk,
not one a document. Removed windows return to their documents as gap-coded
positions and the whole texts are cut.

Defined cases: null or empty text has no words and no removals; fewer words than
a window: unchanged; windows repeated within one document only stay; documents
with a null doc_id are never removed from and make nobody else's words repeated;
rows that repeat a doc_id are one document, of which no row outranks
another; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import WordHashes, keyed_texts, mix64, narrow, pack_sorted, per_batch, unpack_sorted, widen

ROWS = 2                 # hash rows of the sketch
MIN_LOG_CELLS, MAX_LOG_CELLS = 16, 29
LOG_SLICE = 21           # cells merged by one group
WORDS_PER_GROUP = 2_000_000  # of the exact pass, by which it is split
SKETCHED = 4_000_000     # windows that a task sketches before it sends the cells

_FACTOR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def window_hashes(words: np.ndarray, size: int, lane: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` word hashes; ``lane`` picks the function."""
    n = len(words) - size + 1
    if lane:
        words = mix64(words ^ np.uint64(0x5851F42D4C957F2D))
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        out = out * _FACTOR[lane] + words[j:j + n]
    return mix64(out)


def _cells(h: np.ndarray, row: int, log_cells: int) -> np.ndarray:
    return ((h if row == 0 else mix64(h * np.uint64(0xA0761D6478BD642F) + np.uint64(row))) >> np.uint64(64 - log_cells)).astype(np.int64)


def _chunk_windows(cols: dict, cache: WordHashes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a chunk one document after the other, the number of words
    of each, and where windows inside one document start."""
    parts = [cache.of(w.split()) if w and d is not None else np.zeros(0, np.uint64) for d, w in zip(cols["doc_id"], cols["body"])]
    n = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    total = len(flat)
    if total < size:
        return flat, n, np.zeros(0, np.int64)
    left = np.repeat(np.cumsum(n), n) - np.arange(total)  # words up to the document's end
    starts = np.flatnonzero(left >= size)
    return flat, n, starts


def sketch_bits(texts: DataFrame, size: int, log_cells: int) -> DataFrame:
    """(part, bits): packed bits of the cells counted at least twice; a part is a
    slice of one hash row."""
    log_slice = min(LOG_SLICE, log_cells)
    schema = pa.schema([("part", pa.int32()), ("cells", pa.binary())])

    def sketch(h: np.ndarray) -> pa.RecordBatch:
        part, cells = [], []
        for row in range(ROWS):
            c = np.sort(_cells(h, row, log_cells))
            c = np.delete(c, 2 + np.flatnonzero(c[2:] == c[:-2]))  # a count of two is all that matters
            cuts = np.searchsorted(c, np.arange(0, (1 << log_cells) + 1, 1 << log_slice))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                part.append(row << (log_cells - log_slice) | k)
                cells.append(pack_sorted(c[cuts[k]:cuts[k + 1]] - (k << log_slice)))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(cells, pa.binary())], schema=schema)

    def merge(key, table):
        seen, twice = np.zeros(1 << log_slice, bool), np.zeros(1 << log_slice, bool)
        for data in table.column("cells"):
            c = unpack_sorted(data.as_py())
            twice[c[seen[c]]] = True
            twice[c[1:][c[1:] == c[:-1]]] = True
            seen[c] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    def run(batches):
        cache, held = WordHashes(), []

        def hashes(cols: dict) -> None:
            flat, _, starts = _chunk_windows(cols, cache, size)
            held.append(window_hashes(flat, size, 0)[starts])

        for batch in batches:
            for _ in per_batch(hashes, schema)([batch]):
                pass
            if sum(map(len, held)) >= SKETCHED:
                yield sketch(np.concatenate(held))
                held.clear()
        if held:
            yield sketch(np.concatenate(held))

    return texts.mapInArrow(run, "part int, cells binary").groupBy("part").applyInArrow(merge, "part int, bits binary")


def _replies(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, at: np.ndarray, groups: int) -> dict[str, list]:
    """Positions of documents (``doc``: places in ``ids`` and ``keys``), dealt by document: a row for each
    bucket, its documents with their positions gap-coded."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    used, first = np.unique(doc, return_index=True)
    packed = [pack_sorted(at[a:b]) for a, b in zip(first, np.append(first[1:], len(doc)))]
    bucket = (mix64(ids[used].astype(np.uint64) ^ mix64(keys[used].astype(np.uint64))) % np.uint64(groups)).astype(np.int64)
    out: dict[str, list] = {"bucket": [], "doc_ids": [], "text_keys": [], "starts": []}
    for k in np.unique(bucket).tolist():
        mine = np.flatnonzero(bucket == k)
        for name, v in zip(out, (k, ids[used[mine]], keys[used[mine]], [packed[i] for i in mine])):
            out[name].append(v)
    return out


def repeated_words(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, text_key, starts (lists of gap-coded positions of the removed windows),
    one row per document with removals."""
    spark = docs.sparkSession
    texts = keyed_texts(docs)
    # Half the bytes bounds the words from above; it sizes the sketch only.
    total = texts.agg(F.sum(F.length("body"))).first()[0] or 0
    words = max(1, total // 6)
    log_cells = min(MAX_LOG_CELLS, max(MIN_LOG_CELLS, math.ceil(math.log2(1.5 * words))))
    groups = max(1, math.ceil(words / WORDS_PER_GROUP))
    log_slice = min(LOG_SLICE, log_cells)
    per_row = 1 << (log_cells - log_slice)
    bits = np.zeros((ROWS * per_row, 1 << max(0, log_slice - 3)), np.uint8)
    for row in sketch_bits(texts, size, log_cells).toLocalIterator():  # at most ROWS * 2^MAX_LOG_CELLS bits
        bits[row.part] = np.frombuffer(row.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bits.reshape(ROWS, -1))
    schema = pa.schema([("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())),
                        ("doc", pa.binary()), ("start", pa.binary()), ("h", pa.binary()), ("check", pa.binary()),
                        ("starts", pa.list_(pa.binary()))])

    def candidates(cache: WordHashes, table: np.ndarray):
        def maybe(h: np.ndarray) -> np.ndarray:
            keep = np.ones(len(h), bool)
            for row in range(ROWS):
                c = _cells(h, row, log_cells)
                keep &= (table[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
            return keep

        def of(cols: dict) -> dict | None:
            flat, n, starts = _chunk_windows(cols, cache, size)
            if not len(starts):
                return None
            h = window_hashes(flat, size, 0)[starts]
            keep = maybe(h)
            starts, h = starts[keep], h[keep]
            if not len(starts):
                return None
            check = (window_hashes(flat, size, 1)[starts] >> np.uint64(32)).astype(np.uint32)
            ids = np.array([0 if d is None else d for d in cols["doc_id"]], np.int64)
            begin = np.concatenate([[0], np.cumsum(n)])
            doc = np.searchsorted(begin, starts, "right") - 1
            at = starts - begin[doc]
            order = np.lexsort((ids[doc], check, h))
            h, check, doc, at = h[order], check[order], doc[order], at[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
            least = ids[doc][np.flatnonzero(new)][np.cumsum(new) - 1]
            sent = ids[doc] == least  # the rest has a smaller document in this very chunk
            part = (h >> np.uint64(32)).astype(np.int64) * groups >> 32
            out = {x.name: [] for x in schema}
            keys = np.array(cols["text_key"], np.int64)
            for p in np.unique(part[sent]):
                r = rows_of(part, sent, p)
                used, local = np.unique(doc[r], return_inverse=True)
                for name, v in zip(out, (int(p), ids[used], keys[used], narrow(local), narrow(at[r]), h[r].tobytes(), check[r].tobytes(), None)):
                    out[name].append(v)
            if not sent.all():  # known to go: past the groups of windows, by document (parts below 0)
                known = _replies(ids, keys, doc[~sent], at[~sent], groups)
                for row in zip(*known.values()):
                    for name, v in zip(out, (-1 - row[0], row[1], row[2], None, None, None, None, row[3])):
                        out[name].append(v)
            return out

        def rows_of(part: np.ndarray, rows: np.ndarray, p: int) -> np.ndarray:
            a, b = np.searchsorted(part, [p, p + 1])  # h is sorted, so parts are
            return a + np.flatnonzero(rows[a:b])
        return of

    def run(batches):
        yield from per_batch(candidates(WordHashes(), shared.value), schema)(batches)

    def decide(key, table):
        part = key[0].as_py()
        if part < 0:
            return table.select(["doc_ids", "text_keys", "starts"]).add_column(0, "bucket", pa.array([-1 - part] * len(table), pa.int32()))
        got = table.to_pydict()
        docs_of, starts_of = [widen(x) for x in got["doc"]], [widen(x) for x in got["start"]]
        sizes = [len(x) for x in docs_of]
        base = np.concatenate([[0], np.cumsum([len(x) for x in got["doc_ids"]])])
        ids = np.array([i for x in got["doc_ids"] for i in x], np.int64)
        keys = np.array([k for x in got["text_keys"] for k in x], np.int64)
        doc = np.concatenate(docs_of) + np.repeat(base[:-1], sizes)
        at = np.concatenate(starts_of)
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in got["h"]])
        check = np.concatenate([np.frombuffer(x, np.uint32) for x in got["check"]])
        rows = np.lexsort((ids[doc], check, h))
        h, check, owner = h[rows], check[rows], ids[doc[rows]]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
        goes = rows[owner > owner[np.flatnonzero(new)][np.cumsum(new) - 1]]
        out = _replies(ids, keys, doc[goes], at[goes], groups)
        lists = pa.list_(pa.int64())
        return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(out.items(), (pa.int32(), lists, lists, pa.list_(pa.binary())))})

    def by_document(key, table):
        got = table.to_pydict()
        found: dict = {}
        for ids, keys, starts in zip(got["doc_ids"], got["text_keys"], got["starts"]):
            for doc, text_key, s in zip(ids, keys, starts):
                found.setdefault((doc, text_key), []).append(s)
        return pa.table({"doc_id": pa.array([d for d, _ in found], pa.int64()), "text_key": pa.array([k for _, k in found], pa.int64()),
                         "starts": pa.array(list(found.values()), pa.list_(pa.binary()))})

    asked = texts.mapInArrow(run, "part int, doc_ids array<long>, text_keys array<long>, doc binary, start binary, h binary, check binary, starts array<binary>")
    return asked.groupBy("part").applyInArrow(decide, "bucket int, doc_ids array<long>, text_keys array<long>, starts array<binary>") \
        .groupBy("bucket").applyInArrow(by_document, "doc_id long, text_key long, starts array<binary>")


def substring_dedup(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by one space);
    one row per input row."""
    texts = keyed_texts(docs)
    gone = repeated_words(docs, size).withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
    both = texts.join(gone, (texts.doc_id == gone.of_id) & (texts.text_key == gone.of_key), "left").select("doc_id", "body", "starts")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(cols: dict) -> dict:
        out = {x.name: [] for x in schema}
        for d, body, starts in zip(cols["doc_id"], cols["body"], cols["starts"]):
            words = (body or b"").split()
            n = len(words)
            if starts:
                edge = np.zeros(n + 1, np.int64)
                for s in map(unpack_sorted, starts):
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + size, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            for name, v in zip(out, (d, n, n - len(words), b" ".join(words).decode("utf-8", "replace"))):
                out[name].append(v)
        return out

    return both.mapInArrow(per_batch(cut, schema), "doc_id long, n_words long, n_removed long, kept string")
