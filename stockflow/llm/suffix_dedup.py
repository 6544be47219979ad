"""Suffix-array dedup of bytes, built column-wise over many documents at once.

A byte goes if a string of ``size`` bytes that covers it also starts elsewhere.
Equal strings must meet in one task without shuffling every string, so each
string of ``size`` bytes is assigned to an anchor: its smallest ``GRAM``-byte hash
(the first of equals), which depends on its bytes alone. The strings of one
anchor make up a segment of under twice ``size`` bytes. Anchors that occur
once have no repeated strings; the others send their segments to buckets by the
anchor's hash, equal segments of a chunk once with all their places.

In a bucket the collection's suffix order is built the column-wise way: a
segment at a phase is a document over symbols of ``SYMBOL`` bytes, every round
inserts one more symbol in front of each document's last suffix, its place
following from the symbol and the rank of that suffix, and the common
prefixes with both neighbours are updated from range minima of the round
before. Rounds are at most 2 * size / SYMBOL. Strings whose common prefix with
a neighbour has ``size`` bytes are repeated. Equal segments are one document of
the collection with a weight; all strings of a weight over one are repeated, and
where an anchor has no other segment there is nothing to order.
A bucket is some MB, so its columns are arrays in a task's memory, not files.

An anchor with more than ``HOT`` places would fill a bucket with segments that
share it but differ around it. Its strings are grouped one by one instead, by
128 bits of hash; a chunk of documents sends a string once, known as repeated
if the chunk has it twice.

Replies are dealt by a hash of doc_id and text together, so the copies of one
text are spread like other documents.

Defined cases: null text is empty; shorter texts than ``size`` stay whole;
overlapping repeats within a document count; repeated rows are places of their
own (so both lose what they share); a null doc_id is as good as any; an empty
table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import keyed_texts, materialize, mix64, narrow, per_batch, widen, with_groups

GRAM = 40
SYMBOL = 100
HOT = 2_000
BLOCK = 1 << 20          # strings whose hashes are held at once
BUCKET = 2 << 20         # bytes of segments in a bucket, on average
STRINGS = 500_000        # strings of hot anchors in a group, on average

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, _BACK)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def prefix_hash(data: np.ndarray, salt: int = 0) -> np.ndarray:
    """Sums of mixed byte values times powers, from which any substring's hash follows."""
    value = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * salt))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * _powers(len(data) + 1)[0][:len(data)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    return mix64((prefix[start + length] - prefix[start]) * _powers(len(prefix))[1][start])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values: block prefixes against block suffixes."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def anchors(data: np.ndarray, limit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings data[s:s + size] with s + size <= limit[s]: the anchor's hash,
    the first string and the number of strings of each run that shares an anchor."""
    out = []
    for a in range(0, max(0, len(data) - size + 1), BLOCK):
        part = data[a:a + BLOCK + size - 1]
        prefix = prefix_hash(part)
        h = substring_hash(prefix, np.arange(len(part) - GRAM + 1), GRAM)
        low = np.uint64((1 << 21) - 1)
        least = _window_min(h & ~low | np.arange(len(h), dtype=np.uint64), size - GRAM + 1)
        at = (least & low).astype(np.int64)
        s = np.flatnonzero(np.arange(a, a + len(at)) + size <= limit[a:a + len(at)])
        if not len(s):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(s) > 1) | (np.diff(at[s]) != 0)]))
        out.append((h[at[s[new]]], s[new] + a, np.diff(np.append(new, len(s)))))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _joined(bodies: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, where each begins (one more at the end), and the
    end of its text at every byte."""
    begin = np.cumsum([0] + [len(b or b"") for b in bodies])
    return np.frombuffer(b"".join(b or b"" for b in bodies), np.uint8), begin, np.repeat(begin[1:], np.diff(begin))


def _sparse_min(x: np.ndarray) -> list[np.ndarray]:
    levels = [x]
    while 2 << (len(levels) - 1) <= len(x):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    return levels


def _range_min(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum over a..b (inclusive, a <= b) of each pair."""
    k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.zeros(len(a), levels[0].dtype)
    for level in np.unique(k):
        m = k == level
        out[m] = np.minimum(levels[level][a[m]], levels[level][b[m] - (1 << int(level)) + 1])
    return out


def suffix_order(symbols: np.ndarray, begin: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of a collection, built by inserting one symbol a document and
    round. Document d has symbols[begin[d]], symbols[begin[d] + step], ... as long as
    these are below begin-of-its-text's end (``begin`` rows: first, end). Returns the
    place of each suffix's first symbol in sorted order, and the common prefix (in
    symbols) of each with the one before it."""
    first, end = begin
    length = (end - first + step - 1) // step
    docs = np.flatnonzero(length > 0)
    first, length = first[docs], length[docs]
    m = len(docs)
    place = np.arange(m) - m                 # rank of each document's last suffix; empty ones come first
    s, rest, lcp, where = (np.zeros(0, np.int64) for _ in range(4))
    lcp = lcp.astype(np.uint8)
    for t in range(1, int(length.max(initial=0)) + 1):
        live = np.flatnonzero(length >= t)
        at = first[live] + (length[live] - t) * step
        c, r = symbols[at], place[live]
        big = np.int64(len(s) + m + 1)
        order = np.argsort(c * big + (r + m), kind="stable")
        live, at, c, r = live[order], at[order], c[order], r[order]
        ins = np.searchsorted(s * big + (rest + m), c * big + (r + m))
        moved = np.arange(len(s)) + np.cumsum(np.bincount(ins, minlength=len(s) + 1))[:len(s)]
        new = ins + np.arange(len(ins))
        total = len(s) + len(ins)
        old = np.ones(total, bool)
        old[new] = False

        def merged(a, b):
            out = np.empty(total, a.dtype)
            out[old], out[new] = a, b
            return out

        s2, before = merged(s, c), merged(rest, r)    # ``before``: ranks of the rests as they were
        lcp2 = merged(lcp, np.zeros(len(ins), np.uint8))
        touched = np.unique(np.concatenate([new, new + 1]))
        touched = touched[(touched > 0) & (touched < total)]
        same = s2[touched] == s2[touched - 1]
        lcp2[touched] = same
        deep = touched[same & (before[touched - 1] >= 0)]
        if len(deep) and len(lcp):
            lcp2[deep] = 1 + _range_min(_sparse_min(lcp), before[deep - 1] + 1, before[deep])
        shift = lambda x: np.where(x < 0, x, moved[x]) if len(moved) else x
        place = shift(place)
        place[live] = new
        s, rest, lcp, where = s2, shift(before), lcp2, merged(where, at)
    return where, lcp


def repeated_strings(segments: list[bytes], weighty: list[bool], size: int) -> list[np.ndarray]:
    """Of each segment (all different), which of its strings of ``size`` bytes (by
    start) also start elsewhere; ``weighty`` segments stand at two places or more."""
    data, begin, _ = _joined(segments)
    symbol = substring_hash(prefix_hash(data), np.arange(max(0, len(data) - SYMBOL + 1)), SYMBOL)
    symbol = np.unique(symbol, return_inverse=True)[1].astype(np.int64)
    first = (begin[:-1, None] + np.arange(SYMBOL)).ravel()
    end = np.maximum(first, np.repeat(begin[1:] - SYMBOL + 1, SYMBOL))
    where, lcp = suffix_order(symbol, np.stack([first, end]), SYMBOL)
    hit = lcp >= size // SYMBOL
    again = np.repeat(np.array(weighty, bool), np.diff(begin))
    again[where[hit]] = True
    again[where[:-1][hit[1:]]] = True
    return [again[a:b - size + 1] for a, b in zip(begin[:-1], begin[1:])]


def _runs(mask: np.ndarray, at: int, size: int) -> list[tuple[int, int]]:
    """The byte intervals that the marked strings cover, shifted by ``at``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [(at + int(a), at + int(b) - 1 + size) for a, b in edge.reshape(-1, 2)]


def merge_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte intervals of each owner (a number) in order, touching ones as one."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    wide = np.int64(end.max(initial=0) + 1)
    reach = np.maximum.accumulate(owner * wide + end)  # owners ascend, so their reaches do
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (owner[1:] * wide + start[1:] > reach[:-1])])[:len(owner)])
    last = np.append(first[1:], len(owner))[:len(first)] - 1
    return owner[first], start[first], reach[last] - owner[first] * wide


def _owners(ids: pa.Array, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of (doc_id, text_key) pairs, and of each number: doc_id, whether null, text_key."""
    columns = ids.fill_null(0), ids.is_null().cast(pa.int8()), keys
    used, owner = np.unique(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1), axis=0, return_inverse=True)
    return owner.reshape(-1), used[:, 0].copy(), used[:, 1].astype(bool), used[:, 2].copy()


def replies(ids: pa.Array, keys: pa.Array, of: np.ndarray, start: np.ndarray, end: np.ndarray, groups: int) -> pa.Table:
    """Intervals of documents (``of``: places in ``ids`` and ``keys``), merged and
    dealt by document to ``groups``: a document once a row, its intervals packed."""
    owner, doc_id, null, text_key = _owners(ids, keys)
    owner, start, end = merge_spans(owner[of], start, end)
    bucket = (mix64(doc_id.view(np.uint64) ^ mix64(text_key.view(np.uint64))) % np.uint64(groups)).astype(np.int64)[owner]
    order = np.lexsort((owner, bucket))
    owner, start, end, bucket = owner[order], start[order], end[order], bucket[order]
    used, cuts = np.unique(bucket, return_index=True)
    out: dict = {name: [] for name in ("bucket", "doc_ids", "text_keys", "counts", "starts", "lengths")}
    for k, a, b in zip(used.tolist(), cuts, np.append(cuts[1:], len(owner))):
        docs, n = np.unique(owner[a:b], return_counts=True)
        for name, v in zip(out, (k, pa.array(doc_id[docs], mask=null[docs]).to_pylist(), text_key[docs], narrow(n), narrow(start[a:b]), narrow((end - start)[a:b]))):
            out[name].append(v)
    lists = pa.list_(pa.int64())
    return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(out.items(), (pa.int32(), lists, lists, *[pa.binary()] * 3))})


def repeated_spans(docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, text_key, spans (array of byte intervals, merged), of documents with any."""
    if size % SYMBOL or size <= GRAM:
        raise ValueError(f"size must be a multiple of {SYMBOL}")
    texts = keyed_texts(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("anchor", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])

    def find(cols: dict) -> dict | None:
        data, begin, limit = _joined(cols["body"])
        g, at, n = anchors(data, limit, size)
        if not len(g):
            return None
        doc = np.searchsorted(begin, at, "right") - 1
        return {"doc_id": [cols["doc_id"][d] for d in doc], "text_key": [cols["text_key"][d] for d in doc],
                "anchor": g.view(np.int64), "at": at - begin[doc], "n": n}

    ddl = "doc_id long, text_key long, anchor long, at long, n long"
    found = materialize(texts.mapInArrow(per_batch(find, schema), ddl), "anchors")
    often = materialize(found.groupBy("anchor").agg(F.count("*").alias("places"), F.sum("n").alias("strings")).filter("places > 1"), "often")
    total = often.agg(F.sum("places").alias("places"), F.sum(F.col("strings") + size * F.col("places")).alias("bytes"),
                      F.sum(F.when(F.col("places") > HOT, F.col("strings"))).alias("hot")).first()
    placed = with_groups(found, often.select("anchor", "places"), "anchor", "places", total.places or 0).filter("places IS NOT NULL")
    wanted = placed.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(
        F.collect_set(F.struct("at", "n", "anchor", (F.col("places") > HOT).alias("hot"))).alias("found"))
    asked = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.of_id) & (texts.text_key == wanted.of_key)).select("doc_id", "text_key", "body", "found")
    buckets, hot_parts = max(1, -(-(total.bytes or 0) // BUCKET)), max(1, -(-(total.hot or 0) // STRINGS))
    groups = max(1, buckets // 4 + hot_parts - 1)  # a hot string may be an interval of its own
    out = pa.schema([("part", pa.int32()), ("anchor", pa.int64()), ("segment", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())),
                     ("ats", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("doc", "start", "a", "b", "known"))])

    def send(cols: dict) -> dict | None:
        """Segments of repeated anchors, equal ones once (part from 0); of the strings
        of hot anchors the hashes and places (part below 0)."""
        rows: dict = {}
        result = {x.name: [] for x in out}
        hot = []
        for i, (doc, key, body, found) in enumerate(zip(*(cols[k] for k in ("doc_id", "text_key", "body", "found")))):
            starts = [np.arange(x["at"], x["at"] + x["n"]) for x in found if x["hot"]]
            if starts:
                data, starts = np.frombuffer(body, np.uint8), np.concatenate(starts)
                hot.append((np.full(len(starts), i), starts, *(substring_hash(prefix_hash(data, salt), starts, size) for salt in (1, 2))))
            for x in found:
                if not x["hot"]:
                    rows.setdefault((x["anchor"], body[x["at"]:x["at"] + x["n"] + size - 1]), []).append((doc, key, x["at"]))
        for (anchor, segment), places in rows.items():
            for name, v in zip(result, (anchor % (1 << 64) % buckets, anchor, segment, *zip(*places), *[None] * 5)):
                result[name].append(v)
        if hot:
            doc, start, a, b = (np.concatenate(x) for x in zip(*hot))
            order = np.lexsort((b, a))
            doc, start, a, b = doc[order], start[order], a[order], b[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            many = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1] > 1
            part = (a >> np.uint64(32)).astype(np.int64) * hot_parts >> 32  # a is sorted, so parts are
            cuts = np.searchsorted(part, np.arange(hot_parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                r = slice(cuts[p], cuts[p + 1])
                used, local = np.unique(doc[r], return_inverse=True)
                for name, v in zip(result, (-1 - p, None, None, [cols["doc_id"][d] for d in used], [cols["text_key"][d] for d in used], None, narrow(local),
                                            narrow(start[r]), a[r][new[r]].tobytes(), b[r][new[r]].tobytes(), (2 * many[r] + new[r]).astype(np.uint8).tobytes())):
                    result[name].append(v)
        return result if result["part"] else None

    sent = asked.mapInArrow(per_batch(send, out), "part int, anchor long, segment binary, doc_ids array<long>, text_keys array<long>, ats array<long>, "
                                                  "doc binary, start binary, a binary, b binary, known binary")
    sent = materialize(sent, "segments")
    hit_ddl = "bucket int, doc_ids array<long>, text_keys array<long>, counts binary, starts binary, lengths binary"

    def decide(key, table):
        places: dict = {}
        anchor_of = {}
        for anchor, segment, *where in zip(*(table.column(c).to_pylist() for c in ("anchor", "segment", "doc_ids", "text_keys", "ats"))):
            places.setdefault(segment, []).extend(zip(*where))
            anchor_of[segment] = anchor
        sharing = Counter(anchor_of.values())
        several = [x for x, anchor in anchor_of.items() if sharing[anchor] > 1]
        ordered = dict(zip(several, repeated_strings(several, [len(places[x]) > 1 for x in several], size)))
        marks = [ordered[x] if x in ordered else np.full(len(x) - size + 1, len(p) > 1) for x, p in places.items()]
        ids, keys, found = [], [], []
        for mark, where in zip(marks, places.values()):
            spans = np.array(_runs(mark, 0, size), np.int64).reshape(-1, 2)
            for doc, text_key, at in where if len(spans) else ():
                ids.append(doc)
                keys.append(text_key)
                found.append(spans + at)
        of = np.repeat(np.arange(len(found)), [len(x) for x in found])
        found = np.concatenate([np.zeros((0, 2), np.int64), *found])
        return replies(pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), of, found[:, 0], found[:, 1], groups)

    hits = sent.filter("part >= 0").select("part", "anchor", "segment", "doc_ids", "text_keys", "ats").groupBy("part").applyInArrow(decide, hit_ddl)

    def decide_hot(key, table):
        got = table.to_pydict()
        docs_of = [widen(x) for x in got["doc"]]
        base = np.cumsum([0] + [len(x) for x in got["doc_ids"]])
        doc = np.concatenate([x + k for x, k in zip(docs_of, base)])
        start = np.concatenate([widen(x) for x in got["start"]])
        flags = np.frombuffer(b"".join(got["known"]), np.uint8)
        a, b = (np.frombuffer(b"".join(got[k]), np.uint64) for k in ("a", "b"))
        order = np.lexsort((b, a))
        same = (np.diff(a[order]) == 0) & (np.diff(b[order]) == 0)
        again = np.zeros(len(a), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        goes = flags >= 2
        goes[np.flatnonzero(flags & 1)] |= again
        ids, keys = (pa.array([x for row in got[k] for x in row], pa.int64()) for k in ("doc_ids", "text_keys"))
        order = np.lexsort((start[goes], doc[goes]))
        doc, start = doc[goes][order], start[goes][order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(start) > 1)])) if len(doc) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(doc))[:len(first)] - 1
        return replies(ids, keys, doc[first], start[first], start[last] + size, groups)

    hot_hits = sent.filter("part < 0").select("part", "doc_ids", "text_keys", "doc", "start", "a", "b", "known").groupBy("part").applyInArrow(decide_hot, hit_ddl)

    def by_document(key, table):
        ids, keys = (pa.concat_arrays(table.column(c).chunks).flatten() for c in ("doc_ids", "text_keys"))
        n, start, length = (np.concatenate([widen(x) for x in table.column(c).to_pylist()]) for c in ("counts", "starts", "lengths"))
        owner, doc_id, null, text_key = _owners(ids, keys)
        owner, start, end = merge_spans(np.repeat(owner, n), start, start + length)
        cuts = pa.array(np.searchsorted(owner, np.arange(len(doc_id) + 1)).astype(np.int32))
        return pa.table({"doc_id": pa.array(doc_id, mask=null), "text_key": pa.array(text_key),
                         "starts": pa.ListArray.from_arrays(cuts, pa.array(start)), "ends": pa.ListArray.from_arrays(cuts, pa.array(end))})

    return hits.unionByName(hot_hits).groupBy("bucket").applyInArrow(by_document, "doc_id long, text_key long, starts array<long>, ends array<long>")


def suffix_dedup(docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), one row per input row."""
    texts = keyed_texts(docs)
    spans = repeated_spans(docs, size).withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
    both = texts.join(spans, texts.doc_id.eqNullSafe(spans.of_id) & (texts.text_key == spans.of_key), "left").select("doc_id", "body", "starts", "ends")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(cols: dict) -> dict:
        out = {x.name: [] for x in schema}
        for doc, body, starts, ends in zip(*(cols[k] for k in ("doc_id", "body", "starts", "ends"))):
            body = body or b""
            edges = [0, *(x for pair in zip(starts or (), ends or ()) for x in pair), len(body)]
            kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
            for name, v in zip(out, (doc, len(body), len(body) - len(kept), len(starts or ()), kept)):
                out[name].append(v)
        return out

    return both.mapInArrow(per_batch(cut, schema), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
