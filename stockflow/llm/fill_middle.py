"""Fill-in-the-middle transformation over content-defined chunks.

A rolling hash over the bytes cuts every text into chunks, at places that depend
on the ``WINDOW`` bytes before them alone, so a passage that many texts share falls
into the same chunks in each. What is known of a chunk (its boundary summary)
is worked out once and remembered by the chunk's hash; a remembered chunk counts
only if its content is equal byte by byte. A summary holds the number of code
points that begin in the chunk, where they begin (nothing for plain ASCII),
whether a marker stands inside, and the bytes at its two ends, from which
markers across two chunks are seen.

The counts of a text's chunks add up to its code points n; the running sum
tells in which chunk a cut falls, and the summary where in it. Cuts follow from
a hash of seed and doc_id, so results don't depend on rows, chunks or tasks.

The memory of summaries belongs to a task, holds ``REMEMBERED`` bytes of chunks at
most and is emptied beyond; it changes the time, never the result. Hashes of at
most ``BLOCK`` bytes are held at once, so a very long text costs its own bytes.

Defined cases: null text is empty, and empty texts are plain; texts with a
marker are plain; a null doc_id is hashed as an empty number; rows that repeat
a doc_id get cuts by the same hash; code points are counted by their first
bytes; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import keyed_texts, mix64, per_batch

MARKERS = ("<P>", "<S>", "<M>")   # prefix, suffix, middle
WINDOW = 32                       # bytes that a cut depends on
LEAST, MEAN, MOST = 64, 512, 4096  # bytes of a chunk
BLOCK = 1 << 20
REMEMBERED = 32 << 20

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Ends of the byte windows at which the rolling hash asks for a cut: the hash of the
    last ``WINDOW`` bytes, the newest weighing least, built by doubling."""
    out = []
    for a in range(0, len(data), BLOCK):
        begin = max(0, a - WINDOW + 1)
        h = _GEAR[data[begin:a + BLOCK]]
        width = 1
        while width < WINDOW:
            older = h[:-width] << np.uint32(width)
            h = h.copy()
            h[width:] += older
            width *= 2
        out.append(np.flatnonzero(h[a - begin:] >> np.uint32(32 - (MEAN.bit_length() - 1)) == 0) + a + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunk_ends(places: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end], given the ascending places within it."""
    out, last = [], start
    for p in [*places, end]:
        while p - last > MOST:
            last += MOST
            out.append(last)
        if p - last >= LEAST and p < end:
            last = p
            out.append(p)
    if last < end:
        out.append(end)
    return out


class Summary:
    """What is known of a chunk: its bytes, the number of code points that begin in
    it, their offsets (None: every byte begins one), and whether a marker is inside."""
    __slots__ = ("chunk", "points", "begins", "marked")

    def __init__(self, chunk: bytes, markers: tuple[bytes, ...]):
        self.chunk = chunk
        self.begins = None if chunk.isascii() else np.flatnonzero(np.frombuffer(chunk, np.uint8) & 0xC0 != 0x80).astype(np.uint16)
        self.points = len(chunk) if self.begins is None else len(self.begins)
        self.marked = any(m in chunk for m in markers)

    def offset(self, point: int) -> int:
        return point if self.begins is None else int(self.begins[point])


class Memory(dict):
    """Chunk hash -> summary, verified by content; emptied beyond its bytes."""

    def __init__(self, markers: tuple[bytes, ...], most: int = REMEMBERED):
        self.markers, self.most, self.held = markers, most, 0

    def of(self, chunk: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(chunk)
        known = self.get(key)
        if known is not None and known.chunk == chunk:
            return known
        if self.held > self.most:
            self.clear()
            self.held = 0
        self.held += len(chunk)
        self[key] = made = Summary(chunk, self.markers)
        return made


def summaries(body: bytes, places: list[int], memory: Memory, start: int = 0) -> list[Summary]:
    """The summaries of a text's chunks; ``places`` and ``start`` count from elsewhere."""
    out, last = [], 0
    for e in chunk_ends(places, start, start + len(body)):
        out.append(memory.of(body[last:e - start]))
        last = e - start
    return out


def has_marker(chunks: list[Summary], markers: tuple[bytes, ...]) -> bool:
    """Whether a marker stands in the text, inside a chunk or across two (a chunk but
    the last is longer than any marker)."""
    if any(c.marked for c in chunks):
        return True
    reach = max(map(len, markers)) - 1
    return any(m in a.chunk[-reach:] + b.chunk[:reach] for a, b in zip(chunks, chunks[1:]) for m in markers)


def byte_offsets(chunks: list[Summary], points: list[int]) -> list[int]:
    """Byte offsets of ascending code points (n stands for the end of the text)."""
    counts = list(accumulate((c.points for c in chunks), initial=0))
    sizes = list(accumulate((len(c.chunk) for c in chunks), initial=0))
    out, k = [], 0
    for p in points:
        while k < len(chunks) and counts[k + 1] <= p:
            k += 1
        out.append(sizes[k] + chunks[k].offset(p - counts[k]) if k < len(chunks) else sizes[-1])
    return out


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12)]


def fill_in_middle(docs: DataFrame, seed: int = 1, transformed: int = 90, suffix_first: int = 20,
                   markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if
    plain), output (bytes), one row per input row. Of 100 texts ``transformed`` aren't
    plain, of 100 of these ``suffix_first`` begin with the suffix."""
    pre, suf, mid = marks = tuple(m.encode() for m in markers)
    if not all(marks) or max(map(len, marks)) > LEAST:
        raise ValueError(f"markers need 1 to {LEAST} bytes")
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output", pa.binary())])
    memory = Memory(marks)

    def transform(cols: dict) -> dict:
        bodies = [b or b"" for b in cols["body"]]
        begin = np.cumsum([0] + [len(b) for b in bodies])
        places = cut_places(np.frombuffer(b"".join(bodies), np.uint8))
        of = np.searchsorted(places, begin, "right")  # a place at a text's first byte would belong to the text before
        out: dict = {x.name: [] for x in schema}
        for k, (doc, body) in enumerate(zip(cols["doc_id"], bodies)):
            chunks = summaries(body, places[of[k]:of[k + 1]].tolist(), memory, int(begin[k]))
            n = sum(c.points for c in chunks)
            h1, h2, h3, h4 = draws(seed, doc)
            row = (doc, n, "plain", None, None, body)
            if n and h3 % 100 < transformed and not has_marker(chunks, marks):
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                i, j = byte_offsets(chunks, [a, b])
                first, middle, last = body[:i], body[i:j], body[j:]
                spm = h4 % 100 < suffix_first
                row = (doc, n, "spm" if spm else "psm", a, b - a,
                       b"".join((suf, last, pre, first, mid, middle) if spm else (pre, first, suf, last, mid, middle)))
            for name, v in zip(out, row):
                out[name].append(v)
        return out

    return keyed_texts(docs).select("doc_id", "body").mapInArrow(
        per_batch(transform, schema), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text again, from an output and its form alone: no part holds a marker, so
    each marker's first place after the one before it is its own."""
    pre, suf, mid = markers
    text = output.cast("string")

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(text, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, mid, 1)
        return a, b, F.substr(rest, F.length(b) + len(mid) + 1)

    prefix, suffix, middle = parts(pre, suf)
    suffix_, prefix_, middle_ = parts(suf, pre)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(text)
