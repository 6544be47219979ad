"""Plain-Python versions of the corpus operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def sha(b):
    return hashlib.sha256(b).hexdigest()


def substring(rows, size=13):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            first[k] = min(first.get(k, d), d)
    out = set()
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < d:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.add((d, len(w), len(gone), sha(kept)))
    return out


def simhash(rows, k=3, bits=2):
    fp = {}
    for d, t in rows:
        w = words((t or "").encode().lower().decode())
        sh = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fp[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {d: d for d in fp}
    ids = sorted(fp)

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= bits:
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {(d, f"{fp[d]:016x}", root(d)) for d in ids}


def quality(rows):
    out = set()
    for d, t in rows:
        t = t or ""
        w = [x.decode() for x in words(t)]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = set()
        for i, g in enumerate(zip(w, w[1:], w[2:])):
            if grams[g] > 1:
                hit.update((i, i + 1, i + 2))
        seen, dup = set(), 0
        for x in t.split("\n"):
            if words(x):
                dup += x in seen
                seen.add(x)
        out.add((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return out


def lines(rows, size=13):
    """Every stretch of consecutive worded lines with ``size`` words or more is looked up."""
    place = set()
    cut = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        ls = (t or "").split("\n")
        idx = [i for i, x in enumerate(ls) if words(x)]
        count = [len(words(ls[i])) for i in idx]
        gone = set()
        for a in range(len(idx)):
            for b in range(a, min(len(idx), a + 2 * size)):
                if sum(count[a:b + 1]) >= size:
                    key = tuple(ls[i] for i in idx[a:b + 1])
                    if key in place:
                        gone.update(idx[a:b + 1])
                    else:
                        place.add(key)
        cut[d] = (len(ls) if t is not None else 0, len(gone), None if t is None else sha("\n".join(x for i, x in enumerate(ls) if i not in gone).encode()))
    return {(d, *v) for d, v in cut.items()}


def byte_windows(rows, size=400):
    seen = Counter()
    data = {d: (t or "").encode() for d, t in rows}
    for b in data.values():
        for i in range(len(b) - size + 1):
            seen[hashlib.blake2b(b[i:i + size], digest_size=16).digest()] += 1
    out = set()
    for d, b in data.items():
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - size + 1):
            if seen[hashlib.blake2b(b[i:i + size], digest_size=16).digest()] > 1:
                gone[max(i, end):i + size] = b"\x01" * (i + size - max(i, end))
                end = i + size
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.add((d, len(b), sum(gone), runs, sha(kept)))
    return out


def pieces(rows, tokenizer, size=2048):
    out = {}
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), size):
            part = ids[k:k + size]
            out[d, k // size] = (k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    return out


def contaminated(docs, items, threshold=0.5, overlap=0.8):
    """Every item held against every window of every document: (doc_id, item_id) -> score, overlaps, start."""
    import math
    from stockflow.llm.decontam import K1, LENGTH_WEIGHT, held, question_and_answer, shingles, words_of
    parts = {(i, t): question_and_answer(t) for i, t in set(items) if i is not None and t is not None}
    parts = {k: v for k, v in parts.items() if v[0] or v[1]}
    bags = {k: Counter(q + a) for k, (q, a) in parts.items()}
    df = Counter(w for b in bags.values() for w in b)
    n, size = len(bags), {k: sum(b.values()) for k, b in bags.items()}
    mean, half = sum(size.values()) / max(1, n), max([32, *size.values()])
    weight = {k: {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * size[k] / mean))
                  for w, c in b.items()} for k, b in bags.items()}
    best = {}
    for d, t in docs:
        w = words_of(t) if d is not None and t else []
        for a in range(0, len(w), half):
            passage = w[a:a + 2 * half]
            there = set(passage)
            for k, ws in weight.items():
                score = sum(v for x, v in ws.items() if x in there) / sum(ws.values())
                q, r = (held(shingles(p), passage) for p in parts[k])
                if score >= threshold - 1e-9 and q >= overlap and r >= overlap:
                    best[d, k[0]] = max(best.get((d, k[0]), ()), (round(score, 9), q, r, -a))
    return {(*k, v[0], v[1], v[2], -v[3]) for k, v in best.items()}
