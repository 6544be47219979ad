"""Fill-in-the-middle against slicing Python strings, and its chunks against plain counting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockflow.llm import fill_middle as fim

SCHEMA = "doc_id long, text string, output string, n int, body string"
MARKS = tuple(m.encode() for m in fim.MARKERS)


def brute(d, t, rate=90, spm=20):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(t)
    if not t or any(m in t for m in fim.MARKERS) or h3 % 100 >= rate:
        return d, n, "plain", None, None, t, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = t[:a], t[a:b], t[b:]
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return d, n, "spm" if h4 % 100 < spm else "psm", a, b - a, out, t


def make_rows():
    rng = random.Random(4)
    text = lambda k: "".join(rng.choice(["a", "bc ", "é", "日本", "\n", "<", "P>", "😀", "x"]) for _ in range(k))
    shared = text(3000)
    rows = [(i, text(rng.randint(0, 60))) for i in range(150)]
    rows += [(200 + i, text(rng.randint(1, 900)) + shared + text(40)) for i in range(20)]
    rows += [(300 + i, "<" * i + "S" * 3 + "<M" + ">" * (i % 2)) for i in range(8)]
    rows += [(None, "abc"), (None, None), (400, None), (401, ""), (402, "é"), (403, "a" * 300_000), (404, "日" * 200_000 + "<S>"),
             (405, "日" * 200_000), (5, "twice"), (5, "twice"), (-7, "negative id " * 9), (9_000_000_000_000_000_000, "large id " * 9)]
    return rows


def test_outputs_equal_brute_force_and_restore(spark):
    rows = make_rows()
    docs = spark.createDataFrame([(d, t, "clash", 1, "clash") for d, t in rows], SCHEMA).repartition(4)
    df = fim.fill_in_middle(docs)
    got = df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string"), fim.restored(F.col("output"), F.col("form")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((brute(*r) for r in rows), key=str)
    assert {"plain", "psm", "spm"} == {r.form for r in df.select("form").collect()}
    empty = fim.fill_in_middle(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == df.columns


def test_parameters_and_markers(spark):
    docs = spark.createDataFrame([(i, f"text {i} with <S> inside") for i in range(60)], "doc_id long, text string")
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    df = fim.fill_in_middle(docs, seed=3, transformed=100, suffix_first=50, markers=marks)
    rows = df.select("form", "output", fim.restored(F.col("output"), F.col("form"), marks).alias("t"), "doc_id").collect()
    assert all(r.t == f"text {r.doc_id} with <S> inside" and r.form in ("psm", "spm") for r in rows) and len({r.form for r in rows}) == 2
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, markers=("", "a", "b"))


def test_markers_are_seen_wherever_the_chunks_end():
    rng = random.Random(6)
    base = bytes(rng.choice(b"abcdefgh <SPM>") for _ in range(3000)).replace(b"<S>", b"").replace(b"<P>", b"").replace(b"<M>", b"")
    memory = fim.Memory(MARKS)

    def chunks(body):
        return fim.summaries(body, fim.cut_places(np.frombuffer(body, np.uint8)).tolist(), memory)

    assert not fim.has_marker(chunks(base), MARKS) and len(chunks(base)) > 3
    for at in range(len(base)):
        assert fim.has_marker(chunks(base[:at] + b"<M>" + base[at:]), MARKS), at


def test_shared_passages_fall_into_the_same_chunks(monkeypatch):
    rng = random.Random(8)
    shared = bytes(rng.randrange(97, 123) for _ in range(20_000))
    cut = lambda b: [s.chunk for s in fim.summaries(b, fim.cut_places(np.frombuffer(b, np.uint8)).tolist(), fim.Memory(MARKS))]
    a, b = cut(b"one " * 40 + shared), cut(b"another text " * 90 + shared)
    assert len(set(a) & set(b)) > 0.8 * len(a) and b"".join(a) == b"one " * 40 + shared
    assert all(fim.LEAST <= len(c) <= fim.MOST for c in a[:-1])
    whole = fim.cut_places(np.frombuffer(shared, np.uint8))
    monkeypatch.setattr(fim, "BLOCK", 777)                                  # blocks don't move the places
    assert (fim.cut_places(np.frombuffer(shared, np.uint8)) == whole).all()


def test_memory_is_bounded_and_verified_by_content(monkeypatch):
    memory = fim.Memory(MARKS, most=1000)
    for k in range(200):
        memory.of(bytes([97 + k % 26]) * (50 + k))
        assert memory.held <= 1000 + 250
    monkeypatch.setattr(fim.xxhash, "xxh3_64_intdigest", lambda b: 1)        # every hash collides
    assert [memory.of(c).points for c in (b"abc", "é".encode(), b"abc", b"x")] == [3, 1, 3, 1]
