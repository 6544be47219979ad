"""Exact dedup against grouping the texts in a dictionary."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from stockflow.llm import common, exact_dedup

SCHEMA = "doc_id long, text string, row long, kept string, n int"


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        ids = sorted(ids, key=lambda d: (d is None, -(d or 0)))
        out += [(d, hashlib.sha256(t.encode()).hexdigest(), keep, len(ids), i == 0) for i, d in enumerate(ids)]
    return sorted(out, key=str)


def make_rows():
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(1, 9)))) for i in range(400)]
    rows += [(i, "x" * 70 + str(i % 7)) for i in range(1000, 1060)]       # one length and prefix, some equal
    rows += [(2000 + i, "y" * 80 + chr(97 + i)) for i in range(9)]         # one length and prefix, all different
    rows += [(3000 + i, "hot") for i in range(300)]
    rows += [(1, "p"), (1, "p"), (1, "q"), (None, "q"), (None, "only"), (None, "only"), (4000, ""), (4001, None), (None, None),
             (4002, "long " * 200_000), (4003, "long " * 200_000), (4004, " "), (4005, "  "), (-5, "neg"), (-9, "neg")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 7, "clash", 1) for d, t in rows], SCHEMA).repartition(3)


def test_groups_equal_brute_force(spark, monkeypatch):
    rows = make_rows()
    df = exact_dedup.exact_groups(frame(spark, rows), all_digests=True)
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)
    monkeypatch.setattr(common, "HOT_SHARE", 10 ** 9)                  # every group by broadcast
    assert sorted((tuple(r) for r in exact_dedup.exact_groups(frame(spark, rows), all_digests=True).collect()), key=str) == brute(rows)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = make_rows()
    monkeypatch.setattr(exact_dedup.key_filter, "__defaults__", (1,))
    monkeypatch.setattr(exact_dedup.flagged, "__defaults__", (1,))
    df = exact_dedup.exact_groups(frame(spark, rows), all_digests=True)
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)


def test_single_texts_are_not_read_whole(spark):
    rows = [(1, "abc"), (2, "abd"), (3, "abc"), (4, "z" * 90 + "1"), (5, "z" * 90 + "2"), (6, "zz")]
    out = {r.doc_id: r.text_digest for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    assert {d for d, h in out.items() if h is None} == {2, 6}               # 4 and 5 share length and prefix


def test_dedup_keeps_all_columns_and_one_of_each(spark):
    rows = make_rows()
    df = exact_dedup.exact_dedup(frame(spark, rows))
    assert df.columns == ["doc_id", "text", "row", "kept", "n"]
    got = sorted([(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect()], key=str)
    assert got == sorted([(d, h) for d, h, _, _, kept in brute(rows) if kept], key=str)


def test_normalised_texts_and_an_empty_table(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "c")]
    out = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(frame(spark, rows), F.lower).collect()}
    assert out == {1: (2, 2), 2: (2, 2), 3: (3, 1)}
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(frame(spark, rows), F.lower).collect()) == [2, 3]
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0
