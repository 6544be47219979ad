"""Hard negatives against sorting all rows for every anchor."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from stockflow.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, part int, kind string"


def brute(rows, every=10, pos=5, neg=5, low=80, high=100):
    e = {}
    for i, l, v in rows:
        if i is None or l is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if any(abs(256 * x) >= math.sqrt(2.0 ** 62 / len(v)) for x in v):
            continue
        e[i] = min(e.get(i, (l, q)), (l, q))
    out = set()
    for a, (la, qa) in e.items():
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(qa, q)), i, l) for i, (l, q) in e.items() if i != a)
        for ps, p, l in [x for x in s if x[2] == la][:pos]:
            hits = [(n, x) for x, n, l in s if l != la and low * -ps <= 100 * -x <= high * -ps][:neg]
            out |= {(a, p, k, n, -ps, -x) for k, (n, x) in enumerate(hits, 1)}
    return out


def make_rows():
    rng = random.Random(9)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(4)]
    vec = lambda: [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]
    rows = [(i, rng.randrange(4), vec()) for i in range(400)]
    same = vec()
    rows += [(1000 + i, i % 3, same) for i in range(120)]                                   # ties
    rows += [(2000, 1, None), (2010, None, vec()), (None, 1, vec()), (2020, 2, [None, 1.0]), (2030, 2, [float("nan")] * 12),
             (2040, 2, [float("inf")] * 12), (2050, 3, [1e30] * 12), (2060, 3, []), (2070, 1, [0.4, 0.4]), (2080, 2, [0.0] * 12),
             (2090, 7, vec()), (2100, 1, vec()), (2100, 0, vec()), (2100, 0, [0.1] * 12), (-10, 2, vec()), (-11, 2, vec())]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA).repartition(3)


def result(df):
    return [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def test_equals_brute_force(spark):
    rows = make_rows()
    got = result(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0))
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 500


def test_many_blocks_and_parts_change_nothing(spark, monkeypatch):
    rows = make_rows()
    monkeypatch.setattr(hn, "PARTS", 3)
    monkeypatch.setattr(hn, "HELD", 8)
    monkeypatch.setattr(hn, "ROWS", 32)   # packed in the workers, which see the module's own value
    got = result(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, positives=3, negatives=2, low=50, high=90))
    assert set(got) == brute(rows, pos=3, neg=2, low=50, high=90) and len(got) == len(set(got))


def test_empty_table(spark):
    df = hn.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0)
    assert df.count() == 0 and df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_the_bitmap_shrinks_before_all_columns_are_read():
    rng = np.random.default_rng(1)
    columns = rng.integers(-80, 80, (64, 3000)).astype(np.int32)
    columns[:4] *= 20                                                       # a few dimensions decide
    block = hn.Block(np.arange(3000), np.zeros(3000, np.int64), columns)
    q = columns[:, 0].astype(np.int64)
    left = []

    def keep(lower, upper):
        left.append(len(lower))
        return upper >= hn._kth(lower, 5)

    found, score = hn.vertical_scan(q, block, np.arange(3000), keep)
    exact = q @ columns.astype(np.int64)
    assert (score == exact[found]).all() and set(np.lexsort((np.arange(3000), -exact))[:5]) <= set(found)
    assert left[0] == 3000 and left[1] < 1500 and left[-1] < 100


def test_large_components_stay_exact():
    big = 1 << 27
    columns = np.array([[big, big - 1, -big], [big, big, big - 3]], np.int32)
    block = hn.Block(np.arange(3), np.zeros(3, np.int64), columns)
    q = np.array([big - 1, big], np.int64)
    _, score = hn.vertical_scan(q, block, np.arange(3), lambda lower, upper: np.ones(len(lower), bool))
    assert score.tolist() == [int(q[0]) * int(a) + int(q[1]) * int(b) for a, b in columns.T]
