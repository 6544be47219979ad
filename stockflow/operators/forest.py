"""A random forest for regression, grown level by level by Spark jobs.

The forest is MLlib's: bootstrap counts drawn from Poisson(1), ordered features cut at
most ``max_bins - 1`` quantiles of a sample of max(max_bins^2, 10,000) rows, every
feature tried at every node, least variance, one node per path and level up to
``max_depth``. The fitted model is an MLlib ``RandomForestRegressionModel``, so scoring,
saving and loading are MLlib's. Only the counting differs. MLlib touches the
statistics of all trees row by row; here a task takes a few million rows as one byte a
value, and adds up one tree after the other, column by column, in arrays that fit the
processor's cache. Rows that a tree hasn't drawn cost nothing.

A level is two stages: tasks send, of each tree and ``PART`` nodes, the counts and sums of
all bins; these are added up by (tree, part), where the best split of a node is found. The
driver gets one row a node and holds the trees, as with MLlib, and no statistics.

Draws follow from the row's ``row_id`` and the tree's number alone, so the model depends on
neither cores nor files nor partitions. Without that column ids are given when the rows
are coded.

Defined cases: a null input value counts as NaN, which goes right of every threshold (and
may be told from the numbers by one); a null or NaN label is an error, and so is an empty
table; no more than 256 bins.
"""

from __future__ import annotations

import json
import math
import sys
import time
import uuid
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import Estimator
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.session import materialize, scratch_table_path

# The tasks' functions go with their jobs: executors needn't have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW_ID = "row_id"
TASK_ROWS = 1 << 20     # rows of a task at most, on average
LEAST_ROWS = 1 << 16    # and at least, if there are as many
CHUNK_ROWS = 1 << 21    # rows that a task adds up at once; each chunk sends its statistics
BLOCK_ROWS = 1 << 17    # rows whose codes stay in the processor's cache
NODES = 1024            # nodes of a tree that a task adds up at once, a multiple of PART
PART = 64               # nodes of a row of statistics, at most some 1.3 MB
PARTITIONS = 200        # of the statistics, at most
PARTITION_BYTES = 64 << 20
SAMPLE_ROWS = 10_000


# ---- bootstrap draws -----------------------------------------------------------------

def _poisson_steps() -> np.ndarray:
    """Where Poisson(1) counts change, as 64-bit unsigned numbers: a draw is the number of steps up to it."""
    steps, term, total = [], Decimal(1), Decimal(0)
    with localcontext() as c:
        c.prec = 60
        for k in range(1, 64):
            total += term
            term /= k
            step = int(total / Decimal(1).exp() * (1 << 64))
            if step >= (1 << 64) - 1:
                break
            steps.append(step)
    return np.array(steps, np.uint64)


STEPS = _poisson_steps()
# Counts by the first 16 bits; where a step lies inside, the whole number tells (255).
_CELLS = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
_LOW = np.searchsorted(STEPS, _CELLS, "right")
_HIGH = np.searchsorted(STEPS, _CELLS | np.uint64((1 << 48) - 1), "right")
COUNTS = np.where(_LOW == _HIGH, _LOW, 255).astype(np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def draws(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree takes each row: Poisson(1) by the rows' keys."""
    u = _mix(keys ^ _mix(np.array([(seed << 32) + tree + 1], np.int64).view(np.uint64)))
    n = COUNTS[u >> np.uint64(48)]
    at = np.flatnonzero(n == 255)
    n[at] = np.searchsorted(STEPS, u[at], "right")
    return n


# ---- bins ------------------------------------------------------------------------------

def thresholds(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Candidate splits of one feature: halfway between neighbours, at all of them if they are few,
    else where the running count passes a quantile the closest."""
    x, n = np.unique(values, return_counts=True)  # NaN is one value, the last
    if len(x) < 2:
        return np.empty(0)
    with np.errstate(invalid="ignore"):
        half = (x[:-1] + x[1:]) / 2
    half[np.isnan(half)] = x[:-1][np.isnan(half)]  # up to the greatest number, or NaN
    if len(half) < max_bins:
        return half
    stride = len(values) / max_bins
    out, target, run = [], stride, np.cumsum(n)
    for i in range(1, len(x)):
        if abs(run[i - 1] - target) < abs(run[i] - target):
            out.append(half[i - 1])
            target += stride
    return np.array(out)


def _binned(df: DataFrame, features: list[str], label: str, cuts: list[np.ndarray], seed: int) -> DataFrame:
    """bins (a byte a feature), y and key of every row."""
    schema = pa.schema([("bins", pa.binary()), ("y", pa.float64()), ("key", pa.int64())])
    width = len(features)

    def run(batches):
        for batch in batches:
            codes = np.empty((batch.num_rows, width), np.uint8)
            for i, c in enumerate(cuts):
                codes[:, i] = np.searchsorted(c, batch.column(i).to_numpy(zero_copy_only=False), "left")
            at = np.arange(0, (batch.num_rows + 1) * width, width, dtype=np.int32)
            bins = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([bins, batch.column(width), batch.column(width + 1)], schema=schema)

    return df.select(*features, label, F.xxhash64(ROW_ID, F.lit(seed)).alias("key")).mapInArrow(run, "bins binary, y double, key long")


def _chunks(batches, width: int) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Blocks of bins (one row a feature), labels and keys, up to some ``CHUNK_ROWS`` rows of them at a time."""
    def block(parts):
        bins, y, key = zip(*parts)
        return np.ascontiguousarray(np.concatenate(bins).T), np.concatenate(y), np.concatenate(key).view(np.uint64)

    blocks, held, n = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(0)
        first = int(np.frombuffer(col.buffers()[1], np.int32)[col.offset])
        codes = np.frombuffer(col.buffers()[2], np.uint8)[first:first + batch.num_rows * width].reshape(-1, width)
        held.append((codes.copy(), batch.column(1).to_numpy().copy(), batch.column(2).to_numpy().copy()))
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            blocks.append(block(held))
            held, n = [], 0
        if len(blocks) * BLOCK_ROWS >= CHUNK_ROWS:
            yield blocks
            blocks = []
    if held:
        blocks.append(block(held))
    if blocks:
        yield blocks


# ---- trees -------------------------------------------------------------------------------

class Trees:
    """The nodes of all trees, numbered level by level: the roots by tree, then the children by
    parent. So a tree's nodes of a level follow one another."""

    def __init__(self, trees: int):
        self.tree = np.arange(trees, dtype=np.int32)
        self.feature = np.full(trees, -1, np.int16)
        self.bin = np.zeros(trees, np.uint8)
        self.left = np.full(trees, -1, np.int32)    # the right child is the next
        self.stats = np.zeros((trees, 3))           # count, sum, sum of squares
        self.gain = np.full(trees, -1.0)
        self.impurity = np.full(trees, -1.0)

    def __len__(self) -> int:
        return len(self.tree)

    def only_roots(self) -> None:
        roots = len(np.unique(self.tree))
        for name, v in vars(self).items():
            setattr(self, name, v[:roots])
        self.feature[:], self.left[:], self.gain[:] = -1, -1, -1.0

    def grow(self, best: dict[str, np.ndarray]) -> None:
        """The level's results by node; those with a split get children."""
        node = best["node"]
        self.stats[node] = np.stack([best["n"], best["s"], best["q"]], 1)
        self.impurity[node] = best["impurity"]
        split = best["feature"] >= 0
        at, k = node[split], int(split.sum())
        self.feature[at], self.bin[at], self.gain[at] = best["feature"][split], best["bin"][split], best["gain"][split]
        self.left[at] = len(self) + 2 * np.arange(k)
        lower = np.stack([best[c][split] for c in ("ln", "ls", "lq")], 1)
        children = np.empty((2 * k, 3))
        children[::2], children[1::2] = lower, self.stats[at] - lower
        fill = {"tree": np.repeat(self.tree[at], 2), "feature": -1, "bin": 0, "left": -1, "stats": children, "gain": -1.0, "impurity": -1.0}
        for name, v in fill.items():
            was = getattr(self, name)
            setattr(self, name, np.concatenate([was, np.broadcast_to(v, (2 * k, *was.shape[1:])).astype(was.dtype)]))


def _statistics(of: tuple, width: int, max_bins: int, seed: int, bootstrap: bool, level: int, last: bool):
    """The task of a level: rows to the statistics of each tree and part of its nodes. Squares are
    added up by bin on the last level, where children get their sums from, else by node."""
    schema = pa.schema([("tree", pa.int32()), ("part", pa.int32()), ("first", pa.int32()), ("nodes", pa.int32()),
                        ("n", pa.binary()), ("s", pa.binary()), ("q", pa.binary())])

    def run(batches):
        feature, cut, left, spans = of.value
        short = bool((feature[:spans[0][1]] < 0).any())  # leaves above this level

        def reach(bins, node, rows):
            """The rows that come down to the level, and their nodes."""
            node = np.full(len(rows), node)
            at = bins.ravel()
            for _ in range(level):
                f = feature.take(node)
                if short and (f < 0).any():
                    on = np.flatnonzero(f >= 0)
                    rows, node, f = rows[on], node[on], f[on]
                node = left.take(node) + (at.take(f * bins.shape[1] + rows) > cut.take(node))
            return rows, node

        for blocks in _chunks(batches, width):
            for tree, a, b in spans:
                for lo in range(a, b, NODES):
                    hi = min(lo + NODES, b)
                    size = (hi - lo) * max_bins
                    n, s = np.zeros((2, width, size))
                    q = np.zeros((width, size) if last else hi - lo)
                    for bins, y, key in blocks:
                        w = draws(key, seed, tree) if bootstrap else np.ones(len(y), np.uint8)
                        rows, node = reach(bins, tree, np.flatnonzero(w))
                        if b - a > NODES:
                            on = np.flatnonzero((node >= lo) & (node < hi))
                            rows, node = rows[on], node[on]
                        if not len(rows):
                            continue
                        wn, ws = w[rows].astype(np.float64), y[rows]
                        wq = wn * ws * ws
                        ws = ws * wn
                        node = node - lo
                        if not last:
                            q += np.bincount(node, wq, hi - lo)
                        node *= max_bins
                        code = np.empty(len(rows), np.int64)
                        for f in range(width):
                            np.add(node, bins[f].take(rows), out=code)
                            n[f] += np.bincount(code, wn, size)
                            s[f] += np.bincount(code, ws, size)
                            if last:
                                q[f] += np.bincount(code, wq, size)
                    n, s = n.astype(np.int32).reshape(width, -1, max_bins), s.reshape(width, -1, max_bins)
                    q = q.reshape(width, -1, max_bins) if last else q
                    cuts = [slice(i, i + PART) for i in range(0, hi - lo, PART)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([tree] * len(cuts), pa.int32()), pa.array([(lo - a + c.start) // PART for c in cuts], pa.int32()),
                        pa.array([lo + c.start for c in cuts], pa.int32()), pa.array([min(c.stop, hi - lo) - c.start for c in cuts], pa.int32()),
                        pa.array([n[:, c].tobytes() for c in cuts], pa.binary()), pa.array([s[:, c].tobytes() for c in cuts], pa.binary()),
                        pa.array([(q[:, c] if last else q[c]).tobytes() for c in cuts], pa.binary())], schema=schema)
    return run, "tree int, part int, first int, nodes int, n binary, s binary, q binary"


def best_splits(n: np.ndarray, s: np.ndarray, q: np.ndarray, min_rows: int) -> dict[str, np.ndarray]:
    """Of nodes' counts and sums by (feature, node, bin) and their squares (alike, or by node): totals,
    variance and the split that lowers it most, the first of equal ones (feature -1: none does)."""
    width, nodes, bins = n.shape
    total, sums = n[0].sum(1).astype(np.float64), s[0].sum(1)
    squares = q if q.ndim == 1 else q[0].sum(1)
    ln, ls = np.cumsum(n, 2, dtype=np.float64)[..., :-1], np.cumsum(s, 2)[..., :-1]
    rn, rs = total[:, None] - ln, sums[:, None] - ls
    with np.errstate(divide="ignore", invalid="ignore"):
        impurity = np.where(total > 0, (squares - sums * sums / total) / total, 0.0)
        gain = (ls * ls / ln + rs * rs / rn - (sums * sums / total)[:, None]) / total[:, None]
    gain[~((ln >= max(1, min_rows)) & (rn >= max(1, min_rows)))] = -np.inf
    gain = gain.transpose(1, 0, 2).reshape(nodes, -1)
    at = gain.argmax(1)
    each = np.arange(nodes)
    most = gain[each, at]
    f, b = np.divmod(at, bins - 1)
    split = (most > 0) & (np.abs(impurity) >= np.finfo(np.float64).eps)
    lq = np.cumsum(q, 2)[f, each, b] if q.ndim == 3 else np.full(nodes, np.nan)
    return {"feature": np.where(split, f, -1), "bin": np.where(split, b, 0), "gain": np.where(split, most, -1.0), "impurity": impurity,
            "n": total, "s": sums, "q": squares, "ln": ln[f, each, b], "ls": ls[f, each, b], "lq": lq}


BEST = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()),
                  *((c, pa.float64()) for c in ("gain", "impurity", "n", "s", "q", "ln", "ls", "lq"))])
BEST_DDL = "node int, feature int, bin int, " + ", ".join(f"{c} double" for c in BEST.names[3:])


def _best(width: int, max_bins: int, min_rows: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("nodes")[0].as_py()
        shape = (width, nodes, max_bins)

        def added(name, dtype, shape):
            out = np.zeros(shape, np.int64 if dtype is np.int32 else dtype)
            for x in table.column(name):
                out += np.frombuffer(x.as_buffer(), dtype).reshape(shape)
            return out
        best = best_splits(added("n", np.int32, shape), added("s", np.float64, shape), added("q", np.float64, shape if last else nodes), min_rows)
        best["node"] = table.column("first")[0].as_py() + np.arange(nodes)
        return pa.table([pa.array(best[f.name]).cast(f.type) for f in BEST], schema=BEST)
    return run


def grow_trees(binned: DataFrame, tasks: int, width: int, trees: int, max_depth: int, max_bins: int, min_rows: int, seed: int, bootstrap: bool = True) -> Trees:
    """All trees over the coded rows (in ``tasks`` partitions), one job a level."""
    forest, first = Trees(trees), 0
    spark = binned.sparkSession
    for level in range(max_depth):
        end, last = len(forest), level == max_depth - 1
        of_tree = forest.tree[first:end]
        names, begins = np.unique(of_tree, return_index=True)
        spans = [(int(t), first + int(a), first + int(b)) for t, a, b in zip(names, begins, [*begins[1:], len(of_tree)])]
        if not spans:
            break
        shared = spark.sparkContext.broadcast((forest.feature.astype(np.int64), forest.bin, forest.left.astype(np.int64), spans))
        run, ddl = _statistics(shared, width, max_bins, seed, bootstrap, level, last)
        keys = sum(-(-(b - a) // PART) for _, a, b in spans)
        sent = tasks * (end - first) * width * max_bins * (20 if last else 12)
        n = min(keys, PARTITIONS, max(spark.sparkContext.defaultParallelism, -(-sent // PARTITION_BYTES)))
        dealt = binned.mapInArrow(run, ddl).repartition(n, "tree", "part")
        found = dealt.groupBy("tree", "part").applyInArrow(_best(width, max_bins, min_rows, last), BEST_DDL).toArrow()  # a row a node
        shared.destroy()
        best = {c: found.column(c).to_numpy() for c in found.column_names}
        order = np.argsort(best["node"])
        forest.grow({c: v[order] for c, v in best.items()})
        first = end
    return forest


def task_count(rows: int, cores: int) -> int:
    """Tasks of a level: as many for each core, of ``TASK_ROWS`` rows at most; fewer where rows are few."""
    return max(1, min(cores * -(-rows // (cores * TASK_ROWS)), -(-rows // LEAST_ROWS)))


# ---- the estimator --------------------------------------------------------------------------

class HistogramForest(Estimator):
    """Fits the forest of ``like`` (an MLlib estimator, whose parameters count) on the columns
    ``inputs``, which its feature vector is assembled from."""

    def __init__(self, like: RandomForestRegressor, inputs: list[str]):
        super().__init__()
        self.like, self.inputs = like, inputs
        if like.getMaxBins() > 256:
            raise ValueError(f"a bin is a byte: {like.getMaxBins()} bins don't fit")
        fixed = {"featureSubsetStrategy": "all", "subsamplingRate": 1.0, "impurity": "variance", "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0}
        other = [k for k, v in fixed.items() if like.getOrDefault(k) != v]
        if other or like.isDefined("weightCol"):
            raise ValueError(f"not built: other values of {', '.join(other) or 'weightCol'}")

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        rf, seed = self.like, self.like.getSeed()
        y = F.col(rf.getLabelCol()).cast("double")
        y = F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit("a label is null or NaN"))).otherwise(y)
        ids = F.col(ROW_ID) if ROW_ID in dataset.columns else F.monotonically_increasing_id()
        rows = dataset.select(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)).alias(c) for c in self.inputs], y.alias("_y"), ids.alias(ROW_ID))
        total = rows.count()
        if not total:
            raise ValueError("a forest can't be fitted on no rows")
        max_bins = min(rf.getMaxBins(), total)
        # Candidate splits come from as many rows as MLlib takes for them.
        share = min(1.0, max(rf.getMaxBins() ** 2, SAMPLE_ROWS) / total)
        some = rows if share == 1 else rows.filter(F.pmod(F.xxhash64(ROW_ID, F.lit(seed + 1)), F.lit(1 << 30)) < int(share * (1 << 30)))
        seen = some.select(*self.inputs).toArrow()
        cuts = [thresholds(seen.column(c).to_numpy(), max_bins) for c in self.inputs]
        bins = max(2, max(map(len, cuts)) + 1)
        binned = materialize(_binned(rows, self.inputs, "_y", cuts, seed), "forest_rows")
        depth = rf.getMaxDepth()
        # Read once a level: dealt evenly, so that all cores are busy to a level's end.
        tasks = task_count(total, dataset.sparkSession.sparkContext.defaultParallelism)
        dealt = binned.repartition(tasks, "key").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            forest = grow_trees(dealt, tasks, len(self.inputs), rf.getNumTrees(), max(1, depth), bins, rf.getMinInstancesPerNode(), seed, rf.getBootstrap())
        finally:
            dealt.unpersist()
        if not depth:
            forest.only_roots()
        return _as_mllib(dataset, rf, forest, cuts)


def _as_mllib(dataset: DataFrame, rf: RandomForestRegressor, forest: Trees, cuts: list[np.ndarray]) -> RandomForestRegressionModel:
    """The trees as MLlib's model, by way of its file format."""
    spark = dataset.sparkSession
    path = scratch_table_path(spark, "forest")
    order = np.argsort(forest.tree, kind="stable")
    starts = np.searchsorted(forest.tree[order], np.arange(rf.getNumTrees()))
    local = np.empty(len(forest), np.int64)
    local[order] = np.arange(len(forest)) - starts[forest.tree[order]]
    inner = forest.feature >= 0
    n, s, _ = forest.stats.T
    left = np.where(inner, local[forest.left], -1)
    threshold = [[float(cuts[f][b])] if f >= 0 else [] for f, b in zip(forest.feature, forest.bin)]
    of = lambda **cols: pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], list(cols))
    i32, i64 = (lambda x: pa.array(x).cast(pa.int32())), (lambda x: pa.array(x).cast(pa.int64()))
    split = of(featureIndex=i32(forest.feature), leftCategoriesOrThreshold=pa.array(threshold, pa.list_(pa.float64())), numCategories=i32(np.full(len(forest), -1)))
    node = of(id=i32(local), prediction=np.divide(s, n, out=np.zeros(len(forest)), where=n > 0), impurity=forest.impurity,
              impurityStats=pa.array(forest.stats.tolist(), pa.list_(pa.float64())), rawCount=i64(n), gain=forest.gain,
              leftChild=i32(left), rightChild=i32(np.where(inner, left + 1, -1)), split=split)
    # As large as the model, which the driver holds as well.
    spark.createDataFrame(pa.table({"treeID": i32(forest.tree), "nodeData": node})).write.parquet(f"{path}/data")

    def metadata(cls: str, params: set | None = None, **more) -> str:
        chosen = lambda m: {p.name: v for p, v in m.items() if params is None or p.name in params}
        return json.dumps({"class": f"org.apache.spark.ml.regression.{cls}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": f"{cls}_{uuid.uuid4().hex[:12]}", "paramMap": chosen(rf._paramMap), "defaultParamMap": chosen(rf._defaultParamMap), **more})
    of_tree = {"featuresCol", "labelCol", "predictionCol", "maxDepth", "maxBins", "minInstancesPerNode", "seed", "impurity"}
    spark.createDataFrame([(t, metadata("DecisionTreeRegressionModel", of_tree), 1.0) for t in range(rf.getNumTrees())], "_1 int, _2 string, _3 double") \
        .write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(metadata("RandomForestRegressionModel", numFeatures=len(cuts), numTrees=rf.getNumTrees()),)], "value string") \
        .coalesce(1).write.text(f"{path}/metadata")
    return RandomForestRegressionModel.load(path)
