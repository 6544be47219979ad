"""Hard-negative mining by vertical scans (BOND).

Vectors are quantised to integers and packed into blocks of ``ROWS`` rows whose
dimensions are columns, with each dimension's least and greatest value. A
block's candidates start as a bitmap of all rows with a fitting label. For an
anchor the columns are read a few at a time in descending order of the
anchor's components by magnitude; a row's score so far plus the least and most that
the dimensions not yet read can add bounds its score. Candidates whose bounds
can't reach what is asked are dropped from the bitmap, until those left have
exact scores. Nothing is estimated: a row goes only if its bounds forbid it.

Two scans: the first asks for the ``positives`` best rows of the anchor's label, the
second for the ``negatives`` best rows of other labels in each positive's window of
scores. Anchors are a stated set of queries against all rows: each part of the
row blocks (``HELD`` of them at most) is held in one task, through which the anchors
stream once; a task returns the best few of an anchor, and ranks over these few
give the result. Row and anchor shuffles are of bounded rows, and no key gathers
rows: parts are dealt by vec_id, whatever the labels.

Defined cases: rows with a null vec_id or label, a null vector, or any null or
non-finite component take no part, nor do those whose scores might not fit in a
long (components of over sqrt(2^62 / dimensions) when scaled); missing
components of shorter vectors count as zero; of rows that repeat a vec_id the
smallest by label and components takes part; ties go to the smaller vec_id; an
anchor without positives, or a positive without negatives, gives no rows; a
positive of negative score has an empty window. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import materialize

ROWS = 8192     # of a block
HELD = 32       # blocks that a task holds at most
PARTS = 512     # parts up to which each is one block
STEP = 8        # columns read between two looks at the bitmap


def vectors(rows: DataFrame, label: Column, scale: int) -> DataFrame:
    """vec_id, label, v (integer components), one row per vec_id that takes part."""
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                    F.transform("embedding", lambda c: c.cast("double") * scale).alias("x"))
    fits = F.forall("x", lambda c: F.coalesce(F.abs(c) < F.sqrt(F.lit(2.0 ** 62) / F.size("x")), F.lit(False)))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(fits)
    return x.groupBy("vec_id").agg(F.min(F.struct("label", F.transform("x", lambda c: F.floor(c).cast("int")).alias("v"))).alias("r")) \
        .select("vec_id", "r.label", "r.v")


class Block:
    """Rows with their dimensions as columns."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.least = columns.min(axis=1).astype(np.int64)
        self.most = columns.max(axis=1).astype(np.int64)


def vertical_scan(q: np.ndarray, block: Block, candidates: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """The candidates (row numbers) that ``keep`` (lower bounds, upper bounds) leaves
    after every few dimensions, with their exact scores."""
    dims = min(len(q), len(block.columns))
    order = np.argsort(-np.abs(q[:dims]), kind="stable")
    part = q[order]
    ends = part * block.least[order], part * block.most[order]
    rest_low, rest_high = (np.append(np.cumsum(f(*ends)[::-1])[::-1], 0) for f in (np.minimum, np.maximum))
    # Integers up to 2^53 are exact in floating point.
    kind = np.float64 if sum(int(x) for x in np.maximum(*map(np.abs, ends))) < 1 << 53 else np.int64
    score = np.zeros(len(candidates), kind)
    part = part.astype(kind)
    for k in range(0, dims, STEP):
        if not len(candidates):
            break
        d = order[k:k + STEP]
        read = block.columns[d] if len(candidates) == len(block.ids) else block.columns[np.ix_(d, candidates)]
        score += part[k:k + STEP] @ read.astype(kind)
        end = min(k + STEP, dims)
        stay = keep(score + kind(rest_low[end]), score + kind(rest_high[end]))
        if not stay.all():
            candidates, score = candidates[stay], score[stay]
    return candidates, score.astype(np.int64)


def _kth(x: np.ndarray, k: int):
    """The k-th greatest value."""
    return np.partition(x, len(x) - k)[len(x) - k]


class Best:
    """The best few (score descending, then id) of what was offered so far."""

    def __init__(self, few: int):
        self.few, self.scores, self.ids = few, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.few]
        self.scores, self.ids = scores[order], ids[order]

    def floor(self) -> int | None:
        """A score below which nothing is wanted any more."""
        return int(self.scores[-1]) if len(self.scores) == self.few else None


def nearest(q: np.ndarray, own: int, label: int, blocks: list[Block], few: int) -> Best:
    """The best ``few`` rows of the anchor's label, itself left out."""
    best = Best(few)

    def keep(lower, upper):
        reach = _kth(lower, few) if len(lower) > few else None
        floor = max((x for x in (reach, best.floor()) if x is not None), default=None)
        return np.ones(len(upper), bool) if floor is None else upper >= floor

    for b in blocks:
        found, score = vertical_scan(q, b, np.flatnonzero((b.labels == label) & (b.ids != own)), keep)
        best.offer(score, b.ids[found])
    return best


def in_windows(q: np.ndarray, label: int, windows: list[tuple[int, int]], blocks: list[Block], few: int) -> list[Best]:
    """Of each window (least and greatest score) the best ``few`` rows of other labels."""
    best = [Best(few) for _ in windows]

    def keep(lower, upper):
        stay = np.zeros(len(lower), bool)
        for (low, high), b in zip(windows, best):
            floor = b.floor()
            alive = (upper >= (low if floor is None else max(low, floor))) & (lower <= high)
            sure = lower[alive & (lower >= low) & (upper <= high)]
            if len(sure) > few:
                alive &= upper >= _kth(sure, few)
            stay |= alive
        return stay

    for b in blocks:
        found, score = vertical_scan(q, b, np.flatnonzero(b.labels != label), keep)
        for (low, high), w in zip(windows, best):
            m = (score >= low) & (score <= high)
            w.offer(score[m], b.ids[found[m]])
    return best


_BLOCK = pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("columns", pa.binary())])


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows, zeros where a vector is shorter."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ``ROWS`` rows at most."""
    def block(rows: pa.Table) -> pa.RecordBatch:
        m = _matrix(rows["v"].combine_chunks())
        ids, labels = (rows[c].to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        return pa.RecordBatch.from_pylist([{"n": len(ids), "dims": m.shape[1], "ids": ids.tobytes(), "labels": labels.tobytes(),
                                            "columns": np.ascontiguousarray(m.T).tobytes()}], schema=_BLOCK)
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, ROWS - n))
            batch = batch.slice(ROWS - n)
            n += held[-1].num_rows
            if n == ROWS:
                yield block(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield block(pa.Table.from_batches(held))


def row_blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """The packed blocks with the part that each belongs to, and the number of parts."""
    n = rows.count()
    blocks = -(-n // ROWS)
    parts = max(1, min(blocks, max(PARTS, -(-blocks // HELD))))
    packed = rows.repartition(parts, "vec_id").mapInArrow(pack, "n int, dims int, ids binary, labels binary, columns binary")
    return materialize(packed.withColumn("part", F.spark_partition_id()), "vector_blocks"), parts


def stream(blocks: DataFrame, parts: int, anchors: DataFrame, ask, ddl: str) -> DataFrame:
    """Every part's blocks held in one task, all anchors streaming by. ``ask`` (anchor, blocks)
    returns the columns of its rows; anchors: vec_id, label, v and further arrays."""
    empty = {f.name: F.lit(None).cast(f.dataType) for f in anchors.schema}
    held = blocks.select("part", F.lit(0).alias("kind"), "n", "dims", "ids", "labels", "columns", *[c.alias(k) for k, c in empty.items()])
    passing = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"),
                             *[F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("dims", "int"), ("ids", "binary"), ("labels", "binary"),
                                                                         ("columns", "binary"))], *anchors.columns)
    dealt = held.unionAll(passing).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")
    names = anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now = None, []
        schema = None
        for batch in batches:
            out: dict[str, list] = {}
            cols = {c: batch.column(c).to_pylist() for c in ("part", "kind", "n", "dims", "ids", "labels", "columns", *names)}
            for i, (p, kind) in enumerate(zip(cols["part"], cols["kind"])):
                if p != part:
                    part, now = p, []
                if kind == 0:
                    now.append(Block(np.frombuffer(cols["ids"][i], np.int64), np.frombuffer(cols["labels"][i], np.int64),
                                     np.frombuffer(cols["columns"][i], np.int32).reshape(cols["dims"][i], cols["n"][i])))
                elif now:
                    for name, values in ask({c: cols[c][i] for c in names}, now).items():
                        out.setdefault(name, []).extend(values)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return dealt.mapInArrow(run, ddl)


def _ranked(df: DataFrame, keys: list[str], score: str, of: str, few: int) -> DataFrame:
    """The first ``few`` rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), of)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= few)


def hard_negatives(rows: DataFrame, anchor: Column, label: Column | None = None, scale: int = 256, positives: int = 5,
                   negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says by ``vec_id`` which rows are anchors. A negative's score times 100 lies
    between ``low`` and ``high`` times the positive's."""
    clean = materialize(vectors(rows, F.col("label") if label is None else label, scale), "vectors")
    blocks, parts = row_blocks(clean)
    anchors = clean.filter(anchor)

    def ask_positives(a: dict, held: list[Block]) -> dict:
        best = nearest(np.array(a["v"], np.int64), a["vec_id"], a["label"], held, positives)
        return {"anchor_id": [a["vec_id"]] * len(best.ids), "positive_id": best.ids.tolist(), "positive_score": best.scores.tolist()}

    found = stream(blocks, parts, anchors, ask_positives, "anchor_id long, positive_id long, positive_score long")
    chosen = _ranked(found, ["anchor_id"], "positive_score", "positive_id", positives)
    lists = materialize(chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p")), "positives")
    asking = anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "v", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"))

    def ask_negatives(a: dict, held: list[Block]) -> dict:
        windows = [(-(-low * s // 100), high * s // 100) for s in a["positive_scores"]]
        of = [k for k, (x, y) in enumerate(windows) if x <= y]
        out: dict = {c: [] for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
        best = in_windows(np.array(a["v"], np.int64), a["label"], [windows[k] for k in of], held, negatives)
        for k, b in zip(of, best):
            for c, v in zip(out, ([a["vec_id"]] * len(b.ids), [a["positive_ids"][k]] * len(b.ids), [a["positive_scores"][k]] * len(b.ids),
                                  b.ids.tolist(), b.scores.tolist())):
                out[c].extend(v)
        return out

    found = stream(blocks, parts, asking, ask_negatives,
                   "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
