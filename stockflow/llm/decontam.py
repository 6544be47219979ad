"""Benchmark decontamination: BM25 over test items, block-max pruning, overlap.

The test items are the indexed side: an inverted index of their words with BM25
impacts divided by the item's score of itself, so one threshold holds for short
and long items. Every passage of every document is a query: windows of twice
the longest item's words, one half apart, so a whole item lies inside a window.
Retrieval is exact block-max WAND over a chunk of passages at once: terms too
weak to lift any item to the threshold form the optional part, whose most
possible help is known for every item; the others' block maxima plus that
help bound each block of items, blocks below the threshold are not opened, and
opened items are scored in full. Retrieved pairs are verified: at least
``overlap`` of the five-word shingles of the item's question (all but its last
sentence) and of its answer (the last sentence) must stand in the passage.

Words compare in lower case without punctuation at their edges. Items are dealt
into shards of about ``SHARD`` (by hash of item_id), whose indices are built in
tasks. Document frequencies, the mean length and the window size are those of
all items, so scores and matches don't depend on the shards. Up to ``TOGETHER``
shards are broadcast at once (the bound of what is), and a chunk of passages is
held against all of these in one pass over the documents.

Defined cases: null or empty texts and items match nothing; items without a
five-word shingle are matched by their whole word sequence; repeated items and
rows: one row per (doc_id, item_id), the best; rows with a null doc_id or
item_id are left out; empty tables: no rows. Reads doc_id, text, item_id only.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import keyed_texts, materialize, per_batch

SHARD = 20_000
TOGETHER = 8        # shards of a pass over the documents
CHUNK = 1 << 20     # bytes of text searched at once
DENSE = 1 << 22     # sums of a chunk that are kept in a plain array
BLOCK = 64          # items whose maxima are kept together
K1, LENGTH_WEIGHT = 1.2, 0.75
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_COMMON = ".,;:!?\"'()[]{}|#*$%&<>-_=+/"
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def plain(word: str) -> str:
    word = word.lower().strip(_COMMON)
    return word if word.isalnum() else _EDGES.sub("", word)


def words_of(text: str) -> list[str]:
    return [w for w in map(plain, text.split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last; a single
    sentence is cut after two thirds of its words."""
    parts = [w for w in map(words_of, _SENTENCE_END.split(text.strip())) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:]


def shingles(words: list, n: int = 5) -> set:
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def held(part: set, passage: list) -> float:
    """The share of an item's shingles that stand in the passage (1 if it has none)."""
    if not part:
        return 1.0
    return len(part & shingles(passage, len(next(iter(part))))) / len(part)


class Index:
    """BM25 impacts of a shard of items, as fractions of an item's own score. ``overall``: the document
    frequencies (of the shard's words), number, words and greatest length of all items;
    if None, the shard is all there is."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, overall: tuple[dict, int, int, int] | None = None):
        self.threshold = threshold
        self.items = [(i, question_and_answer(t)) for i, t in items]
        self.items = [(i, qa) for i, qa in self.items if qa[0] or qa[1]]
        bags = [Counter(q + a) for _, (q, a) in self.items]
        size = [sum(b.values()) for b in bags]
        df, n, words, longest = overall or (Counter(w for b in bags for w in b), len(bags), sum(size), max(size, default=0))
        self.term = {w: k for k, w in enumerate(sorted({w for b in bags for w in b}))}
        mean = words / max(1, n)
        rows = []
        for k, b in enumerate(bags):
            weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1)
                      / (c + K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * size[k] / mean)) for w, c in b.items()}
            own = sum(weight.values())
            rows += [(self.term[w], k, v / own) for w, v in weight.items()]
        rows.sort()
        self.post_term = np.array([r[0] for r in rows], np.int64)
        self.post_item = np.array([r[1] for r in rows], np.int64)
        self.post_weight = np.array([r[2] for r in rows], np.float64)
        self.questions = [self._ids(q) for _, (q, _) in self.items]
        self.answers = [self._ids(a) for _, (_, a) in self.items]
        self.half = max(32, longest)  # words between windows; a window has twice as many
        self._split(len(self.term), len(bags))

    def _ids(self, words: list[str]) -> set:
        return shingles([self.term[w] for w in words])

    def _split(self, n_terms: int, n_items: int) -> None:
        """Optional terms: the most frequent ones, while they give no item more
        than half the threshold. Required terms keep (block, maximum) lists."""
        df = np.bincount(self.post_term, minlength=n_terms)
        begin = np.concatenate([[0], np.cumsum(df)])
        help_, optional = np.zeros(n_items), np.zeros(n_terms, bool)
        for t in np.argsort(-df, kind="stable"):
            rows = slice(begin[t], begin[t + 1])
            grown = help_[self.post_item[rows]] + self.post_weight[rows]
            if df[t] < 2 or grown.max() > self.threshold / 2:
                break
            help_[self.post_item[rows]] = grown
            optional[t] = True
        self.required = ~optional
        n_blocks = max(1, -(-n_items // BLOCK))
        self.n_blocks = n_blocks
        self.block_help = np.array([help_[b * BLOCK:(b + 1) * BLOCK].max(initial=0) for b in range(n_blocks)])
        self.begin = begin
        block = self.post_item // BLOCK
        key = self.post_term * n_blocks + block
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.top = np.maximum.reduceat(self.post_weight, first) if len(first) else np.zeros(0)
        self.top_block = block[first]
        self.top_begin = np.searchsorted(self.post_term[first], np.arange(n_terms + 1))

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, items and scores of all pairs at the threshold or above, from
        the different (passage, term) pairs of a chunk, sorted by passage."""
        need, n_passages = self.required[term], int(passage[-1]) + 1 if len(passage) else 0
        p, slot = _expand(passage[need], self.top_begin, term[need])
        key, bound = _sums(p * self.n_blocks + self.top_block[slot], self.top[slot], n_passages * self.n_blocks)
        key = key[bound + self.block_help[key % self.n_blocks] >= self.threshold - 1e-9]  # the pivots: blocks to open
        if not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        opened = np.zeros((n_passages, self.n_blocks), bool)
        opened.ravel()[key] = True
        mine = opened.any(axis=1)[passage]
        p, slot = _expand(passage[mine], self.begin, term[mine])
        item = self.post_item[slot]
        mine = opened[p, item // BLOCK]
        pair, score = _sums(p[mine] * len(self.items) + item[mine], self.post_weight[slot[mine]], n_passages * len(self.items))
        good = score >= self.threshold - 1e-9
        return pair[good] // len(self.items), pair[good] % len(self.items), score[good]


def _sums(key: np.ndarray, weight: np.ndarray, domain: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and the sum of weights of each."""
    if domain <= DENSE:
        total = np.bincount(key, weights=weight, minlength=domain)
        key = np.flatnonzero(total)
        return key, total[key]
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, weights=weight, minlength=len(key))


def _expand(owner: np.ndarray, begin: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner once for each list entry of its key, and the entry's place."""
    n = begin[key + 1] - begin[key]
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    return np.repeat(owner, n), np.arange(total) - np.repeat(end - n, n) + np.repeat(begin[key], n)


class _Terms(dict):
    """Raw word (bytes) -> term id, -1 outside the index, -2 without letters or digits."""

    def __init__(self, term: dict, most: int = 1 << 18):
        self.term, self.most = term, most

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        w = plain(raw.decode("utf-8", "replace"))
        t = self[raw] = self.term.get(w, -1) if w else -2
        return t


def index_shards(benchmark: DataFrame, threshold: float) -> DataFrame:
    """shard, index (an ``Index``, pickled): a row for each shard that has an item with words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")) \
        .filter("item_id is not null and text is not null").distinct()
    n_shards = max(1, -(-items.count() // SHARD))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(n_shards)).cast("int"))
    bag = pa.schema([("shard", pa.int32()), ("item_id", pa.int64()), ("text", pa.string()), ("words", pa.list_(pa.string())), ("size", pa.int64())])

    def bags(cols: dict) -> dict:
        found = [[w for part in question_and_answer(t) for w in part] for t in cols["text"]]
        return {**{c: cols[c] for c in ("shard", "item_id", "text")}, "words": [sorted(set(w)) for w in found], "size": [len(w) for w in found]}

    made = items.mapInArrow(per_batch(bags, bag), "shard int, item_id long, text string, words array<string>, size long")
    made = materialize(made.filter("size > 0"), "benchmark_items")
    total = made.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    words = made.select(F.col("shard").alias("of_shard"), F.explode("words").alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))  # a word counts once an item
    of_shard = words.distinct().join(df, "word").select("of_shard", "word", "df")

    def build(key, rows, frequencies):
        known = dict(zip(frequencies.column("word").to_pylist(), frequencies.column("df").to_pylist()))
        index = Index(sorted(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())), threshold,
                      (known, total[0], total[1], total[2]))
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(index)], pa.binary())})

    built = made.select("shard", "item_id", "text").groupBy("shard").cogroup(of_shard.groupBy("of_shard")).applyInArrow(build, "shard int, index binary")
    return materialize(built, "benchmark_index")


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """doc_id, item_id, score (of the best passage, 1 is the item itself),
    question_overlap, answer_overlap, start_word (of that passage)."""
    spark = docs.sparkSession
    texts = keyed_texts(docs).filter("doc_id is not null and body is not null").select("doc_id", "body")
    columns = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, start_word long"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                        ("answer_overlap", pa.float64()), ("start_word", pa.int64())])
    shards = index_shards(benchmark, threshold)
    numbers = sorted(r.shard for r in shards.select("shard").collect())
    out = None
    for k in range(0, len(numbers), TOGETHER):
        rows = shards.filter(F.col("shard").isin(numbers[k:k + TOGETHER])).orderBy("shard").collect()  # about TOGETHER * SHARD items
        shared = spark.sparkContext.broadcast([pickle.loads(r["index"]) for r in rows])

        def run(batches, shared=shared):
            searchers = [per_batch(_searcher(index, overlap), schema, CHUNK) for index in shared.value]
            for batch in batches:
                for search in searchers:
                    yield from search([batch])

        found = texts.mapInArrow(run, columns)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], columns)
    best = F.max_by(F.struct(*schema.names[2:]), F.struct("score", "question_overlap", "answer_overlap", -F.col("start_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def _searcher(index: Index, overlap: float):
    terms, half = _Terms(index.term), index.half

    def of(cols: dict) -> dict | None:
        seqs = []
        for b in cols["body"]:
            t = np.fromiter(map(terms.__getitem__, words := b.split()), np.int64, len(words))
            seqs.append(t[t > -2])
        n = np.array([len(s) for s in seqs], np.int64)
        # Half-windows are numbered through the chunk, with one spare number between documents.
        halves = -(-n // half) + 1
        base = np.cumsum(halves) - halves
        flat = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        known = flat >= 0
        cell = base[doc[known]] + at[known] // half
        n_terms, n_cells = len(index.term), int(halves.sum())
        # Window w covers half-windows w and w + 1.
        if n_cells * n_terms <= 16 * DENSE:
            there = np.zeros((n_cells + 1, n_terms), bool)
            there[cell, flat[known]] = True
            both = np.flatnonzero(there[:-1] | there[1:])
        else:
            key = cell * n_terms + flat[known]
            both = np.unique(np.concatenate([key, key[key >= n_terms] - n_terms]))
        window, item, score = index.retrieve(both // n_terms, both % n_terms)
        out = {x: [] for x in ("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "start_word")}
        for w, i, s in zip(window.tolist(), item.tolist(), score.tolist()):
            d = int(np.searchsorted(base, w, "right")) - 1
            a = (w - int(base[d])) * half
            passage = seqs[d][a:a + 2 * half].tolist()
            q, r = held(index.questions[i], passage), held(index.answers[i], passage)
            if q >= overlap and r >= overlap:
                for name, v in zip(out, (cols["doc_id"][d], index.items[i][0], s, q, r, a)):
                    out[name].append(v)
        return out if out["doc_id"] else None
    return of


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """The documents without a verified match, all columns."""
    found = matches(docs, benchmark, threshold, overlap).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["found_id"], "left_anti")
