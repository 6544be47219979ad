"""Language-model scoring with a causal self-attention model trained in numpy.

Texts (A-Z lower-cased, words and one end) become byte-level subword ids, each
word with a space before it, so the ids spell the word sequence. The model
gives the next id's class from attention over the ids before it, and the id
within its class from the class before:

    P(id | past) = softmax(bigram[previous class] + attention(past))[class(id)]
                   * P(id | class(id), previous class)
    P(word | past) = P(first id | past, a word begins)
                     * (k * c(word) / c(first id)
                        + (1 - k) * product of P(id | past) over its later ids
                          * P(a word begins | past of the next word))

so the context chooses how a word begins, and counts or spelling how it goes on.
1 - k is the share of words counted once (Good-Turing's share of unseen words).
These add up to one over all words. The most frequent ids are classes of
their own; the others are clustered by the classes that stand before them,
ids that begin words apart from those that don't, so P(a word begins) is a sum
over classes. Class bigrams, ids within classes and words
are counted over all training documents. The attention part (embeddings, one
causal head, output) is trained by Adam on every window of every training
document, in ``ROUNDS`` rounds: a window is in one round, by hash; in a round
every partition goes on from the last average, with a smaller rate, and the
weights are averaged again, weighted by ids.

Scoring runs over windows of ``WINDOW`` ids that overlap by ``WINDOW - STEP``;
each id is scored once, in the window that gives it at least that much past
(or all there is), many windows at a time with masked attention.

Words are known by a 64-bit hash of their ids. The ``FREQUENT`` most counted
are looked up in a bounded broadcast; the others' occurrences go, with their
attention probability, through a shuffled join with the counts.

Defined cases: null text is empty and has the end token only; a null doc_id is
in training (its remainder is unknown); repeated rows count each and get the
same scores; without training words, all are unknown; empty table: no rows.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.bpe import WordEncoder
from stockflow.llm.common import chunks, keyed_texts, materialize, mix64, per_batch, word_codes

FREQUENT = 1 << 20
OWN, SHARED = 24, 40            # classes of one id, and classes of many (half of them begin words)
CLASSES = OWN + SHARED
WINDOW, STEP, WIDTH = 16, 12, 16
ROUNDS = 4                      # of training and averaging; each training window is in one
SLICES = 16                     # of the id range, for counts
PRIOR = 50.0                    # weight of P(id | class) in P(id | class, previous class)
UNSEEN = 0.02, 0.5              # least and most weight of spelling
SEND = 2_000_000                # words whose counts a task adds up before sending
CHUNK = 2 << 20                 # bytes of text or ids worked on at once
BLOCK = 96                      # windows whose logits fit the processor's cache


# ---- ids and word counts

@lru_cache(1)
def word_encoder(tokenizer: str) -> WordEncoder:
    """A worker's encoder: its next task finds it with the words known by then (at most 2^19)."""
    return WordEncoder(tokenizer, word_ends=False, most=1 << 19)


def encoded(docs: DataFrame, tokenizer: str, modulus: int, remainder: int) -> DataFrame:
    """doc_id, text_key, held_out, n_tokens, ids (two bytes each)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    texts = keyed_texts(docs).withColumn("held_out", F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False)))

    def encode(encoder: WordEncoder):
        def of(cols: dict) -> dict:
            words, codes, n_words = word_codes(cols["body"])
            flat, n_ids = encoder.of(words, codes)
            flat = flat.astype(np.uint16)
            at = np.concatenate([[0], np.cumsum(n_ids)])[np.concatenate([[0], np.cumsum(n_words)])]
            end = np.uint16(encoder.size - 1).tobytes()
            return {"doc_id": cols["doc_id"], "text_key": cols["text_key"], "held_out": cols["held_out"],
                    "n_tokens": n_words + 1,
                    "ids": [flat[a:b].tobytes() + end for a, b in zip(at[:-1], at[1:])]}
        return of

    def run(batches):
        yield from per_batch(encode(word_encoder(tokenizer)), schema, CHUNK)(batches)

    return texts.mapInArrow(run, "doc_id long, text_key long, held_out boolean, n_tokens long, ids binary")


def word_starts(tokenizer: str) -> np.ndarray:
    """Of each id whether it begins a word: a space is its first byte, or it is the end."""
    vocab = WordEncoder(tokenizer, word_ends=False).library.get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if t[0] == "\u0120"]] = True
    out[-1] = True
    return out


def word_keys(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in a run of ids, and a 64-bit hash of each word's ids."""
    first = np.flatnonzero(starts[flat])
    place = np.arange(len(flat)) - np.repeat(first, np.diff(np.append(first, len(flat))))
    return first, np.add.reduceat(mix64(flat.astype(np.uint64) * np.uint64(0x1000193) + (place.astype(np.uint64) << np.uint64(40)) + np.uint64(1)), first)


def word_counts(coded: DataFrame, starts) -> DataFrame:
    """word (hash of its ids), c, over all training documents; a task adds up before it sends."""
    schema = pa.schema([("word", pa.int64()), ("c", pa.int64())])

    def run(batches):
        held = []

        def counts() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

        for batch in batches:
            for a, b in chunks(coded_ids := batch.column("ids").to_pylist(), CHUNK):
                held.append(word_keys(np.concatenate(_ids(coded_ids[a:b])), starts.value)[1])
                if sum(map(len, held)) >= SEND:
                    yield counts()
        if held:
            yield counts()

    return coded.filter("not held_out").select("ids").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


# ---- the model

def softmax_rows(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


class Attention:
    """One causal head over class embeddings; output added to class-bigram logits."""

    NAMES = ("embed", "place", "query", "key", "value", "out")

    def __init__(self, bigram: np.ndarray, weights: dict[str, np.ndarray] | None = None):
        self.bigram = bigram.astype(np.float32)
        if weights is None:
            rng = np.random.default_rng(1)
            init = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
            weights = {"embed": init(CLASSES + 1, WIDTH), "place": init(WINDOW, WIDTH) / 3, "query": init(WIDTH, WIDTH),
                       "key": init(WIDTH, WIDTH), "value": init(WIDTH, WIDTH), "out": np.zeros((2 * WIDTH, CLASSES), np.float32)}
        self.w = weights
        self.mask = np.where(np.tri(WINDOW, dtype=bool), 0, -1e9).astype(np.float32)

    def hidden(self, past: np.ndarray) -> tuple:
        """What each place knows of the classes before it: its embedding and the
        attention's sum; also the inner values that the gradients need."""
        w, shape = self.w, (len(past), WINDOW, WIDTH)
        x = w["embed"][past] + w["place"]
        flat = x.reshape(-1, WIDTH)
        q, k, v = ((flat @ w[n]).reshape(shape) for n in ("query", "key", "value"))
        a = q @ k.transpose(0, 2, 1)
        a *= np.float32(WIDTH ** -0.5)
        a += self.mask
        np.exp(a, out=a)  # small logits: no need to shift
        a /= a.sum(axis=-1, keepdims=True)
        return x, q, k, v, a, np.concatenate([x, a @ v], axis=-1)

    def tables(self, sums: np.ndarray) -> tuple:
        """What depends on a place and its class alone: query, key and value (with a
        one, for the sum of weights) side by side, and the logits without the
        attention's part. ``sums``: ones, and ones at the classes that begin words."""
        w = self.w
        x = (w["embed"] + w["place"][:, None]).reshape(-1, WIDTH)
        qkv = np.concatenate([x @ w["query"] * WIDTH ** -0.5, x @ w["key"], x @ w["value"], np.ones((len(x), 1))], axis=1)
        logits = x @ w["out"][:WIDTH] + np.tile(self.bigram, (WINDOW, 1))
        return tuple(np.ascontiguousarray(t, np.float32) for t in (qkv, logits, w["out"][WIDTH:], sums))

    def log_likelihood(self, past: np.ndarray, target: np.ndarray, scored: np.ndarray, tables: tuple) -> np.ndarray:
        """Natural logs of P(class) and of P(a word begins) at the scored places."""
        qkv, logits, out, sums = tables
        at, live = past + np.arange(WINDOW) * (CLASSES + 1), np.flatnonzero(scored)
        x = qkv.take(at, axis=0)
        a = x[..., :WIDTH] @ x[..., WIDTH:2 * WIDTH].transpose(0, 2, 1)
        a += self.mask
        np.exp(a, out=a)  # small logits: no need to shift
        c = (a @ x[..., 2 * WIDTH:]).reshape(-1, WIDTH + 1).take(live, axis=0)
        z = (c[:, :WIDTH] / c[:, WIDTH:]) @ out
        z += logits.take(at.ravel().take(live), axis=0)
        got = z[np.arange(len(z)), target.ravel().take(live)]
        np.exp(z, out=z)
        total = np.log(z @ sums)
        return np.stack([got - total[:, 0], total[:, 1] - total[:, 0]])

    def gradients(self, past: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the targets and its gradients, summed over
        blocks of windows that fit the processor's cache."""
        each = (weight / max(1.0, float(weight.sum()))).astype(np.float32)
        loss, g = 0.0, {}
        for k in range(0, len(past), BLOCK):
            more, add = self._block_gradients(*(x[k:k + BLOCK] for x in (past, target, each)))
            loss += more
            g = {name: g[name] + add[name] for name in add} if g else add
        return loss, g

    def _block_gradients(self, past: np.ndarray, target: np.ndarray, each: np.ndarray) -> tuple[float, dict]:
        """Of a block, with each place's share of the mean. Places without one are
        attended to, but need no logits."""
        w, shape, scale = self.w, (len(past), WINDOW, WIDTH), np.float32(WIDTH ** -0.5)
        of, live = past.ravel(), np.flatnonzero(each)
        each, target, rows = each.ravel()[live], target.ravel()[live], np.arange(len(live))
        qkv = np.concatenate([w["query"] * scale, w["key"], w["value"]], axis=1)
        x = (w["embed"].take(past, axis=0) + w["place"]).reshape(-1, WIDTH)
        y = (x @ qkv).reshape(*shape[:2], -1)
        q, k, v = y[..., :WIDTH], y[..., WIDTH:2 * WIDTH], y[..., 2 * WIDTH:]
        a = q @ k.transpose(0, 2, 1)
        a += self.mask
        np.exp(a, out=a)  # small logits: no need to shift
        a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(*shape[:2], 1)
        c = a @ v
        h = np.concatenate([x, c.reshape(-1, WIDTH)], axis=1).take(live, axis=0)
        d = h @ w["out"]
        d += self.bigram.take(of.take(live), axis=0)
        picked = d[rows, target]
        np.exp(d, out=d)
        total = d @ np.ones(CLASSES, np.float32)
        loss = float(((np.log(total) - picked) * each).sum())
        d *= (each / total)[:, None]
        d[rows, target] -= each
        g = {"out": h.T @ d}
        dh = np.zeros((len(x), 2 * WIDTH), np.float32)
        dh[live] = d @ w["out"].T
        dc = dh[:, WIDTH:].reshape(shape)
        ds = dc @ v.transpose(0, 2, 1)
        ds -= np.einsum("bti,bti->bt", dc, c)[..., None]  # the weights of a place add up to one
        ds *= a
        dy = np.empty_like(y)
        np.matmul(ds, k, out=dy[..., :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=dy[..., WIDTH:2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), dc, out=dy[..., 2 * WIDTH:])
        dy = dy.reshape(len(x), -1)
        dw = x.T @ dy
        g["query"], g["key"], g["value"] = dw[:, :WIDTH] * scale, dw[:, WIDTH:2 * WIDTH], dw[:, 2 * WIDTH:]
        dx = dh[:, :WIDTH] + dy @ qkv.T
        g["place"] = dx.reshape(shape).sum(axis=0)
        order = np.argsort(of.astype(np.uint8), kind="stable")
        held = of.take(order)
        first = np.append(0, np.flatnonzero(held[1:] != held[:-1]) + 1)
        g["embed"] = np.zeros_like(w["embed"])
        g["embed"][held[first]] = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
        return loss, g

    def fit(self, past: np.ndarray, target: np.ndarray, weight: np.ndarray, state: dict, rate: float, batch: int = 256) -> None:
        """One pass of Adam over the windows; ``state`` goes from call to call."""
        w = self.vector()
        self.w = self.split(w)  # views, so a step is one over all weights
        m, s = (state.setdefault(x, np.zeros_like(w)) for x in "ms")
        for k in range(0, len(past), batch):
            t = state["t"] = state.get("t", 0) + 1
            rows = slice(k, k + batch)
            _, g = self.gradients(past[rows], target[rows], weight[rows])
            g = np.concatenate([g[name].ravel() for name in self.NAMES])
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g ** 2
            w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-6)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in self.NAMES])

    def split(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """The weights by name, as views of a vector of all."""
        ends = np.cumsum([self.w[n].size for n in self.NAMES])
        return {n: v.reshape(self.w[n].shape) for n, v in zip(self.NAMES, np.split(vector, ends[:-1]))}

    def load(self, vector: np.ndarray) -> Attention:
        self.w = self.split(vector.astype(np.float32))
        return self


def windows(classes: np.ndarray, n: np.ndarray, choose=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as classes, one after the other, ``n`` ids each (one at least): what
    stands before each place, the place's class, whether this window scores it,
    and the text of each window. The start of a text is class ``CLASSES``; ids
    before the overlap's end belong to the window before. ``choose`` (text and
    number in the text of each window -> mask) leaves the other windows out."""
    per = np.maximum(1, -(-(n - (WINDOW - STEP)) // STEP))
    owner = np.repeat(np.arange(len(n)), per)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * STEP
    if choose is not None:
        keep = choose(owner, first // STEP)
        owner, first = owner[keep], first[keep]
    base = np.cumsum(n + 1) - (n + 1)
    flat = np.full(int((n + 1).sum()) + WINDOW + 1, CLASSES, np.int64)
    flat[np.arange(len(classes)) + np.repeat(np.arange(len(n)) + 1, n)] = classes
    at = (base[owner] + first)[:, None] + np.arange(WINDOW)
    place = first[:, None] + np.arange(WINDOW)
    live = place < n[owner][:, None]
    scored = live & ((np.arange(WINDOW) >= WINDOW - STEP) | (first == 0)[:, None])
    return np.where(live, flat[at], CLASSES), np.where(live, flat[at + 1], 0), scored, owner


class Model:
    """Classes, counted parts and attention weights; of bounded size."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray):
        """First classes, from id counts: by frequency. ``begins``: ids that begin words."""
        self.counts = counts
        order = np.argsort(-counts, kind="stable")
        self.of = np.empty(len(counts), np.int64)
        self.of[order[:OWN]] = np.arange(OWN)
        rest, half = order[OWN:], SHARED // 2
        self.kinds = [(OWN, rest[begins[rest]]), (OWN + half, rest[~begins[rest]])]
        for at, ids in self.kinds:
            share = np.cumsum(counts[ids] + 1e-9)  # shared classes hold about equal mass
            self.of[ids] = at + np.minimum(half - 1, (share / share[-1] * half).astype(np.int64))
        opening = np.append(begins[order[:OWN]], np.repeat([True, False], half))
        self.sums = np.stack([np.ones(CLASSES), opening], axis=1).astype(np.float32)

    def cluster(self, pairs: np.ndarray, rounds: int = 12) -> None:
        """Shared classes by what stands before: k-means over the square roots of
        the shares of previous classes, smoothed towards all ids'."""
        for at, ids in self.kinds:
            f = pairs[:, ids].T
            mean = (f.sum(axis=0) + 1) / (f.sum() + f.shape[1])
            x = np.sqrt((f + 20 * mean) / (f.sum(axis=1, keepdims=True) + 20)).astype(np.float32)
            weight = self.counts[ids] + 0.01
            often = np.argsort(-weight, kind="stable")[:2000]
            centre = x[np.random.default_rng(0).choice(often, SHARED // 2, replace=False)]
            for _ in range(rounds):
                near = (-2 * x @ centre.T + (centre ** 2).sum(axis=1)).argmin(axis=1)
                for k in range(SHARED // 2):
                    if (mine := near == k).any():
                        centre[k] = (x[mine] * weight[mine, None]).sum(axis=0) / weight[mine].sum()
            self.of[ids] = at + near

    def finish(self, pairs: np.ndarray) -> None:
        """``pairs``: counts of (previous class or start, id)."""
        onehot = np.zeros((CLASSES + 1, CLASSES))
        for c in range(CLASSES):
            onehot[:, c] = pairs[:, self.of == c].sum(axis=1)
        single = onehot.sum(axis=0) + 1
        single /= single.sum()
        smooth = (onehot + 20 * single) / (onehot.sum(axis=1, keepdims=True) + 20)
        self.bigram = np.log(smooth).astype(np.float32)
        total = pairs.sum(axis=0) + 0.5
        mass = np.bincount(self.of, weights=total, minlength=CLASSES)
        prior = total / mass[self.of]
        inside = (pairs + PRIOR * prior) / (onehot[:, self.of] + PRIOR)
        self.inside = np.log(inside).astype(np.float32)

    def score(self, attention: Attention, ids: list[np.ndarray]) -> np.ndarray:
        """Natural logs of P(id | past) and P(a word begins | past) of each id of some
        texts, one text after the other; blocks of windows fit the processor's cache."""
        flat = np.concatenate(ids)
        n = np.array([len(i) for i in ids])
        classes = self.of[flat]
        before = np.concatenate([[CLASSES], classes[:-1]])
        before[np.cumsum(n)[:-1]] = CLASSES
        past, target, scored, _ = windows(classes, n)
        tables = attention.tables(self.sums)
        got = np.concatenate([attention.log_likelihood(*(x[k:k + BLOCK] for x in (past, target, scored)), tables)
                              for k in range(0, len(past), BLOCK)], axis=1)  # scored places are in the order of the texts
        got[0] += self.inside[before, flat]
        return got


def _sum_slices(rows: DataFrame, name: str) -> dict[int, np.ndarray]:
    """Adds float64 vectors (part, data, weight) by part; a part is of bounded size.
    One task of partial sums per (part, deal) first, so none takes all senders."""
    def add(key, table):
        total, weight = None, 0.0
        for data, w in zip(table.column("data").to_pylist(), table.column("weight").to_pylist()):
            v = np.frombuffer(data, np.float32).astype(np.float64) * (w or 1.0)
            total, weight = v if total is None else total + v, weight + (w or 1.0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary()),
                         "weight": pa.array([weight], pa.float64())})
    ddl = "part int, data binary, weight double"
    partial = rows.withColumn("deal", F.pmod(F.xxhash64("data"), F.lit(64))).groupBy("part", "deal").applyInArrow(add, ddl)
    out = materialize(partial.groupBy("part").applyInArrow(add, ddl), name).collect()  # a few vectors of fixed size
    return {r.part: np.frombuffer(r.data, np.float32).astype(np.float64) * r.weight for r in out} | {-1 - r.part: np.array([r.weight]) for r in out}


def _ids(column: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint16).astype(np.int64) for b in column]


def train(coded: DataFrame, begins: np.ndarray) -> tuple[Model, np.ndarray]:
    """Counts over all training documents, then attention weights."""
    spark, vocabulary = coded.sparkSession, len(begins)
    texts = coded.filter("not held_out").select("text_key", "ids")
    ddl = "part int, data binary, weight double"
    schema = pa.schema([("part", pa.int32()), ("data", pa.binary()), ("weight", pa.float64())])

    def send(vector: np.ndarray) -> pa.RecordBatch:
        cut = np.array_split(vector.ravel().astype(np.float32), SLICES)
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([c.tobytes() for c in cut]),
                                           pa.array([1.0] * SLICES)], schema=schema)

    def summed(counter, size: int, name: str) -> np.ndarray:
        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                for a, b in chunks(coded_ids := batch.column("ids").to_pylist(), CHUNK):
                    total += counter(_ids(coded_ids[a:b]))
            yield send(total)
        got = _sum_slices(texts.mapInArrow(run, ddl), name)
        return np.concatenate([got[k] for k in range(SLICES)]) if got else np.zeros(size)

    def pairs(of: np.ndarray, name: str) -> np.ndarray:
        shared = spark.sparkContext.broadcast(of)

        def count(ids: list[np.ndarray]) -> np.ndarray:
            flat = np.concatenate(ids)
            before = np.concatenate([[CLASSES], shared.value[flat[:-1]]])
            before[np.cumsum([len(i) for i in ids])[:-1]] = CLASSES
            return np.bincount(before * vocabulary + flat, minlength=(CLASSES + 1) * vocabulary)
        return summed(count, (CLASSES + 1) * vocabulary, name).reshape(CLASSES + 1, vocabulary)

    model = Model(summed(lambda ids: np.bincount(np.concatenate(ids), minlength=vocabulary), vocabulary, "id_counts"), begins)
    model.cluster(pairs(model.of, "first_pairs"))
    model.finish(pairs(model.of, "class_pairs"))
    known = spark.sparkContext.broadcast((model.of, model.bigram))

    weights = Attention(model.bigram).vector().astype(np.float32)

    def one_round(turn: int, start: np.ndarray):
        def fit(batches):
            of, bigram = known.value
            word_encoder.cache_clear()  # no use from here on
            attention, state, n, mix = Attention(bigram).load(start), {}, 0.0, np.random.default_rng(2)
            for batch in batches:
                keys = batch.column("text_key").to_numpy().view(np.uint64)
                for a, b in chunks(coded_ids := batch.column("ids").to_pylist(), CHUNK):
                    ids, key = _ids(coded_ids[a:b]), keys[a:b]
                    past, target, scored, _ = windows(of[np.concatenate(ids)], np.array([len(i) for i in ids]), lambda text, number: mix64(
                        key[text] + number.astype(np.uint64)) % np.uint64(ROUNDS) == turn)
                    order = mix.permutation(len(past))
                    attention.fit(past[order], target[order], scored[order].astype(np.float32), state, 0.01 * 0.5 ** turn)
                    n += float(scored.sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([attention.vector().astype(np.float32).tobytes()]),
                                                  pa.array([n])], schema=schema)
        return fit

    for turn in range(ROUNDS):
        got = _sum_slices(texts.mapInArrow(one_round(turn, weights), ddl), "attention_weights")
        if got:
            weights = (got[0] / got[-1][0]).astype(np.float32)
    return model, weights.astype(np.float32)


def lm_scores(docs: DataFrame, tokenizer: str, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row
    per input row. Documents whose crc32 has the remainder are held out."""
    spark = docs.sparkSession
    begins = word_starts(tokenizer)
    starts = spark.sparkContext.broadcast(begins)
    coded = materialize(encoded(docs, tokenizer, modulus, remainder), "subword_ids")
    counts = materialize(word_counts(coded, starts), "word_counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    most = counts.orderBy(F.desc("c"), "word").limit(FREQUENT)  # a bounded table
    frequent = np.array([(r.word, r.c) for r in most.toLocalIterator()], np.int64).reshape(-1, 2)
    frequent = frequent[np.argsort(frequent[:, 0].copy().view(np.uint64))]
    scale = math.log(total.n + total.v + 1)
    unseen = min(max(total.once / max(total.n, 1), UNSEEN[0]), UNSEEN[1])
    counted, spelled = math.log(1 - unseen), math.log(unseen)
    shared = spark.sparkContext.broadcast((*train(coded, begins), frequent[:, 0].copy().view(np.uint64), frequent[:, 1].astype(np.float64)))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
                        ("words", pa.list_(pa.int64())), ("begun", pa.list_(pa.float32())), ("spelled", pa.list_(pa.float32()))])

    def scored(batch: pa.RecordBatch, attention: Attention, model: Model, word: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        """Scores of frequent words summed by text; the others' hashes and log P by
        spelling, and by counting but for the word's count."""
        ids = _ids(batch.column("ids").to_pylist())
        flat = np.concatenate(ids)
        first, key = word_keys(flat, starts.value)
        end = np.cumsum(batch.column("n_tokens").to_numpy())
        logs, opens = model.score(attention, ids)
        ends = np.append(opens[first[1:]], 0.0)
        ends[end - 1] = 0.0  # nothing follows a text's end
        lead = logs[first] - opens[first]
        by_spelling = np.add.reduceat(logs, first, dtype=np.float64) - opens[first] + ends + spelled
        by_count = lead - np.log(np.maximum(model.counts[flat[first]], 1)) + counted
        order = np.argsort(key)  # neighbours in the table are looked up one after the other
        at = np.empty(len(key), np.int64)
        at[order] = np.minimum(np.searchsorted(word, key[order]), max(0, len(word) - 1))
        found = word[at] == key if len(word) else np.zeros(len(key), bool)
        n = np.where(found, c[at], 1.0) if len(word) else np.ones(len(key))
        own = np.where(found, np.log1p(n) - scale, 0.0)
        mixed = np.where(found, np.logaddexp(by_count + np.log(n), by_spelling), 0.0)
        begin = np.concatenate([[0], end[:-1]])
        rare = np.concatenate([[0], np.cumsum(~found)])
        cuts = pa.array(np.append(rare[begin], rare[-1]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (
            key[~found].view(np.int64), by_count[~found].astype(np.float32), by_spelling[~found].astype(np.float32))]
        return pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)] + [
            pa.array(np.add.reduceat(found, begin, dtype=np.int64)), pa.array(np.add.reduceat(own, begin)),
            pa.array(np.add.reduceat(mixed, begin))] + [x.cast(f.type) for x, f in zip(lists, list(schema)[7:])], schema=schema)

    def run(batches):
        model, weights, word, c = shared.value
        attention = Attention(model.bigram).load(weights)
        for batch in batches:
            size = batch.column("ids").to_pylist()
            for a, b in chunks(size, 1 << 20):  # half a million ids
                yield scored(batch.slice(a, b - a), attention, model, word, c)

    looked = materialize(coded.mapInArrow(run, "doc_id long, text_key long, held_out boolean, n_tokens long, known long, base double, "
                                               "score double, words array<long>, begun array<float>, spelled array<float>"), "frequent_words")
    rare = looked.select("doc_id", "text_key", F.explode(F.arrays_zip("words", "begun", "spelled")).alias("x")).select(
        "doc_id", "text_key", F.col("x.words").alias("word"), F.col("x.begun").cast("double").alias("p"), F.col("x.spelled").cast("double").alias("q"))
    own = F.log(F.col("c") + 1.0) - scale
    by_count = F.col("p") + F.log(F.col("c").cast("double"))
    high, low = F.greatest(by_count, "q"), F.least(by_count, "q")
    more = rare.join(counts, "word", "left").groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(
        F.count("c").alias("known_more"), F.sum(F.coalesce(own, F.lit(-scale))).alias("base_more"),
        F.sum(F.when(F.col("c").isNull(), F.col("q")).otherwise(high + F.log1p(F.exp(low - high)))).alias("score_more"))
    copies = looked.groupBy(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key")).agg(F.count("*").alias("copies"))
    more = more.join(copies, more.of_id.eqNullSafe(copies.c_id) & (more.of_key == copies.c_key)).drop("c_id", "c_key")
    both = looked.drop("words", "begun", "spelled").join(more, looked.doc_id.eqNullSafe(more.of_id) & (looked.text_key == more.of_key), "left")

    def plus(kept: str, added: str):  # rows of a repeated row share what the join summed over all of them
        return F.col(kept) + F.coalesce(F.col(added) / F.col("copies"), F.lit(0.0))
    return both.select("doc_id", "held_out", "n_tokens", F.round(plus("known", "known_more")).cast("long").alias("n_known"),
                       F.lit(total.n).cast("long").alias("train_tokens"), (plus("base", "base_more") / math.log(10)).alias("base_score"),
                       (plus("score", "score_more") / math.log(10)).alias("score"))
