"""Line dedup by winnowing, in DataFrame functions only.

A run is a stretch of consecutive lines with at least ``words`` words together: one
long line, or short lines with their neighbours. A line goes if it belongs to
a run that also stands earlier (smaller doc_id, or the same document further
up). Every such run is made up of least runs, which lose a run's words without
their first or without their last line; so least runs are windows.

Lines with a word are hashed, and of every window the smallest hash (the first
of equals) is its fingerprint: two places that share a run share windows, and
with them fingerprints at the same offset. Fingerprints that stand at two places
or more are joined to their windows, which reach both ways as far as a run
through the fingerprint can; each window is compared by 128 bits with its
earliest place, and the windows found make up the maximal match.

Counts and earliest places are grouped aggregates (combined before the
shuffle) joined back, so a line that a third of all documents share is never
gathered in one group. Arrays are bound once before they are indexed, so time is
linear in a document's lines.

Defined cases: lines without a word are kept and don't interrupt a run; fewer
than ``words`` words: unchanged; null text stays null; documents with a null doc_id
count as later than all others; rows that repeat doc_id and text get the same
decision and don't count as copies of each other; an empty table gives no rows.
Only ``doc_id`` and ``text`` are read, other columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import materialize

WORDS = 13
WORD = r"[^\\x20\\x09-\\x0D]"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``value`` evaluated once, as ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _reach(lines: str, words: int) -> str:
    """SQL of (n, s): the least number of leading lines that have ``words`` words, and their
    words; s is smaller where all lines together have fewer."""
    return f"aggregate({lines}, struct(0 AS n, 0L AS s), (r, x) -> if(r.s >= {words}, r, struct(r.n + 1 AS n, r.s + x.w AS s)))"


def windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, fingerprint, at (its line), key_a, key_b (128 bits of the content), lines
    (indices): every least run of every document."""
    hashed = rf"""transform(filter(transform(split(text, '\n', -1), (line, i) -> struct(i, line)), x -> x.line rlike '{WORD}'),
        x -> struct(xxhash64(x.line) AS a, x.i AS i, xxhash64(1, x.line) AS b, cast(regexp_count(x.line, '{WORD}+') AS bigint) AS w))"""
    after = _let("s", f"slice(h, k + 1, {words})", _let("r", _reach("s", words), f"if(r.s >= {words}, slice(s, 1, r.n), null)"))
    # A run that ends in line k and would still have enough words without it begins with the same line as a shorter one.
    before = _let("s", f"reverse(slice(h, greatest(1, k + 2 - {words}), least(k + 1, {words})))", _let(
        "r", _reach("s", words), f"if(r.s >= {words} AND r.s - s[0].w >= {words}, reverse(slice(s, 1, r.n)), null)"))
    each = f"flatten(transform(sequence(0, size(h) - 1), k -> array({after}, {before})))"
    found = _let("h", hashed, f"if(size(h) > 0, filter({each}, x -> x is not null), null)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.expr(found).alias("found"))
    # The outer form and the late filter keep Spark from computing the arrays once more to drop rows without any.
    each = rows.select("doc_id", "text_key", F.explode_outer("found").alias("x")).filter("x is not null")
    return each.select("doc_id", "text_key", F.expr("array_min(x).a AS fingerprint"), F.expr("array_min(x).i AS at"),
                       F.xxhash64("x.a").alias("key_a"), F.xxhash64(F.lit(1), F.col("x.b")).alias("key_b"), F.col("x.i").alias("lines"))


def later_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, gone (indices of the lines to delete), for documents with any."""
    found = materialize(windows(docs, words), "line_windows")
    place = F.xxhash64("doc_id", "text_key", "at")
    repeated = found.groupBy("fingerprint").agg(F.min(place).alias("p"), F.max(place).alias("q")).filter("p < q").select("fingerprint")
    runs = found.join(repeated, "fingerprint", "left_semi").select(
        "key_a", "key_b", "lines", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", F.expr("lines[0]").alias("line")).alias("place"))
    runs = materialize(runs, "line_runs")
    first = runs.groupBy("key_a", "key_b").agg(F.min("place").alias("first"), F.max("place").alias("last")) \
        .filter("first < last").select("key_a", "key_b", "first")
    return runs.join(first, ["key_a", "key_b"]).filter("place > first").groupBy("place.doc_id", "place.text_key") \
        .agg(F.expr("array_distinct(flatten(collect_set(lines)))").alias("gone"))


def _cut(docs: DataFrame, words: int) -> DataFrame:
    """_doc (the row as a struct), _text (cut), _lines, _removed."""
    gone = later_lines(docs, words).select(F.col("doc_id").alias("_of_id"), F.col("text_key").alias("_of_key"), F.col("gone").alias("_gone"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    both = rows.join(gone, F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("_of_id")) & (F.xxhash64("_doc.text") == F.col("_of_key")), "left")
    kept = _let("l", r"split(_doc.text, '\n', -1)", "array_join(transform(array_except(sequence(0, size(l) - 1), _gone), i -> l[i]), '\\n')")
    n = F.when(F.col("_doc.text").isNull(), 0).otherwise(F.length("_doc.text") - F.length(F.translate("_doc.text", "\n", "")) + 1)
    return both.select("_doc", F.when(F.col("_gone").isNull(), F.col("_doc.text")).otherwise(F.expr(kept)).alias("_text"),
                       n.cast("long").alias("_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_removed"))


def line_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents' own columns with ``text`` cut; n_chars, where there is one, follows the text."""
    def column(c: str) -> Column:
        if c == "text":
            return F.col("_text").alias(c)
        if c == "n_chars":
            return F.length("_text").cast(docs.schema[c].dataType).alias(c)
        return F.col("_doc")[c].alias(c)
    return _cut(docs, words).select(*[column(c) for c in docs.columns])


def line_report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays, one row per input row."""
    return _cut(docs, words).select(F.col("_doc.doc_id").alias("doc_id"), F.col("_lines").alias("n_lines"),
                                    F.col("_removed").alias("n_removed"), F.col("_text").alias("text"))
