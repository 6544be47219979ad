"""Exact dedup by progressive refinement, in DataFrame functions only.

Texts are grouped by their length in bytes, those of lengths that occur twice
by a hash of their first ``PREFIX`` bytes, and only those of groups that are
still shared are read whole, for a SHA-256 that decides. The first pass over the
texts writes length and prefix hash of every row (16 bytes); both groupings are
counts over that table, combined before the shuffle. The second pass hashes
whole texts of surviving groups only.

What survives a grouping is handed on as a bit filter over hashed keys, so that
texts never travel to a join: ``FILTER_WORDS`` words of 64 bits, the proven bound
of what is broadcast. A filter lets a few keys of single texts pass (most of
them once some million keys survive); they are only hashed for nothing, as the
exact counts follow. Nothing is lost.

Rows of hot groups are joined by broadcast (``with_groups``) and never meet in one task.

Defined cases: null text is empty, and equal to other empty ones; a null doc_id
gives way to any other; rows that repeat doc_id and text are copies of each
other, one of them stays; an empty table gives no rows; very long texts are
hashed as any. Only ``doc_id`` and ``text`` are read, other columns pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import materialize, with_groups

PREFIX = 64
FILTER_WORDS = 1 << 17


def _bit(keys: list[Column], words: int) -> tuple[Column, Column]:
    """Word and bit of a key in a filter of ``words`` words."""
    place = F.pmod(F.xxhash64(*keys), F.lit(words * 64).cast("long"))
    return F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def key_filter(keys: DataFrame, columns: list[str], words: int = FILTER_WORDS) -> DataFrame:
    """The keys as a bit filter: at most ``words`` rows (_word, _bits)."""
    word, bit = _bit([F.col(c) for c in columns], words)
    return keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def flagged(df: DataFrame, keys: list[Column], bits: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """``df`` with _maybe: false where the key is surely not in the filter."""
    word, bit = _bit(keys, words)
    found = df.withColumns({"_at": word, "_bit": bit}).join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    return found.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))) \
        .drop("_at", "_bit", "_word", "_bits")


def exact_groups(docs: DataFrame, normalise: Callable[[Column], Column] = lambda text: text, all_digests: bool = False) -> DataFrame:
    """doc_id, text_digest (SHA-256, hex, of the normalised text), keep_id, group_size,
    kept: one row per input row. Single texts that no longer share a group after
    the prefixes aren't read whole and have no digest, unless ``all_digests``."""
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("body"))
    rows = rows.select("doc_id", "body", F.octet_length("body").alias("n"), F.xxhash64(F.substring("body", 1, PREFIX)).alias("prefix"))
    slim = materialize(rows.select("n", "prefix"), "text_prefixes")
    lengths = slim.groupBy("n").agg(F.count("*").alias("c")).filter("c > 1")
    by_length = flagged(slim, [F.col("n")], key_filter(lengths, ["n"])).filter("_maybe")
    shared = by_length.groupBy("n", "prefix").agg(F.count("*").alias("c")).filter("c > 1")
    digest = F.sha2("body", 256)
    marked = flagged(rows, [F.col("n"), F.col("prefix")], key_filter(shared, ["n", "prefix"])).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("_maybe").alias("read"),
        (digest if all_digests else F.when(F.col("_maybe"), digest)).alias("text_digest"))
    marked = materialize(marked, "text_digests")  # written once, so row numbers stay
    read = marked.filter("read")
    groups = read.groupBy("text_digest").agg(
        F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", (-F.col("row")).alias("nth"))).alias("stays"),
        F.count("*").alias("group_size")).filter("group_size > 1")
    groups = materialize(groups.select("text_digest", F.col("stays.doc_id").alias("keep_id"), (-F.col("stays.nth")).alias("_stays"),
                                       "group_size"), "text_groups")
    # Digests surely in no group are single and stay in place; the others are joined.
    split = flagged(marked, [F.col("text_digest")], key_filter(groups, ["text_digest"])).withColumn("_maybe", F.col("read") & F.col("_maybe"))
    total = marked.agg(F.count("*")).first()[0]
    joined = with_groups(split.filter("_maybe"), groups, "text_digest", "group_size", total)
    return joined.unionByName(split.filter("NOT _maybe"), allowMissingColumns=True).select(
        "doc_id", "text_digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("_stays"), F.lit(True)).alias("kept"))


def exact_dedup(docs: DataFrame, normalise: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """The rows that stay, with all columns. Only rows whose doc_id may belong to a
    dropped one travel to the join that decides; the others pass in place."""
    groups = materialize(exact_groups(docs, normalise), "exact_groups")
    work = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    of_id, of_text = F.col("_doc")["doc_id"].cast("long"), normalise(F.coalesce(F.col("_doc")["text"], F.lit("")))
    split = flagged(work, [of_id], key_filter(groups.filter("NOT kept"), ["doc_id"]))
    gone = groups.filter("group_size > 1").groupBy(F.col("doc_id").alias("_of_id"), F.col("text_digest").alias("_of_digest")).agg(
        F.bool_or("kept").alias("_one_stays"), F.bool_or(~F.col("kept")).alias("_lost")).filter("_lost")
    asked = split.filter("_maybe").withColumns({"_id": of_id, "_digest": F.sha2(of_text.cast("binary"), 256)})
    found = asked.join(gone, F.col("_id").eqNullSafe(F.col("_of_id")) & (F.col("_digest") == F.col("_of_digest")), "left")
    stay = split.filter("NOT _maybe").select("_doc").unionAll(found.filter("_of_digest IS NULL").select("_doc")).unionAll(
        found.filter("_one_stays").groupBy("_id", "_digest").agg(F.first("_doc").alias("_doc")).select("_doc"))
    return stay.select("_doc.*")
