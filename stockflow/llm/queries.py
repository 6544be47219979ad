"""The operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm import (decontam, exact_dedup, fill_middle, hard_negatives, line_dedup, lm_scoring, packing, quality, simhash,
                           substring_dedup, suffix_dedup, url_filter, warc)
from stockflow.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document; runs of 13 words or more that stand earlier are deleted."""
    return line_dedup.line_report(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words that start in an earlier document are removed."""
    return substring_dedup.substring_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at up to 2 bits."""
    return simhash.simhash_groups(documents(spark, sf_dir), 3, 2)


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048)


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


@query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and which."""
    return decontam.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# The rules of the contract (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by rule, else by the trees."""
    return url_filter.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


@query("op7_warc")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the attention model and the unigram base."""
    return lm_scoring.lm_scores(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by repeated strings of 400 bytes are removed; what stays, as text
    (a character cut in two shows as a replacement character)."""
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir), 400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


@query("op12_exact_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and which of its exact copies stays."""
    return exact_dedup.exact_groups(documents(spark, sf_dir), all_digests=True).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("text_digest").alias("text_sha256"))


@query("op11_fill_in_middle")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and put in another order, and restored."""
    df = fill_middle.fill_in_middle(documents(spark, sf_dir))
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                     F.sha2(fill_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


@query("op13_hard_negatives")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For one vector in a hundred, hard negatives of its five best positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


# ---- the same in DuckDB SQL, where it can express it

ORACLE_SQL["op1_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents where text is not null),
worded as (
  select doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w, row_number() over (partition by doc_id order by i) as k
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
total as (
  select doc_id, k, line, sum(w) over (partition by doc_id order by k) as upto, w from worded),
runs as (
  select a.doc_id, a.k as from_k, b.k as to_k
  from total a join total b on a.doc_id = b.doc_id and b.k between a.k and a.k + 12 and b.upto - a.upto + a.w >= 13
    and (b.upto - a.upto + a.w - b.w < 13 or b.upto - a.upto < 13)),
ranked as (
  select r.doc_id, from_k, to_k, row_number() over (partition by list(t.line order by t.k) order by r.doc_id, from_k) as place
  from runs r join total t on t.doc_id = r.doc_id and t.k between from_k and to_k group by r.doc_id, from_k, to_k),
gone as (
  select distinct w.doc_id, w.i from ranked r join worded w on w.doc_id = r.doc_id and w.k between r.from_k and r.to_k where r.place > 1),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.i) as n_removed,
    coalesce(string_agg(l.line, chr(10) order by l.i) filter (where g.i is null), '') as text
  from lines l left join gone g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed, sha256(k.text) as kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id
"""

ORACLE_SQL["op2_substring_dedup"] = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as s
  from (select doc_id, w, unnest(range(1, cast(len(w) as bigint) - 11)) as i from words where len(w) >= 13)),
later as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as first from windows) where doc_id > first),
gone as (
  select distinct doc_id, i + o as i from (select doc_id, i, unnest(range(0, 13)) as o from later)),
each as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from words),
kept as (
  select e.doc_id, count(g.i) as n_removed, coalesce(string_agg(e.word, ' ' order by e.i) filter (where g.i is null), '') as text
  from each e left join gone g on g.doc_id = e.doc_id and g.i = e.i group by e.doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from words w left join kept k on k.doc_id = w.doc_id
"""

ORACLE_SQL["op7_warc"] = """
with p as (select page_id, coalesce(html, '') as h from pages),
r as (select page_id, strlen(h) as n, sha256(h) as digest, min(page_id) over (partition by h) as first from p)
select page_id, n as payload_bytes, digest as payload_digest,
  case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id > first then first end as refers_to
from r
"""

ORACLE_SQL["op12_exact_dedup"] = """
with t as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from t window w as (partition by t)
"""

ORACLE_SQL["op11_fill_in_middle"] = """
with t as (select doc_id, coalesce(text, '') as t, sha256('1:' || cast(doc_id as varchar)) as h from documents),
d as (
  select doc_id, t, cast(length(t) as bigint) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
    cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from t),
c as (
  select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""

ORACLE_SQL["op13_hard_negatives"] = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (
  select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as rank,
    other_id as negative_id, positive_score, score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
