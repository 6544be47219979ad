"""Each operator against its brute-force version, on a small table with null, empty,
blank, repeated, near-equal and long texts, ties and an extra clashing column."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import sys, os  # noqa: E401
sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from stockflow.llm import (bpe, common, decontam, line_dedup, lm_scoring, packing, quality, simhash, substring_dedup,  # noqa: E402
                           suffix_dedup, url_filter, warc)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, part int"
SF = "/root/testdata/sf0.001"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["re", "ti", "on", "és", "la", "Th"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    shared = sentence(rng, 70)
    block = "\n".join(sentence(rng, 8) for _ in range(5))
    rows = [(i, sentence(rng, rng.randint(5, 120))) for i in range(30)]
    rows += [(100 + i, sentence(rng, 20) + " " + shared + "\n" + sentence(rng, 15)) for i in range(8)]
    rows += [(200 + i, sentence(rng, 9) + "\n" + block + "\n" + sentence(rng, 4)) for i in range(6)]
    rows += [(300 + i, rows[3][1]) for i in range(5)]                       # exact copies
    rows += [(310 + i, rows[34][1] + " x" * (i + 1)) for i in range(5)]     # near copies
    rows += [(400, ""), (401, None), (402, " \t\n "), (403, "one"), (404, "Two\x0bwords"), (405, None), (406, ""),
             (407, "a" * 900), (408, "ab " * 400), (409, "no\u00a0break #*$ a's <|endoftext|> caf\u0301 日本 " * 3),
             (410, sentence(rng, 6000)), (411, "x\n\n\nx\n\nx\nx\nx\nx")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(d, t, ["en", "fr", None][d % 3], "s", len(t or ""), "clash", 1) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_line_dedup(docs, rows, empty):
    report = line_dedup.line_report(docs)
    assert got(report, "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256)) == brute.lines(rows)
    df = line_dedup.line_dedup(docs)
    assert df.columns == docs.columns and got(df, "doc_id", "text") == got(report, "doc_id", "text")
    assert df.filter("n_chars != length(text)").count() == 0
    assert line_dedup.line_dedup(empty).count() == 0 and line_dedup.line_report(empty).count() == 0


def test_line_dedup_measures_runs_by_words(spark):
    rng = random.Random(12)
    line = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(n))
    pool = [line(n) for n in (1, 1, 2, 3, 4, 5, 6, 12, 13, 14, 30)]
    rows = [(i, "\n".join(rng.choice(pool + ["", " "]) if rng.random() < 0.9 else line(rng.randint(1, 9)) for _ in range(rng.randint(1, 30)))) for i in range(120)]
    rows += [(900, pool[8]), (901, pool[8]), (902, pool[7]), (903, pool[7])]
    df = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    out = got(df, "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256))
    assert out == brute.lines(rows)
    removed = {r[0]: r[2] for r in out}
    assert removed[901] == 1 and removed[903] == 0      # 13 words are a run by themselves, 12 aren't


def test_line_dedup_repeated_rows_and_null_ids(spark):
    text = "a b c d e\nc d e f g\ne f g h"
    df = line_dedup.line_report(spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.n_removed) for r in df.collect()) == [("1", 0), ("1", 0), ("2", 3), ("None", 3)]


def test_line_dedup_passes_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    names = ["_lines", "_removed", "_gone", "_doc", "_of_id", "_of_key", "l", "h", "lines", "place", "found", "at"]
    rows = [(i, text, *range(100, 100 + len(names))) for i in (1, 2)]
    df = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)))
    assert df.columns == ["doc_id", "text", *names]
    assert sorted(tuple(r) for r in df.collect()) == [(1, text, *rows[0][2:]), (2, "", *rows[0][2:])]


def test_line_dedup_takes_long_documents_in_linear_time(spark):
    import time
    text = "\n".join(f"line {i} of many in one text" for i in range(64_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    began = time.time()
    assert [(r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.line_report(df).orderBy("doc_id").collect()] == [(1, 64_000, 0), (2, 64_000, 64_000)]
    assert time.time() - began < 60


def test_substring_dedup(docs, rows, empty):
    df = substring_dedup.substring_dedup(docs)
    assert got(df, "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)) == brute.substring(rows)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_loses_nothing_in_a_full_sketch(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MAX_LOG_CELLS", 6)   # all windows are estimated repeated
    monkeypatch.setattr(substring_dedup, "MIN_LOG_CELLS", 6)
    monkeypatch.setattr(substring_dedup, "WORDS_PER_GROUP", 500)
    df = substring_dedup.substring_dedup(docs)
    assert got(df, "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)) == brute.substring(rows)


def test_simhash(docs, rows, empty):
    assert got(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == brute.simhash(rows)
    assert simhash.simhash_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute.simhash(rows)}) and kept.columns == docs.columns


def test_simhash_keeps_one_whatever_the_columns_are_called(spark):
    df = spark.createDataFrame([(7, "a b c d", 1, 2, 3), (9, "a b c d", 4, 5, 6)], "doc_id long, text string, kept_rows int, kept_id int, component_id int")
    assert [tuple(r) for r in simhash.keep_one(df).collect()] == [(7, "a b c d", 1, 2, 3)]


def test_simhash_keeps_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (9, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(df).collect()] == [7]


def test_spanning_links_connect_like_all_pairs():
    rng = random.Random(3)
    for size in (5, 60, 400):
        values = sorted({rng.getrandbits(48) // (1 << 40) | rng.getrandbits(10) for _ in range(size)})
        links = simhash.spanning_links(values, 2)
        assert all((a ^ b).bit_count() <= 2 for a, b in links)

        def classes(pairs):
            root = {v: v for v in values}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x
            for a, b in pairs:
                a, b = sorted((find(a), find(b)))
                root[b] = a
            return {v: find(v) for v in values}
        assert classes(links) == classes([(a, b) for a in values for b in values if (a ^ b).bit_count() <= 2])


def test_connected_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)]
    out = dict(got(common.connected_components(spark.createDataFrame(edges, "a long, b long"), "t"), "node", "root"))
    assert out == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 130), 100)}


def test_gap_coding_round_trip():
    for values in ([], [0], [0, 0, 254, 255, 256, 5000, 5000], sorted(random.Random(1).choices(range(10 ** 6), k=999))):
        assert common.unpack_sorted(common.pack_sorted(np.array(values, np.int64))).tolist() == values


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_dedup(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    df = suffix_dedup.suffix_dedup(docs, 400)
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)) == brute.byte_windows(rows)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_dedup_deals_out_the_copies_of_a_text(spark, hot, monkeypatch):
    for name, value in (("HOT", hot), ("BUCKET", 1000), ("STRINGS", 1000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    text = sentence(random.Random(9), 400)
    data = [(i, text) for i in range(60)] + [(None, text), (60, text[:700]), (61, "short"), (62, text + " a" + text)]
    df = spark.createDataFrame(data + data[-1:], "doc_id long, text string").repartition(3)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        copies = suffix_dedup.repeated_spans(df).filter("doc_id < 60").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(copies) == 60 and all((r.starts, r.ends) == ([0], [len(text.encode())]) for r in copies)
    assert len({r.task for r in copies}) > 1
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(df).collect())
    assert len(out) == 65 and all(removed == (0 if d == 61 else size) for d, size, removed in out)


def test_suffix_order_against_sorting():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, 300)
    first = np.array([0, 90, 91, 200])
    end = np.array([90, 91, 200, 300])
    where, lcp = suffix_dedup.suffix_order(data, np.stack([first, end]), 1)
    ends = {i: e for f, e in zip(first, end) for i in range(f, e)}
    suffixes = [tuple(data[i:ends[i]]) for i in where]
    assert suffixes == sorted(suffixes) and sorted(where.tolist()) == list(range(300))
    common_ = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:])]
    assert lcp[1:].tolist() == common_


def test_subword_ids_equal_the_library():
    words = sorted({w for _, t in make_rows() for w in brute.words(t)} | {"it's".encode(), "ÀÉÎß²½a1b22!!--".encode(), b"aaaaaaaaa", "İ".encode()})
    for name, ends in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        e = bpe.WordEncoder(public_tokenizers.path(name), word_ends=ends)
        ids, begin = e.encode(words, block=7)
        for i, w in enumerate(words):
            assert e.library.encode(("" if ends else " ") + w.decode(), add_special_tokens=False).ids == ids[begin[i]:begin[i + 1]].tolist(), w


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.best_fit_packing(docs, path).toPandas()
    assert set(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == {
        (*k, *v) for k, v in brute.pieces(rows, Tokenizer.from_file(path)).items()}
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset == g.length.cumsum() - g.length).all()
    assert out.sequence_id.nunique() <= out.lower_bound.iloc[0] + 1
    assert packing.best_fit_packing(empty, path).count() == 0


def test_packing_bound_and_rounds(spark):
    assert packing.lower_bound(np.array([60] * 10), 100) == 10 and packing.lower_bound(np.array([34] * 9), 100) == 5
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(400)]
    bins = packing.best_fit_decreasing(sizes, 100)
    load = Counter()
    for s, b in zip(sizes, bins):
        load[b] += s
    assert max(load.values()) <= 100 and packing.lower_bound(np.array(sizes), 100) <= len(load)
    rows = spark.createDataFrame([(i, 0, 0, s, 0, zlib.crc32(str(i).encode())) for i, s in enumerate(sizes)], packing.PIECES)
    out = packing.pack(rows, 100, rounds=3, group=20).toPandas()   # many small groups exchange what they can't fill
    assert len(out) == 400 and out.groupby("sequence_id").length.sum().max() <= 100
    assert out.sequence_id.nunique() <= 1.1 * len(load)


def test_quality_base_counts(docs, rows, empty):
    out = quality.quality_rules(docs)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got(out, *columns) == brute.quality(rows)
    assert out.filter("kept and base_failed").count() == 0 and quality.quality_rules(empty).count() == 0
    kept = quality.keep_good(docs)
    assert got(kept, "doc_id") == got(out.filter("kept"), "doc_id") and kept.columns == docs.columns


def test_kneser_ney_is_a_distribution_and_survives_the_sorted_arrays():
    rng = np.random.default_rng(1)
    counts = np.zeros(quality.SYMBOLS ** 4, np.int64)
    np.add.at(counts, rng.integers(0, 32, 5000) ** 2 % 32 * 32 ** 3 + rng.integers(0, 32 ** 3, 5000), 1)
    arrays = quality.kneser_ney(counts)
    assert all((np.diff(a[0].astype(np.int64)) > 0).all() for a in arrays)
    table = quality.lookup_table(arrays).reshape(-1, 32)
    assert np.allclose((10.0 ** table).sum(axis=1), 1, atol=1e-3)


def test_quality_rejects_what_the_language_does_not_do(spark):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice(["re", "ti", "on", "la"]) for _ in range(rng.randint(1, 4))) for _ in range(90))
    data = [(i, text(), "en") for i in range(60)] + [(99, " ".join("".join(rng.choice("zqxkjv#@0") for _ in range(6)) for _ in range(90)), "en")]
    out = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert not out[99] and sum(out[i] for i in range(60)) >= 59


def test_quality_bands_reject_planted_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").filter("lang = 'en' and doc_id < 5000")
    plain = docs.filter("length(text) between 1200 and 9000 and not text rlike '[|#*$%&<>]|!!'").orderBy("doc_id").limit(6).collect()
    junk = [lambda w: " ".join(x + "!!" for x in w), lambda w: " ".join(x + "***" for x in w), lambda w: " ".join((x + " ") * 4 for x in w),
            lambda w: "\n".join("| " + " | ".join(w[i:i + 3]) + " |" for i in range(0, len(w), 3))]
    planted = [(10 ** 6 * (k + 1) + r.doc_id, f(r.text.split()), "en") for k, f in enumerate(junk) for r in plain]
    out = quality.quality_rules(docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string")))
    rows_ = {r.doc_id: r for r in out.filter(F.col("doc_id").isin([r.doc_id for r in plain] + [d for d, _, _ in planted])).collect()}
    assert [d for d, _, _ in planted if rows_[d].kept] == []
    assert sum(not rows_[d].base_failed for d, _, _ in planted) >= 12 and sum(rows_[r.doc_id].kept for r in plain) >= 5


def test_quality_judges_the_neighbours_of_a_blank_text(spark):
    rng = random.Random(8)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(90))
    data = [(i, text("aeioltnr"), "en") for i in range(60)] + [(99, text("zqxkjv#@0"), "en"), (100, " \n", "en"), (101, "\u00a0", "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").coalesce(1)
    out = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert not out[99].kept and [d for d, r in out.items() if r.log_perplexity is None] == [100, 101]


def test_quality_back_off_by_search_equals_all_orders_written_out():
    rng = np.random.default_rng(4)
    counts = np.zeros(quality.SYMBOLS ** 4, np.int64)
    np.add.at(counts, rng.integers(0, 32 ** 4, 3000), 1)
    arrays = quality.kneser_ney(counts)
    known = [dict(zip(a[0].tolist(), zip(a[1].tolist(), a[2].tolist()))) for a in arrays]

    def plain(code: int, k: int) -> float:
        if k == 0:
            return known[0][0][0]
        code %= 32 ** k
        return known[k][code][0] if code in known[k] else known[k - 1].get(code // 32, (0, 0.0))[1] + plain(code, k - 1)

    codes = np.concatenate([np.flatnonzero(counts)[:500], rng.integers(0, 32 ** 4, 2000)])
    assert np.allclose(quality.log_prob(arrays, codes), [plain(int(c), 4) for c in codes])


def test_quality_tells_all_letters_of_a_script_apart(spark):
    rng = random.Random(9)
    common = [chr(0x4E00 + i) for i in range(300)]
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(120))
    data = [(i, text(common), "zh") for i in range(80)] + [(99, text([chr(0x7000 + i) for i in range(3000)]), "zh")]
    out = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert not out[99] and sum(out[i] for i in range(80)) >= 77
    symbols = quality.Symbols({"zh": [0x4E00], quality.SHARED: []})
    assert symbols.of("zh", "\u4e00 \u4e01\u9fff".encode()).tolist() == [0, 0, 0, 1, 0, 28, 0, 19, 16, 1, 28, 1, 7, 31, 31, 0]


def test_quality_languages_in_parts_score_as_in_one(spark, monkeypatch):
    rng = random.Random(10)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
    data = [(10 * k + i, text("abcdefghijklmnopqrst"[k:k + 9]), f"l{k}") for k in range(7) for i in range(6)] + [(900, text("xyz"), "few"), (901, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    monkeypatch.setattr(quality, "OWN", 1000)
    columns = ["doc_id", "lang", "log_perplexity", "kept"]
    whole = got(quality.quality_rules(df), *columns)
    monkeypatch.setattr(quality, "LANGUAGES", 3)
    assert len(list(quality.language_parts(quality._with_language(df)))) == 3
    assert got(quality.quality_rules(df), *columns) == whole and len(whole) == len(data)


def test_quality_counts_every_ngram_of_many_languages(spark, monkeypatch):
    monkeypatch.setattr(quality, "OWN", 1)
    rng = random.Random(11)
    rows = [(i, sentence(rng, 30), f"l{i % 20}") for i in range(200)] + [(200, None, "l0"), (201, "", "l1"), (202, "日本語 Ωmega", "l2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    monkeypatch.setattr(quality, "per_batch", lambda f, schema: common.per_batch(f, schema, 1000))
    (part, letters), = quality.language_parts(quality._with_language(docs))
    assert len(letters) == 21   # a model each, more than a task adds up at a time
    symbols, want = quality.Symbols(letters), Counter()
    for _, text, lang in rows:
        if text:
            s = symbols.of(lang, text.encode()).tolist()
            want.update((lang, ((a * 32 + b) * 32 + c) * 32 + d) for a, b, c, d in zip(s, s[1:], s[2:], s[3:]))
    got = {(r.lang, r.code): r.n for r in quality.count_ngrams(part, letters).collect()}
    assert got == want


def test_quality_band_join_deals_out_a_language(spark):
    df = spark.createDataFrame([(i, f"word{i} and more", "en") for i in range(200)], "doc_id long, text string, lang string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = quality.quality_rules(df, least_words=1).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(out) == 200 and len({r.task for r in out}) > 1 and len({(r.lower, r.upper) for r in out}) == 1


def test_decontamination(spark, docs, empty):
    rng = random.Random(11)
    items = [(i, sentence(rng, 18) + ". " + sentence(rng, 9) + ".") for i in range(30)] + [(90, None), (91, ""), (92, "..."), (None, "x"), (3, "short one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    data = [(1, sentence(rng, 300)), (2, sentence(rng, 80) + " " + items[4][1] + " " + sentence(rng, 200)),
            (3, items[5][1].upper().replace(".", " !")), (4, " ".join(items[6][1].split()[:12])), (5, None), (6, ""), (None, items[4][1]),
            (7, items[8][1].split(". ")[0] + ". " + sentence(rng, 9)), (2, sentence(rng, 5))]
    found = spark.createDataFrame(data, "doc_id long, text string")
    out = decontam.matches(found, bench)
    assert got(out, "doc_id", "item_id") == {(2, 4), (3, 5)}
    assert sorted(r.doc_id or 0 for r in decontam.clean(found, bench).collect()) == [0, 1, 4, 5, 6, 7]
    assert decontam.matches(empty, bench).count() == 0 and decontam.matches(found, bench.limit(0)).count() == 0


def test_decontamination_equals_brute_force_in_any_shards(spark, monkeypatch):
    rng = random.Random(21)
    items = [(i, sentence(rng, rng.randint(3, 25)) + ". " + sentence(rng, rng.randint(1, 12)) + "?") for i in range(60)]
    items += [(5, items[7][1]), (61, "one single sentence of an item without an end"), (62, "tiny"), (63, "!!"), (None, "x y"), (64, None)]
    known = [t for _, t in items[:60]]
    data = []
    for d in range(70):
        parts = [sentence(rng, rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(known)
            parts += [rng.choice([t, t.upper(), " ".join(t.split()[:-2]), " ".join(reversed(t.split())), "tiny"]), sentence(rng, rng.randint(0, 60))]
        data.append((d, " ".join(parts)))
    data += [(3, known[9]), (None, known[9]), (200, None), (201, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    want = brute.contaminated(data, items)
    for shard, together in ((20_000, 8), (7, 3)):
        monkeypatch.setattr(decontam, "SHARD", shard)
        monkeypatch.setattr(decontam, "TOGETHER", together)
        rows = decontam.matches(docs, bench).collect()
        assert {(r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap, r.start_word) for r in rows} == want and len(rows) == len(want)
    assert len(want) > 40


def test_retrieval_equals_scoring_every_item():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    index = decontam.Index([(i, " ".join(rng.choices(vocabulary[:8] * 5 + vocabulary, k=12))) for i in range(150)], 0.5)
    pairs = sorted({(p, index.term[w]) for p in range(40) for w in rng.choices(vocabulary, k=25) if w in index.term})
    passage, term = (np.array(x) for x in zip(*pairs))
    p, i, s = index.retrieve(passage, term)
    exact = Counter()
    for a, t in pairs:
        for k in range(index.begin[t], index.begin[t + 1]):
            exact[a, int(index.post_item[k])] += index.post_weight[k]
    assert {(a, b) for a, b in zip(p.tolist(), i.tolist())} == {k for k, v in exact.items() if v >= 0.5 - 1e-9}


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_url_filter(spark):
    urls = {1: "http://A.Example.com/en/1?x=1&y", 2: "https://www.example.com/en/", 3: "http://b.net/es/?q", 4: "http://b.net/de/1", 5: None,
            6: "no url", 7: "http://notexample.com/en/1", 8: "ftp://x.com", 9: "http://com/#/en/", 10: "http://example.com/en"}
    df = spark.createDataFrame([(k, v, 1) for k, v in urls.items()], "page_id long, url string, host int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df, RULES).collect()}
    assert out[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert out[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert out[3] == ("b.net", "/es/", "net/es/", "block") and out[4][:3] == ("b.net", "/de/1", None)
    assert out[5][:3] == out[6][:3] == ("", "", None) and out[7][2] == "com/" and out[8][:3] == ("x.com", "", None)
    assert out[9][:3] == ("com", "/", "com/") and out[10][2:] == ("com/", "allow")
    assert all(v[3] in ("allow", "block") for v in out.values())
    only = url_filter.url_filter(df.filter("page_id = 2"), RULES)
    assert [r.verdict for r in only.collect()] == ["allow"] and url_filter.url_filter(df.limit(0), RULES).count() == 0


def test_url_filter_learns_from_labelled_urls(spark):
    rng = random.Random(4)
    data = [(i, f"http://{'9' * 12 if i % 2 else 'abc'}{i}.{'net/es' if i % 2 else 'com'}/{'1' * 20 if i % 2 else 'page'}") for i in range(300)]
    data += [(1000 + i, f"http://{'9' * 12 if i % 2 else 'abc'}{rng.randint(0, 99)}.org/{'1' * 20 if i % 2 else 'page'}") for i in range(60)]
    df = spark.createDataFrame(data, "page_id long, url string")
    rules = [("allow", "com", "/"), ("block", "net", "/es/")]
    out = url_filter.url_filter(df, rules).filter("rule is null").collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in out) >= 55


def test_url_filter_is_measured_on_hosts_it_has_not_seen(spark):
    rows = [(i, f"http://h{i % 97}.{'bad' if i % 97 < 40 else 'good'}/{'x' * (i % 7)}/{i}") for i in range(1500)]
    rules = [("block", "bad", "/"), ("allow", "good", "/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = {(r.label, r.prediction): r.n for r in url_filter.held_out(pages, rules).collect()}
    assert sum(out.values()) > 100 and sum(n for (a, b), n in out.items() if a == b) == sum(out.values())
    without = {(r.label, r.prediction): r.n for r in url_filter.held_out(pages, rules, ["path_length", "depth"]).collect()}
    assert sum(n for (a, b), n in without.items() if a == b) < sum(without.values()) == sum(out.values())
    assert url_filter.held_out(pages, rules[:1]).count() == 0


def test_url_filter_counts_suffixes_of_all_labelled_urls(spark):
    rules = [(kind, f"b.{letter}{k:02d}", "/") for kind, letter in (("block", "s"), ("allow", "t")) for k in range(30)]
    data = [(i, f"http://b.{'st'[i % 2]}{i // 2 % 30:02d}/p") for i in range(360)]
    data += [(1000 + i, f"http://c.{'st'[i % 2]}{i // 2:02d}/p") for i in range(60)]
    out = url_filter.url_filter(spark.createDataFrame(data, "page_id long, url string"), rules, sample=40).filter("rule is null").collect()
    assert {(r.page_id, r.verdict) for r in out} == {(1000 + i, ("block", "allow")[i % 2]) for i in range(60)}


def test_warc_round_trip(spark):
    big = "é<p>" * 400
    data = [(5, "http://a.com/x", big), (2, "http://b.com/", big), (9, None, big), (1, "http://a.com/x", None), (3, "u://\r\nq", ""), (4, "http://z.org/", "s"),
            (6, "http://z.org/", "s"), (7, "http://a.com/w", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\n" * 4), (2, "http://b.com/", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, value string")
    out = warc.archive(pages).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in out) == sorted(
        (p, len((h or "").encode()), brute.sha((h or "").encode()), *(("revisit", 2) if h == big and p != 2 else ("response", 0))) for p, _, h in data)
    keys = [(r.url_key, r.captured, r.page_id) for r in out]
    assert keys == sorted(keys) and warc.archive(pages.limit(0)).count() == 0


def test_warc_takes_any_page_id(spark, monkeypatch):
    ids = [10 ** 15, 2 ** 63 - 1, -1, -2 ** 63, 0, 1, 253_402_300_799, 253_402_300_800, None]
    pages = spark.createDataFrame([(i, "http://a.com/x", "p" * k) for k, i in enumerate(ids)], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "CAPTURES", 2)
    out = warc.archive(pages).collect()
    assert [r.page_id for r in out] == [None] + sorted(i for i in ids if i is not None) or out[0].page_id < 0
    keys = [(r.captured, r.page_id is not None, r.page_id or 0) for r in out]
    assert keys == sorted(keys) and sorted(len(r.captured) for r in out) == [20] * len(ids)
    assert [r.page_id for r in out if r.page_id is not None] == sorted(i for i in ids if i is not None)


def test_warc_records_from_pieces_of_any_size():
    bodies = [b"", b"\r\n", b"\r\n\r\n", b"x\r\n\r\nWARC/1.1\r\n\r\n", b"y" * 5000, b"\r", b"z\r\n\r"]
    data = b"".join(b"WARC/1.1\r\nN: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(b), b) for i, b in enumerate(bodies))
    for size in (1, 3, 17, 4096, len(data)):
        reader, found = warc.Records(), []
        for k in range(0, len(data), size):
            found += reader.feed(data[k:k + size])
        reader.close()
        assert [r["payload"] for r in found] == bodies and [r["headers"]["N"] for r in found] == list(map(str, range(len(bodies))))
        assert [data[r["at"]:r["at"] + r["size"]].endswith(r["payload"] + b"\r\n\r\n") for r in found] == [True] * len(bodies)
    reader = warc.Records()
    assert not list(reader.feed(data[:-3])) or reader.held
    with pytest.raises(ValueError):
        reader.close()


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8, 13):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.merge_runs(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_lm_base_and_probability(spark, docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = {r.doc_id: r for r in lm_scoring.lm_scores(docs, path).collect()}
    tokens = {d: brute.words((t or "").encode().lower().decode()) + [None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    for d, ts in tokens.items():
        r = out[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ts), sum(c[w] > 0 for w in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts), rel_tol=1e-9) and r.score < 0
    assert lm_scoring.lm_scores(empty, path).count() == 0


def test_lm_beats_the_unigram_base_on_held_out_texts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    kinds = [["".join(rng.choice(list("aeiou" if k else "bdgkt"), 2)) + s for s in ("n", "ra", "lo", "mi")] for k in (0, 1) for _ in range(30)]
    half = [sum(kinds[:30], []), sum(kinds[30:], [])]
    texts = [(d, " ".join(rng.choice(half[d % 2], 60))) for d in range(300)]
    held = spark.createDataFrame(texts, "doc_id long, text string")
    args = held, public_tokenizers.path("byte_bpe_50k.json")
    out = lm_scoring.lm_scores(*args).filter("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    monkeypatch.setattr(lm_scoring, "FREQUENT", 3)  # most words by the join
    joined = {r.doc_id: r for r in lm_scoring.lm_scores(*args).filter("held_out").collect()}
    for r in out:
        assert joined[r.doc_id].n_known == r.n_known and math.isclose(joined[r.doc_id].score, r.score, rel_tol=1e-4)
        assert math.isclose(joined[r.doc_id].base_score, r.base_score, rel_tol=1e-9)


def test_lm_attention_trains_on_every_window(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, sentence(random.Random(i), 3 + 9 * i)) for i in range(12)], "doc_id long, text string")
    coded = common.materialize(lm_scoring.encoded(df, path, 7, 2), "t_ids")
    seen, add = [], lm_scoring._sum_slices

    def spy(rows, name):
        got = add(rows, name)
        seen.extend(got[-1][0] for _ in [0] if name == "attention_weights" and got)
        return got
    monkeypatch.setattr(lm_scoring, "_sum_slices", spy)
    lm_scoring.train(coded, lm_scoring.word_starts(path))
    assert sum(seen) == coded.filter("not held_out").agg(F.sum(F.length("ids") / 2)).first()[0]


def test_attention_gradients_and_causality():
    rng = np.random.default_rng(0)
    model = lm_scoring.Attention(rng.normal(size=(lm_scoring.CLASSES + 1, lm_scoring.CLASSES)))
    model.w = {k: rng.normal(0, 0.3, v.shape) for k, v in model.w.items()}
    past = rng.integers(0, lm_scoring.CLASSES, (3, lm_scoring.WINDOW))
    target, weight = rng.integers(0, lm_scoring.CLASSES, past.shape), np.ones(past.shape)
    _, g = model.gradients(past, target, weight)
    for name in model.NAMES:
        at = tuple(rng.integers(0, s) for s in model.w[name].shape) if name != "embed" else (past[0, 3], 2)
        model.w[name][at] += 1e-4
        high, _ = model.gradients(past, target, weight)
        model.w[name][at] -= 2e-4
        low, _ = model.gradients(past, target, weight)
        model.w[name][at] += 1e-4
        assert abs((high - low) / 2e-4 - g[name][at]) < 1e-3, name
    scored, sums = np.ones(past.shape, bool), np.ones((lm_scoring.CLASSES, 2))
    sums[10:, 1] = 0
    tables = model.tables(sums)
    a = model.log_likelihood(past, target, scored, tables).reshape(2, *past.shape)
    hidden = model.hidden(past)[-1] @ model.w["out"] + model.bigram[past]
    chosen = np.take_along_axis(np.log(lm_scoring.softmax_rows(hidden)), target[..., None], axis=-1)[..., 0]
    assert np.allclose(a[0], chosen, atol=1e-4)
    each = [model.log_likelihood(past, np.full(past.shape, k), scored, tables)[0] for k in range(lm_scoring.CLASSES)]
    assert np.allclose(np.exp(each).sum(axis=0), 1, atol=1e-4) and np.allclose(np.exp(each[:10]).sum(axis=0), np.exp(a[1].ravel()), atol=1e-4)
    past[:, 9:] = 0
    assert np.allclose(a[..., :9], model.log_likelihood(past, target, scored, tables).reshape(2, *past.shape)[..., :9], atol=1e-4)


def test_attention_gradients_add_up_over_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    model = lm_scoring.Attention(rng.normal(size=(lm_scoring.CLASSES + 1, lm_scoring.CLASSES)))
    model.w["out"] = rng.normal(0, 0.3, model.w["out"].shape).astype(np.float32)
    past = rng.integers(0, lm_scoring.CLASSES + 1, (11, lm_scoring.WINDOW))
    target, weight = rng.integers(0, lm_scoring.CLASSES, past.shape), (rng.random(past.shape) < 0.7) * 1.0
    weight[4:6] = 0  # a block without any place to learn from
    got = []
    for block in (2, 96):
        monkeypatch.setattr(lm_scoring, "BLOCK", block)
        got.append(model.gradients(past, target, weight))
    (loss, g), (at_once, whole) = got
    p = lm_scoring.softmax_rows(model.hidden(past)[-1] @ model.w["out"] + model.bigram[past])
    mean = -(np.log(np.take_along_axis(p, target[..., None], axis=-1)[..., 0]) * weight).sum() / weight.sum()
    assert math.isclose(loss, mean, rel_tol=1e-5) and math.isclose(at_once, mean, rel_tol=1e-5)
    assert all(np.allclose(g[name], whole[name], atol=1e-6) and g[name].shape == model.w[name].shape for name in model.NAMES)


def test_windows_score_each_id_once():
    for n in (1, 3, 12, 15, 16, 17, 28, 29, 200):
        sizes = np.array([n, 5, 33])
        _, target, scored, owner = lm_scoring.windows(np.arange(sizes.sum()), sizes)
        assert target[scored].tolist() == list(range(sizes.sum())) and len(owner) == len(target)


def test_pipeline_runs_and_drops_what_it_should(spark):
    import corpus_pipeline
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.doc_id.nunique() < docs.count() and out.groupby("sequence_id").length.sum().max() <= 2048
    kept = quality.keep_good(docs)
    line = common.materialize(line_dedup.line_dedup(kept).select(*kept.columns), "t_lines")
    near = {c for _, _, c in brute.simhash([(r.doc_id, r.text) for r in line.collect()])}
    bad = {r.doc_id for r in decontam.matches(line, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(out.doc_id) == near - bad


def test_word_codes_are_the_words_of_each_text():
    texts = [b"", None, b" \t\n\x0b\x0c\r ", b"One two  one", "cafÉ no break  x\x1c\x85y".encode(), b"two", b"\nA\n", b"tail "]
    words, codes, n = common.word_codes(texts)
    split = [(t or b"").lower().split() for t in texts]
    assert [words[c] for c in codes] == [w for ws in split for w in ws] and n.tolist() == [len(ws) for ws in split]
    assert len(set(words)) == len(words)
    words, codes, n = common.word_codes([None, b" "])
    assert not words and not len(codes) and n.tolist() == [0, 0]
    words, codes, n = common.word_codes([])
    assert not words and not len(codes) and not len(n)


def test_a_worker_keeps_its_encoder_and_the_words_it_knows():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lm_scoring.word_encoder.cache_clear()
    kept = lm_scoring.word_encoder(path)
    words, codes, _ = common.word_codes([b"a's caf\xc3\xa9 the THE banana the", "日本 the".encode()])
    ids, n = kept.of(words, codes)
    fresh = bpe.WordEncoder(path, word_ends=False)
    want, want_n = fresh.of([words[c] for c in codes])
    assert ids.tolist() == want.tolist() and n.tolist() == want_n.tolist()
    again = lm_scoring.word_encoder(path)
    again.encode = None  # known words need no encoding, in whatever task
    assert again is kept and again.of(words, codes)[0].tolist() == want.tolist()
    lm_scoring.word_encoder.cache_clear()


def test_adam_steps_over_all_weights_at_once_as_by_name():
    rng = np.random.default_rng(3)
    bigram = rng.normal(0, 1, (lm_scoring.CLASSES + 1, lm_scoring.CLASSES)).astype(np.float32)
    past = rng.integers(0, lm_scoring.CLASSES + 1, (40, lm_scoring.WINDOW))
    target = rng.integers(0, lm_scoring.CLASSES, past.shape)
    weight = (rng.random(past.shape) < 0.8).astype(np.float32)
    a, b = lm_scoring.Attention(bigram), lm_scoring.Attention(bigram)
    start = b.vector()
    state = {}
    a.fit(past, target, weight, state, 0.01, batch=16)
    m, s = ({k: np.zeros_like(v) for k, v in b.w.items()} for _ in "ms")
    for t, k in enumerate(range(0, 40, 16), 1):
        _, g = b.gradients(past[k:k + 16], target[k:k + 16], weight[k:k + 16])
        for name in b.NAMES:
            m[name] = 0.9 * m[name] + 0.1 * g[name]
            s[name] = 0.99 * s[name] + 0.01 * g[name] ** 2
            b.w[name] = b.w[name] - 0.01 * (m[name] / (1 - 0.9 ** t)) / (np.sqrt(s[name] / (1 - 0.99 ** t)) + 1e-6)
    assert np.array_equal(a.vector(), b.vector()) and state["t"] == 3
    assert not np.array_equal(a.vector(), start)
    assert np.array_equal(lm_scoring.Attention(bigram).load(a.vector()).vector(), a.vector())
