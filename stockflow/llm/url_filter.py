"""URL filter: host and path rules, and gradient-boosted trees for the rest.

DataFrame functions and Spark ML only. A rule names a host with all its
subdomains and the start of a path; the longest fitting rule decides. Urls
that some rule decides are the labelled ones: the trees learn from them, on
lexical features (lengths, depth, digit ratio, character entropy, number of
parameters, hyphens and host labels) and on suffix statistics (how often urls
of the same last host label are blocked among the labelled, smoothed), and
judge the urls that no rule fits. Hosts are dealt into ``FOLDS`` folds, and a
training row's suffix statistics come from the hosts of the other folds, so no
row is told its own label. Training takes at most ``SAMPLE`` labelled urls, those
with the smallest hash; everything else is computed for every row. ``held_out``
measures the trees on hosts that they have not seen.

Defined cases: null url or one without ``://`` has empty host and path and is
judged by the trees; unless urls of both verdicts are labelled, what no rule
fits is allowed; repeated rows each get a row; empty table: no rows. Only
``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000     # labelled urls that the trees are fitted on
TREES, DEPTH = 10, 4
FOLDS = 5
SMOOTHING = 5.0     # labelled urls that the overall share of blocked ones counts as
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens",
            "labels", "suffix_length", "suffix_blocked"]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url (empty for null), host, path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    return pages.select("page_id", url.alias("url"), rest.alias("rest")).select(
        "page_id", "url", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"), F.col("rest"))


def fitting_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host followed by path) that fits, and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last that fits wins
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """Adds suffix and the lexical features."""
    length = F.length("url")
    share = F.expr("""aggregate(array_distinct(split(url, '')), 0D, (total, c) ->
        total - CASE WHEN c = '' THEN 0D ELSE ((length(url) - length(replace(url, c, ''))) / length(url))
                                             * log2((length(url) - length(replace(url, c, ''))) / length(url)) END)""")
    query = F.when(F.contains(F.col("rest"), F.lit("?")), F.regexp_extract("rest", r"\?([^#]*)", 1)).otherwise("")
    return urls.withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "url_length": length.cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace("url", "[^0-9]", "")) / F.greatest(length, F.lit(1)),
        "entropy": F.when(length > 0, share).otherwise(0.0),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "hyphens": F.length(F.regexp_replace("url", "[^-_]", "")).cast("double"),
        "labels": F.size(F.filter(F.split("host", r"\."), lambda x: x != "")).cast("double"),
        "suffix_length": F.length(F.substring_index("host", ".", -1)).cast("double")})


def _labelled(urls: DataFrame) -> DataFrame:
    """The urls that a rule decides: label (1: block), fold of the host, features."""
    return urls.filter("ruled is not null").select(
        "page_id", "url", "suffix", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).alias("fold"), *FEATURES[:-1],
        (F.col("ruled") == "block").cast("double").alias("label"))


def _share(b: Column, n: Column, overall: float) -> Column:
    return ((b + SMOOTHING * overall) / (n + SMOOTHING)).alias("suffix_blocked")


class Trees:
    """Trees fitted on labelled urls, with the suffix statistics to judge others by."""

    def __init__(self, named: DataFrame, sample: int, columns: list[str]):
        counts = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}
        self.fitted = len(counts) == 2
        if not self.fitted:
            return
        self.overall = counts[1.0] / sum(counts.values())
        by_fold = named.groupBy("suffix", "fold").agg(F.sum("label").alias("b"), F.count("*").alias("n"))
        all_folds = by_fold.groupBy("suffix").agg(F.sum("b").alias("of_b"), F.sum("n").alias("of_n"))
        self.known = all_folds.select(F.col("suffix").alias("of_suffix"), _share(F.col("of_b"), F.col("of_n"), self.overall))
        # One bounded partition in a fixed order: the fit doesn't depend on the cluster.
        taken = named.orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(sample).drop("page_id", "url").cache()
        # At most ``sample`` suffixes and folds, so broadcast: the order of the training rows stays.
        others = taken.select("suffix", "fold").distinct().join(all_folds, "suffix").join(by_fold, ["suffix", "fold"], "left").select(
            F.col("suffix").alias("of_suffix"), F.col("fold").alias("of_fold"),
            _share(F.col("of_b") - F.coalesce("b", F.lit(0.0)), F.col("of_n") - F.coalesce("n", F.lit(0)), self.overall))
        rows = taken.join(F.broadcast(others), (F.col("suffix") == F.col("of_suffix")) & (F.col("fold") == F.col("of_fold")))
        self.assembler = VectorAssembler(inputCols=columns, outputCol="features")
        self.model = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(
            self.assembler.transform(rows).select("features", "label"))
        taken.unpersist()

    def judge(self, urls: DataFrame) -> DataFrame:
        """``urls`` with prediction (1: block)."""
        rows = urls.join(self.known, F.col("suffix") == F.col("of_suffix"), "left").drop("of_suffix").fillna(self.overall, ["suffix_blocked"])
        return self.model.transform(self.assembler.transform(rows))


def _urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    rule, verdict = fitting_rule(rules)
    return lexical(parsed(pages).withColumns({"rule": rule, "ruled": verdict}))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, one row per page.
    ``rules``: (allow or block, host, path)."""
    urls = _urls(pages, rules)
    trees = Trees(_labelled(urls), sample, FEATURES)
    if not trees.fitted:
        return urls.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    return trees.judge(urls).select("page_id", "host", "path", "rule",
                                    F.coalesce("ruled", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")).alias("verdict"))


def held_out(pages: DataFrame, rules: list[tuple[str, str, str]], columns: list[str] = FEATURES, sample: int = SAMPLE) -> DataFrame:
    """label, prediction, n: the labelled urls of one fold of hosts, judged by trees that were
    fitted on the other folds (no rows where these have one verdict only)."""
    named = _labelled(_urls(pages, rules))
    trees = Trees(named.filter("fold != 0"), sample, columns)
    if not trees.fitted:
        return named.limit(0).select("label", F.col("label").alias("prediction"), F.lit(0).cast("long").alias("n"))
    return trees.judge(named.filter("fold = 0")).groupBy("label", "prediction").agg(F.count("*").alias("n"))
