"""Column expressions shared by the operators. All are built-in Spark
expressions (JVM side, inside whole-stage codegen); no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text tokens a pandas CSV reader turns into missing values
# (pandas >= 2 default na_values), so a Spark CSV scan can null them the same way.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_na_token(c) -> Column:
    """String column with pandas' missing-value tokens replaced by NULL."""
    c = _c(c)
    return F.when(c.isin(PANDAS_NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def nan_to_null(c) -> Column:
    """NaN → NULL so comparisons behave like pandas (NaN compares false)."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def title_case(c) -> Column:
    """Python ``str.strip().title()``: every run of letters starts upper-case,
    the rest lower-case, so ``women's home-decor`` → ``Women'S Home-Decor``.

    ``initcap`` only splits on spaces, so the text is cut into alternating
    letter / non-letter runs, each run initcapped, and glued back.
    """
    runs = F.regexp_extract_all(F.lower(strip(c)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda t: F.initcap(t)), "")


def strip(c) -> Column:
    """Text without white space of any kind (tabs, line ends, no-break spaces) at its ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def fixed(c, digits: int) -> Column:
    """A number with so many decimals, halves to even."""
    return F.bround(_c(c).cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})").cast("string")


def clip_keep_null(c, lo: float | None = None, hi: float | None = None) -> Column:
    """pandas ``clip``: bounds applied, NULL stays NULL (``greatest``/``least``
    alone would turn NULL into the bound)."""
    c = _c(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def max0(c) -> Column:
    """``np.maximum(0, x)``, NULL kept."""
    c = _c(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def week_end(c) -> Column:
    """Sunday that closes the Monday-based week of a DATE."""
    return F.date_add(F.date_trunc("week", _c(c)).cast("date"), 6)


def rupees(c) -> Column:
    """Currency display: values >= 1,00,000 as lakhs with two decimals
    (``₹1.23L``), smaller ones with thousands separators (``₹12,345``)."""
    c = _c(c)
    return (F.when(c >= 100000, F.concat(F.lit("₹"), fixed(c / 100000.0, 2), F.lit("L")))
             .otherwise(F.concat(F.lit("₹"), F.format_number(F.bround(c.cast("decimal(38,10)"), 0), 0))))
