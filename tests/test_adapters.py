"""The derived raw tables hold every kind of dirt, and cleaning settles each of them."""

import pytest
from pyspark.sql import functions as F

from stockflow.operators import cleaning, risk
from stockflow.sources.adapters import raw_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def raw(spark):
    return raw_tables(spark, SF)


def test_repeated_skus_and_a_row_without_code(raw):
    seen = {r.sku_id: r for r in raw.sku_master.groupBy("sku_id").agg(F.count("*").alias("n"), F.min("subcategory").alias("s")).collect()}
    twice = {k for k, r in seen.items() if k and r.n == 2}
    assert twice and None in seen
    clean = {r.sku_id: r for r in cleaning.clean_sku_master(raw.sku_master).collect()}
    assert set(clean) == set(seen) - {None}
    assert all(clean[k].subcategory.lower() == seen[k].s for k in twice)   # the categories are equal


def test_repeated_dates_keep_the_first_row(raw):
    days = raw.calendar.groupBy("date").count()
    assert {r[0] for r in days.select("count").distinct().collect()} == {1, 2}
    clean = cleaning.clean_calendar(raw.calendar)
    assert clean.count() == days.count()
    assert clean.filter("day(date) = 13 and is_holiday = 1").count() == 0
    assert clean.filter("(day(date) = 20) <> (season = 'Again')").count() == 0


def test_lead_times_in_any_spelling_and_one_row_per_sku(raw):
    leads = {r[0] for r in raw.inventory.select("lead_time_days").distinct().collect()}
    assert {None, "two weeks", "14", "14.0"} <= leads
    sku = cleaning.clean_sku_master(raw.sku_master)
    inv = cleaning.clean_inventory(raw.inventory, sku)
    assert inv.count() == inv.distinct().count()
    assert inv.filter("sku_id = 'SKU_00045'").select("lead_time_days").distinct().collect() == [(14,)]
    latest = risk.latest_inventory(inv)
    assert latest.count() == latest.select("sku_id").distinct().count() < inv.filter(F.col("date") == inv.select(F.max("date")).scalar()).count()
