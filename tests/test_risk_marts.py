import datetime as dt

from stockflow.operators import marts, risk

END = dt.date(2025, 3, 31)


def _sku(spark, rows):
    return spark.createDataFrame(rows, "sku_id string, category string, subcategory string, launch_date date, "
                                       "unit_cost double, list_price double")


def _inv(spark, rows):
    return spark.createDataFrame([(END, *r) for r in rows],
                                 "date date, sku_id string, on_hand_units double, on_order_units double, "
                                 "lead_time_days int, reorder_point int")


def _sales(spark, rows):
    return spark.createDataFrame(rows, "date date, sku_id string, units_sold double")


def test_demand_rate_windows_and_defaults(spark):
    d = lambda k: END - dt.timedelta(days=k)
    sales = _sales(spark, [(END, "Z", 1.0),        # sets the end date
                           (d(84), "A", 12.0),     # day −84 included in the 12-week window
                           (d(85), "A", 1000.0),   # day −85 excluded
                           (d(30), "B", 0.0),      # only zero rows → rate 0, 4w absent → 0.1
                           (d(29), "C", 8.0)])     # only before day −28 → w4 default
    skus = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "sku_id string")
    r = {x.sku_id: x for x in risk.attach_rates(skus, sales).collect()}
    assert r["A"].weekly_avg_sales == 1.0 and r["A"].weekly_avg_sales_4w == 0.1
    assert r["B"].weekly_avg_sales == 0.0 and r["B"].weekly_avg_sales_4w == 0.1
    assert r["C"].weekly_avg_sales == 8.0 / 12 and r["C"].weekly_avg_sales_4w == 0.1
    assert r["D"].weekly_avg_sales == 0.1


def test_quadrants_each_label(spark):
    sku = _sku(spark, [(s, "Small Appliances", "x", END, 10.0, 20.0) for s in ("R", "M", "W", "H")])
    sales = _sales(spark, [(END - dt.timedelta(days=7 * i), s, 10.0) for i in range(12) for s in ("R", "M", "W", "H")])
    inv = _inv(spark, [("R", 0.0, 0.0, 14, 0), ("M", 1000.0, 0.0, 14, 0), ("W", 120.0, 0.0, 400, 0),
                       ("H", 30.0, 10.0, 7, 0)])
    q = {x.sku_id: x for x in risk.risk_scores(inv, sku, sales).collect()}
    assert q["R"].quadrant == "REORDER NOW"
    assert q["M"].quadrant == "MARKDOWN / CLEAR"
    assert q["W"].quadrant == "WATCH / VOLATILE"
    assert q["H"].quadrant == "HEALTHY"
    assert q["R"].units_short > 0 and q["R"].sales_at_risk == q["R"].units_short * 20.0
    assert q["M"].capital_locked == (1000.0 - 60.0) * 10.0


def test_boundary_scores_fall_through_to_healthy(spark):
    df = spark.createDataFrame([(0.55, 0.0), (0.0, 0.55), (0.45, 0.45)], "so double, os double")
    from pyspark.sql import functions as F
    lab = (F.when((F.col("so") > risk.HIGH) & (F.col("os") < risk.LOW), risk.REORDER)
            .when((F.col("os") > risk.HIGH) & (F.col("so") < risk.LOW), risk.MARKDOWN).otherwise(risk.HEALTHY))
    assert {r[0] for r in df.select(lab).collect()} == {risk.HEALTHY}


def test_unknown_category_keeps_schema(spark):
    sku = _sku(spark, [("A", "Kitchenware", "x", END, 1.0, 2.0)])
    inv = _inv(spark, [("A", 1.0, 1.0, 7, 1)])
    sales = _sales(spark, [(END, "A", 1.0)])
    full = risk.risk_scores(inv, sku, sales)
    empty = risk.risk_scores(inv, sku, sales, risk.RiskParams(category="Nope"))
    assert empty.count() == 0 and empty.columns == full.columns


def test_kpis_empty_health_100(spark):
    sku = _sku(spark, [("A", "Kitchenware", "x", END, 1.0, 2.0)])
    inv = _inv(spark, [("A", 1.0, 1.0, 7, 1)])
    sales = _sales(spark, [(END, "A", 1.0)])
    k = marts.executive_kpis(risk.risk_scores(inv, sku, sales, risk.RiskParams(category="Nope"))).first()
    assert k.sku_count == 0 and k.health_score == 100


def test_plans_and_currency(spark):
    from stockflow.functions.columns import rupees
    df = spark.createDataFrame([(12345.4,), (250000.0,)], "v double")
    assert [r[0] for r in df.select(rupees("v")).collect()] == ["₹12,345", "₹2.50L"]
    sku = _sku(spark, [("R", "Furnishings", "x", END, 10.0, 20.0)])
    sales = _sales(spark, [(END - dt.timedelta(days=7 * i), "R", 10.0) for i in range(12)])
    inv = _inv(spark, [("R", 0.0, 0.0, 21, 0)])
    r = risk.risk_scores(inv, sku, sales)
    plan = marts.reorder_plan(r).first()
    assert plan.recommended_qty == 40 and plan.recommended_qty_label == "40 units"
    assert plan.lead_time_label == "21 days"
    assert plan.timeline_urgency in (marts.URGENT_LABEL, marts.HIGH_LABEL)


def test_scenarios_one_row_per_sku_and_scenario(spark):
    sku = _sku(spark, [(s, "Furnishings", "x", END, 1.0, 2.0) for s in ("A", "B")])
    inv = _inv(spark, [("A", 1.0, 1.0, 7, 1), ("B", 5.0, 0.0, 14, 1)])
    sales = _sales(spark, [(END, "A", 3.0), (END, "B", 4.0)])
    grid = risk.scenario_grid([None, 30], [1.0, 2.0])
    out = risk.risk_scenarios(inv, sku, sales, grid)
    assert out.count() == 8
    base = {x.sku_id: x.stockout_risk for x in risk.risk_scores(inv, sku, sales, risk.RiskParams(1.0)).collect()}
    same = {x.sku_id: x.stockout_risk for x in out.filter("scenario_id = 0").collect()}
    assert base == same
