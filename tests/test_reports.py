"""Report plans on the literal fixtures."""

from decimal import Decimal as D

from pyspark.sql import functions as F

import pytest

from ledgerline.plans import (
    customer_master,
    net_invoiced,
    net_sellout,
    price_lists,
    product_catalogue,
    sales_order_report,
    served_invoice,
)
from ledgerline.plans.quality import loss_metrics
from tests.fixtures import tables


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark)


def test_price_lists(t, params):
    nonvan, van = price_lists(t["price"], params)
    nv = {r.sku: (r.case_price, r.piece_price) for r in nonvan.collect()}
    # missing class kept and added, excluded class dropped; VAT 12%
    assert nv == {"100": (D("112.0000"), D("0")), "200": (D("112.0000"), D("5.6000"))}
    assert {r.sku: r.case_price for r in van.collect()} == {"100": D("224.0000"), "200": D("28.0000")}


def test_served_invoice_volume_and_suffix(t, params):
    out = {(r.sku, str(r.txn_date)): r for r in served_invoice(t, params).collect()}
    # tax line removed, Sunday (not in calendar) dropped, deducted pair I2_400 removed
    assert set(out) == {("100", "2026-01-05"), ("200", "2026-01-05"), ("200", "2026-01-06")}
    widget = out[("100", "2026-01-05")]
    assert widget.category == "Tools"          # category joined on the raw code 100_old
    assert widget.volume == pytest.approx(112.0 / 224.0)  # van customer: van case price of stripped code
    gadget = out[("200", "2026-01-05")]
    assert gadget.volume == 2.0                 # free good, case unit: quantity
    assert out[("200", "2026-01-06")].volume == 4.0
    assert widget.supervisor == "Sup1" and widget.distributor == "Test Co"


def test_net_invoiced_returns(t, params):
    rows = net_invoiced(t, params).collect()
    ret = [r for r in rows if r.bad_returns or r.good_returns]
    # R1 twice (equal in every key) collapses: bad = 2 x 10 x 1.12; R2 virtual -> FG; R3 unknown facility and
    # R4 (deducted, and no UOM) dropped
    assert len(ret) == 1
    assert ret[0].bad_returns == D("22.400000") and ret[0].good_returns == D("22.400000")
    assert ret[0].net_value == -(D("22.4") + D("22.4"))
    assert ret[0].gt_channel == "GT-R" and ret[0].route_model == "VAN(EXTRUCK)"


def test_sales_order_carries_deductions(t, params):
    t2 = dict(t)
    t2["deductions"] = t["deductions"].sparkSession.createDataFrame([("I1_200", None)],
                                                                    "invoice_key string, return_key string")
    rows = sales_order_report(t2, params).collect()
    assert [(r.customer_id, r.sku) for r in rows] == [("C1", "100")]  # O1/200 removed, O2 not invoiced
    assert rows[0].value == D("112.0000")


def test_net_sellout(t, params):
    rows = net_sellout(t, params).collect()
    docs = sorted((r.doc_no, r.sku, float(r.qty)) for r in rows)
    # token KX on item codes; returns: customer returns excluded, quantity negated; no return sku has KX
    assert ("I1", "KX100", 10.0) in docs and all(not d[0].startswith("R") for d in docs)
    assert all(not d[1].startswith("AB") for d in docs)


def test_customer_master_rules(t, params):
    out = {r.customer_id: r for r in customer_master(t, params).collect()}
    assert set(out) == {"C1", "C2", "C4", "S1"}                 # approval-on-hold removed, missing status kept
    assert (out["C1"].coverage_day, out["C1"].coverage_weeks, out["C1"].freq) == ("TUE", "WKLY", "F4")
    assert (out["C2"].coverage_day, out["C2"].freq, out["C2"].freq_count) == ("NA", "NA", 0)
    assert out["C1"].freq_count == 1 and out["C4"].freq_count == 0
    assert out["C1"].is_new == "NO" and out["C2"].is_new == "YES" and out["C4"].is_new == "YES"
    assert out["S1"].classification == "H ACCT" and out["C1"].classification == "CL-R"
    assert out["C2"].classification is None                      # incomplete classification row dropped


def test_catalogue_and_losses(t, params):
    cat = {r.sku: r.sku_name for r in product_catalogue(t).collect()}
    assert cat["200"] == "Gadget" and "300" not in cat
    losses = {r.metric: r.rows for r in loss_metrics(t).collect()}
    assert losses["invoices_not_in_calendar"] == 1
    assert losses["returns_unknown_facility"] == 1
    assert losses["created_date_rejects"] == 1
    assert losses["supervisor_key_fanout"] == 0


def test_partitioning_does_not_change_results(spark, t, params):
    base = sorted(map(tuple, net_invoiced(t, params).collect()), key=str)
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            assert sorted(map(tuple, net_invoiced(t, params).collect()), key=str) == base
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_no_python_in_report_plans(t, params):
    for df in (net_invoiced(t, params), served_invoice(t, params), customer_master(t, params)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(k in plan for k in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"))


def test_category_versions(spark, t):
    import tempfile

    from ledgerline.operators import uncategorized
    from ledgerline.plans.categories import latest_categories, publish_categories

    path = tempfile.mkdtemp(prefix="ll-cat-")
    publish_categories(t["category"].filter(F.col("sku") != "200"), t["category"].limit(0), path, "v0001")
    missing = uncategorized(product_catalogue(t), latest_categories(spark, path))
    assert sorted(r.sku for r in missing.collect()) == ["200"]
    fixes = missing.withColumn("category", F.lit("Things"))
    assert publish_categories(latest_categories(spark, path), fixes, path, "v0002") == 3
    now = latest_categories(spark, path)
    assert {r.sku: r.category for r in now.collect()}["200"] == "Things"
    assert uncategorized(product_catalogue(t), now).count() == 0


def test_catalogue_name_precedence(spark, t):
    from datetime import date
    from decimal import Decimal as Dec

    from tests.fixtures import INVOICE, RETURNS, SALES_ORDER

    d = date(2026, 1, 5)
    t2 = dict(t)
    t2["invoice"] = spark.createDataFrame(
        [(d, "C1", "One", "S9", "X", "inv-name", "Case", Dec(1), Dec(1), "ITM_GOODS", "I9", "O9", "E1")], INVOICE)
    t2["returns"] = spark.createDataFrame([
        (d, "R9", "E1", "C1", "One", "S9", "ret-name", "MAIN BO", Dec(1), "Case", Dec(1), None),
        (d, "R8", "E1", "C1", "One", "S8", "ret-b", "MAIN BO", Dec(1), "Case", Dec(1), None),
        (d, "R7", "E1", "C1", "One", "S8", "ret-a", "MAIN FG", Dec(1), "Case", Dec(1), None),
        (d, "R6", "E1", "C1", "One", "S7", "ret-x", "FG_1", Dec(1), "Case", Dec(1), None),  # not pivoted
    ], RETURNS)
    t2["sales_order"] = spark.createDataFrame([
        (d, "C1", "S9", "so-name", "Case", Dec(1), Dec(1), "Invoiced", "O9"),
        (d, "C1", "S8", "so-name", "Case", Dec(1), Dec(1), "Invoiced", "O8"),
        (d, "C1", "S7", "so-only", "Case", Dec(1), Dec(1), "Invoiced", "O7"),
    ], SALES_ORDER)
    t2["deductions"] = spark.createDataFrame([], "invoice_key string, return_key string")
    got = {r.sku: r.sku_name for r in product_catalogue(t2).collect()}
    assert got == {"S9": "inv-name", "S8": "ret-a", "S7": "so-only"}


def test_same_results_without_any_broadcast(spark, t, params):
    from dataclasses import replace

    base = sorted(map(tuple, net_invoiced(t, params).collect()), key=str)
    no_bcast = replace(params, broadcast_max_rows=0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = net_invoiced(t, no_bcast)
        rows = sorted(map(tuple, df.collect()), key=str)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert rows == base


def test_sku_references_joined_together_give_the_rows_of_single_lookups(spark, t, params, monkeypatch):
    from ledgerline.plans import reports

    t2 = dict(t)
    odd = "S1' as sku, 'odd' as sku_name, 'Twice' as category"
    t2["category"] = t["category"].unionByName(t["category"]).unionByName(spark.sql(f"select '{odd} union all select null, null, 'Nowhere'"))
    t2["free_goods"] = t["free_goods"].unionByName(t["free_goods"].limit(1)).unionByName(
        spark.sql("select cast(null as string) as sku, cast(3 as decimal(12,2)) as case_size union all select '200', cast(null as decimal(12,2))"))
    prices = reports.case_prices(t, params)
    prices = prices.unionByName(prices).unionByName(prices.limit(1).selectExpr("cast(null as string) as sku", "nonvan_price", "van_price"))
    facts = t["invoice"].select("txn_date", "customer_id", "sku", "uom", "qty")
    facts = facts.unionByName(facts.withColumn("sku", F.concat("sku", F.lit("_old")))).unionByName(facts.withColumn("sku", F.lit(None).cast("string")))
    cols = ["txn_date", "customer_id", "sku", "uom", "category", "nonvan_price", "van_price", "case_size", "channel", "week"]
    rows = lambda: sorted(map(str, reports.enrich(facts, t2, prices).select(*cols).collect()))
    singly = rows()
    joins = lambda: reports.enrich(facts, t2, prices)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    before = joins()
    monkeypatch.setattr(reports, "SKU_LOOKUPS_MAX_ROWS", -1)
    assert rows() == singly and len(singly) > facts.count()
    assert joins() == before - 2  # the facts meet one SKU reference, not three
