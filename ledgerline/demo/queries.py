"""Registered queries over the test tables, one per operator or report.

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame built from
the domain tables of :mod:`ledgerline.demo.tables`. ``finish`` only changes the
presentation for the oracle comparison: dates as ISO text and decimals as
double, which both engines convert identically.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import operators as O
from ledgerline.demo.tables import DEMO_PARAMS, DemoTables
from ledgerline.functions import (
    date_label,
    default_if_blank,
    facility_code,
    parse_created_date,
    route_parts,
    safe_div,
    strip_retired_suffix,
    tolerant_number,
    with_vat,
)
from ledgerline.plans import customers as C
from ledgerline.plans import facts as FX
from ledgerline.plans import reports as R
from ledgerline.plans.categories import commit_categories, committed_categories
from ledgerline.plans.daily import report_totals, write_fact_reports
from ledgerline.plans.quality import loss_metrics, price_fanout
from ledgerline.plans.volume import with_volume
from ledgerline.schemas import schema
from ledgerline.session import freed_shuffles, scratch_dir
from ledgerline.sources import ingest_checked, ingest_workbooks, read_report, read_table, required_values, write_report, write_workbooks
from ledgerline.sources.order import deal_in_order

Query = Callable[[SparkSession, str], DataFrame]


def finish(df: DataFrame) -> DataFrame:
    """Dates/timestamps as ISO text, decimals as double."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType,)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def _t(spark: SparkSession, sf_dir: str) -> DemoTables:
    return DemoTables(spark, sf_dir)


# --- sources ---------------------------------------------------------------

def required_values_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    return required_values({
        "invoice": (t.invoice, ["txn_date", "customer_id", "sku", "uom", "qty", "item_type"]),
        "returns": (t.returns, ["txn_date", "customer_id", "sku", "uom", "facility", "return_type"]),
        "sales_order": (t.sales_order, ["txn_date", "customer_id", "sku", "uom", "status"]),
        "customer": (t.customer, ["customer_id", "rep_id", "status", "created"]),
    })


def partition_roundtrip_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = f"{scratch_dir(spark)}/reports/net_sellout-{uuid.uuid4().hex}"
    report = R.net_sellout(t, DEMO_PARAMS)
    write_report(report, path, "2026-01-02", sort_by=R.REPORT_ORDER["net_sellout"])
    write_report(report.filter(F.col("qty") < 0), path, "2026-01-03")
    write_report(report, path, "2026-01-03")  # rerun of one date replaces only that partition
    df = read_report(spark, path, "2026-01-03")
    return finish(df.drop("report_date"))


def empty_rerun_q(spark, sf_dir):
    """Rows left after a date is rerun without rows, beside a date that keeps its rows and one that never had any."""
    report = R.net_sellout(_t(spark, sf_dir), DEMO_PARAMS)
    path = f"{scratch_dir(spark)}/reports/rerun-{uuid.uuid4().hex}"
    write_report(report.filter(F.lit(False)), path, "2026-01-01", sort_by=R.REPORT_ORDER["net_sellout"])
    first_day = read_report(spark, path).count()
    write_report(report, path, "2026-01-02")
    write_report(report, path, "2026-01-03")
    write_report(report.filter("qty is null and qty is not null"), path, "2026-01-02")
    kept = read_report(spark, path).groupBy(F.col("report_date").cast("string").alias("report_date")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("qty").alias("qty"))
    days = spark.createDataFrame([("2026-01-01", first_day), ("2026-01-02", 0), ("2026-01-03", 0)], "report_date string, first_rows bigint")
    return finish(days.join(kept, "report_date", "left").select("report_date", "first_rows", F.coalesce("rows", F.lit(0)).alias("rows"), "qty"))


def checked_parquet_q(spark, sf_dir):
    """An extract landed with more columns, in another order and in narrower types, read by its schema."""
    t = _t(spark, sf_dir)
    path = _folder(spark, "free-goods")
    landed = t.free_goods.select(F.lit("x").alias("extra"), F.col("case_size").cast("int").alias("case_size"), F.col("sku").alias("sku"), F.lit(1).alias("more"))
    landed.write.parquet(path)
    return finish(read_table(spark, path, schema("free_goods")))


def rejected_cells_q(spark, sf_dir):
    """Cells of an invoice workbook that are neither numbers nor dates."""
    inv = _t(spark, sf_dir).invoice
    qty = F.when(F.col("uom") == "Subcase", F.concat("sku", F.lit(" pcs"))).otherwise(F.col("qty").cast("string"))
    day = F.when(F.col("uom") == "Piece", F.concat(F.lit("day "), "doc_no")).otherwise(F.col("txn_date").cast("string"))
    path = _folder(spark, "invoice-cells")
    write_workbooks(inv.select("doc_no", "sku", day.alias("txn_date"), qty.alias("qty")), path)
    read = T.StructType([f for f in schema("invoice") if f.name in ("doc_no", "sku", "txn_date", "qty")])
    rows, cells = ingest_checked(spark, path, read, keep=["doc_no", "sku"])
    return cells.select("doc_no", "sku", "column_name", "text")


def report_rollup_q(spark, sf_dir):
    r = R.net_invoiced(_t(spark, sf_dir), DEMO_PARAMS)
    return finish(O.rollup_totals(r, ["branch", "rep_id"], ["net_value", "good_returns", "bad_returns"]))


def ordered_write_q(spark, sf_dir):
    """Every row's place in an ordered report, read back from its files."""
    report = R.net_sellout(_t(spark, sf_dir), DEMO_PARAMS)
    path = f"{scratch_dir(spark)}/reports/ordered-{uuid.uuid4().hex}"
    keys = R.REPORT_ORDER["net_sellout"]
    deal_in_order(report, keys, rows_per_range=2000).write.parquet(path)
    rows = spark.read.parquet(path).select(*keys, "_metadata.file_name", "_metadata.row_index")
    files = rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    before = files.withColumn("before", F.expr("sum(n) over (order by file_name) - n"))  # one row per file
    placed = rows.join(F.broadcast(before), "file_name")
    return finish(placed.select(*keys, (F.col("before") + F.col("row_index") + 1).cast("long").alias("place")))


def workbook_ingest_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = f"{scratch_dir(spark)}/workbooks/customer-{uuid.uuid4().hex}"
    cust = t.customer
    write_workbooks(cust, path)
    # A round trip: every text comes back as it was written, so none stands for a missing value.
    return ingest_workbooks(spark, path, cust.schema, missing_tokens=()).drop("source_file")


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/extracts/{name}-{uuid.uuid4().hex}"


def csv_read_by_name_q(spark, sf_dir):
    price = _t(spark, sf_dir).price
    path = _folder(spark, "price")
    price.select(*reversed(price.columns)).write.option("header", True).csv(path)
    return finish(read_table(spark, path, schema("price"), fmt="csv"))


def optional_source_q(spark, sf_dir):
    path = _folder(spark, "route")
    _t(spark, sf_dir).route.write.parquet(path)
    return O.row_counts({
        "present": read_table(spark, path, schema("route"), optional=True),
        "absent": read_table(spark, f"{path}-absent", schema("route"), optional=True),
    })


def header_offset_ingest_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = _folder(spark, "calendar")
    write_workbooks(t.calendar, path, header_row=5)  # the rows above are absent from the sheet
    return finish(ingest_workbooks(spark, path, schema("calendar"), header_row=5).drop("source_file"))


def positional_ingest_q(spark, sf_dir):
    path = _folder(spark, "route")
    write_workbooks(_t(spark, sf_dir).route, path)
    by_place = T.StructType([T.StructField("owner", T.StringType()), T.StructField("code", T.StringType())])
    return ingest_workbooks(spark, path, by_place, header_row=2, by_position=True).drop("source_file")


def missing_tokens_q(spark, sf_dir):
    path = _folder(spark, "created")
    write_workbooks(_t(spark, sf_dir).customer.select("customer_id", "created"), path)
    found = T.StructType([T.StructField("customer_id", T.StringType()), T.StructField("created", T.StringType())])
    return ingest_workbooks(spark, path, found).drop("source_file")


def workbook_columns_q(spark, sf_dir):
    """Two columns of a folder of workbooks that was replaced by invoices and then had returns added."""
    t = _t(spark, sf_dir)
    path = _folder(spark, "lines")
    lines = {name: t[name].select("txn_date", "customer_id", "sku", F.lit(name).alias("extract"), "uom") for name in ("invoice", "returns")}
    write_workbooks(lines["returns"], path)
    write_workbooks(lines["invoice"], path)
    write_workbooks(lines["returns"], path, mode="append")
    two = T.StructType([T.StructField("extract", T.StringType()), T.StructField("sku", T.StringType())])
    return ingest_workbooks(spark, path, two).groupBy("extract", "sku").agg(F.count(F.lit(1)).alias("rows"))


# --- filters and scalar functions -------------------------------------------

def null_keeping_filter_q(spark, sf_dir):
    inv = _t(spark, sf_dir).invoice
    return finish(O.exclude_value(inv, "item_type", "ITM_SALES_TAX").select("doc_no", "sku", "item_type", "qty"))


def token_filter_q(spark, sf_dir):
    inv = _t(spark, sf_dir).invoice
    return O.keep_token(inv, "item_code", DEMO_PARAMS.product_token, "Y").select("doc_no", "item_code")


def vat_amount_q(spark, sf_dir):
    ret = _t(spark, sf_dir).returns
    return finish(ret.select("doc_no", "sku", with_vat(F.coalesce("amount", F.lit(0))).alias("amount_vat")))


def facility_extract_q(spark, sf_dir):
    ret = _t(spark, sf_dir).returns
    return ret.select("doc_no", "sku", "facility", facility_code("facility").alias("facility_class"))


def route_decode_q(spark, sf_dir):
    r = _t(spark, sf_dir).route
    return r.select("customer_id", "route_code", route_parts("route_code").alias("p")).select(
        "customer_id", "route_code", "p.coverage_day", "p.coverage_weeks", "p.freq")


def blank_default_q(spark, sf_dir):
    n = _t(spark, sf_dir).new_customer
    return n.select("customer_id", F.col("is_new").alias("is_new_raw"),
                    default_if_blank("is_new", "YES").alias("is_new"))


def tolerant_numeric_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    inv = t.invoice.select("doc_no", strip_retired_suffix("sku").alias("sku"), "qty")
    x = O.lookup(inv, t.free_goods, "sku", ["case_size"], how="inner")
    return finish(x.select("doc_no", "sku", "qty", "case_size",
                           safe_div(tolerant_number("qty"), "case_size").alias("per_case")))


def tolerant_text_q(spark, sf_dir):
    inv = _t(spark, sf_dir).invoice
    text = (F.when(F.col("uom") == "Subcase", F.concat(F.col("qty").cast("string"), F.lit(" pcs")))
            .when(F.col("uom") == "Piece", "").otherwise(F.col("qty").cast("string")))
    return inv.select("doc_no", "sku", "uom", tolerant_number(text).cast("double").alias("qty"))


def complete_references_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    whole = O.drop_incomplete(t.free_goods).select(F.lit("free_goods").alias("table_name"), F.col("sku").alias("key"))
    some = O.drop_incomplete(t.customer, ["rep_id", "status"]).select(F.lit("customer").alias("table_name"),
                                                                      F.col("customer_id").alias("key"))
    return O.union_all([whole, some])


def date_parse_format_q(spark, sf_dir):
    c = _t(spark, sf_dir).customer
    d = parse_created_date("created")
    return finish(c.select("customer_id", "created", d.alias("created_on"), date_label(d).alias("created_label"),
                           d.isNull().alias("rejected")))


# --- joins -----------------------------------------------------------------

def enrich_left_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    inv = t.invoice.select("doc_no", "sku", "customer_id", "qty")
    return finish(O.lookup(inv, t.customer, "customer_id", ["channel", "rep_id"]))


def calendar_inner_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    so = t.sales_order.select("order_no", "sku", "txn_date")
    return finish(O.attach_calendar(so, t.calendar))


def price_outer_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    nonvan, van = R.price_lists(t.price, DEMO_PARAMS)
    return finish(FX.price_reference(nonvan, van))


def deduct_invoices_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    return finish(O.deduct(t.invoice, t.deductions, "invoice_key").select("doc_no", "sku", "qty"))


def deduct_sieved_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    return finish(O.deduct_sieved(t.invoice, t.deductions, "invoice_key").select("doc_no", "sku", "qty"))


def deducted_only_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    return finish(O.only_deducted(t.invoice, t.deductions, "invoice_key").select("doc_no", "sku", "qty"))


def deduct_orders_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    return finish(FX.invoiced_orders(t.sales_order, t.invoice, t.deductions))


# --- aggregation, windows, set operations ----------------------------------

def returns_pivot_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    return finish(FX.returns_pivot(t.returns, t.deductions))


def returns_pivot_coarse_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    ret = FX.clean_returns(t.returns, t.deductions).withColumn("month", F.date_format("txn_date", "yyyy-MM"))
    return finish(O.pivot_sum(ret, ["customer_id", "month"], "facility_class", ["BO", "FG"], "amount_vat",
                              names={"BO": "bad_returns", "FG": "good_returns"}))


def price_list_nonvan_q(spark, sf_dir):
    return finish(R.price_lists(_t(spark, sf_dir).price, DEMO_PARAMS)[0])


def price_list_van_q(spark, sf_dir):
    return finish(R.price_lists(_t(spark, sf_dir).price, DEMO_PARAMS)[1])


def non_null_counts_q(spark, sf_dir):
    return O.non_null_counts(_t(spark, sf_dir).deductions)


def report_totals_q(spark, sf_dir):
    r = R.net_invoiced(_t(spark, sf_dir), DEMO_PARAMS)
    tot = O.totals(r, ["net_value", "good_returns", "bad_returns", "volume"])
    return finish(tot.withColumn("volume", F.round("volume", 4)))


def extract_counts_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    return O.row_counts({n: t[n] for n in ["invoice", "returns", "sales_order", "customer", "route", "price",
                                           "deductions"]})


def column_profile_q(spark, sf_dir):
    r = R.net_invoiced(_t(spark, sf_dir), DEMO_PARAMS)
    return O.text_widths(r, ["branch", "customer_name", "category", "sku", "sku_name", "gt_channel"])


def latest_customer_row_q(spark, sf_dir):
    c = _t(spark, sf_dir).customer.select("customer_id", "status", "created")
    return finish(O.first_per_key(c.withColumn("created_on", parse_created_date("created")),
                                  ["customer_id"], ["created_on"]))


def sku_union_first_q(spark, sf_dir):
    return R.product_catalogue(_t(spark, sf_dir))


def uncategorized_skus_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    return O.uncategorized(R.product_catalogue(t), t.category)


def sorted_report_q(spark, sf_dir):
    r = R.net_sellout(_t(spark, sf_dir), DEMO_PARAMS)
    return finish(r.orderBy(*[F.col(c).asc_nulls_last() for c in ["txn_date", "doc_no", "sku"]]))


def union_by_name_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    inv = t.invoice.select("doc_no", "sku", "qty", "item_type")
    ret = t.returns.select("doc_no", "sku", "qty", "return_type")
    return finish(O.union_all([inv, ret]))


def category_upsert_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    updates = O.uncategorized(R.product_catalogue(t), t.category).withColumn("category", F.lit("UNASSIGNED"))
    return O.upsert(t.category, updates, "sku", ["category", "sku_name"])


def category_versions_q(spark, sf_dir):
    """Two publishers start from one version; the second to commit builds on the first."""
    t = _t(spark, sf_dir)
    path = _folder(spark, "categories")
    commit_categories(spark, path, t.category)
    renamed = t.category.filter(F.col("sku").endswith("3")).withColumn("category", F.lit("THREE"))
    new = O.uncategorized(R.product_catalogue(t), t.category).withColumn("category", F.lit("UNASSIGNED"))

    def other(version: int) -> None:
        if version == 2:
            commit_categories(spark, path, new)

    commit_categories(spark, path, renamed, before_commit=other)
    return committed_categories(spark, path)


# --- reports ---------------------------------------------------------------

def volume_rule_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    prices = FX.price_reference(*R.price_lists(t.price, DEMO_PARAMS))
    f = R.enrich(FX.clean_invoices(t.invoice, t.deductions), t, prices)
    f = with_volume(f, "served", DEMO_PARAMS)
    return finish(f.select("txn_date", "customer_id", "sku", "uom", "qty", "channel", "nonvan_price", "van_price",
                           "case_size", "volume"))


def net_invoiced_q(spark, sf_dir):
    return finish(R.net_invoiced(_t(spark, sf_dir), DEMO_PARAMS))


def sales_order_q(spark, sf_dir):
    return finish(R.sales_order_report(_t(spark, sf_dir), DEMO_PARAMS))


def served_invoice_q(spark, sf_dir):
    return finish(R.served_invoice(_t(spark, sf_dir), DEMO_PARAMS))


def customer_master_q(spark, sf_dir):
    return finish(C.customer_master(_t(spark, sf_dir), DEMO_PARAMS))


DISPLAY_NAMES = {"doc_no": "document", "txn_date": "transaction_date", "rep_id": "employee", "qty": "quantity"}


def renamed_report_q(spark, sf_dir):
    r = R.net_sellout(_t(spark, sf_dir), DEMO_PARAMS)
    return finish(O.rename_columns(r, DISPLAY_NAMES, strict=True))


def net_sellout_q(spark, sf_dir):
    return finish(R.net_sellout(_t(spark, sf_dir), DEMO_PARAMS))


def loss_metrics_q(spark, sf_dir):
    return loss_metrics(_t(spark, sf_dir))


def price_fanout_q(spark, sf_dir):
    price = _t(spark, sf_dir).price
    renamed = price.filter(F.col("sku").endswith("7")).withColumn("sku_name", F.concat("sku_name", F.lit(" (new label)")))
    return price_fanout({"price": O.union_all([price, renamed])}, DEMO_PARAMS)


def daily_totals_q(spark, sf_dir):
    t = _t(spark, sf_dir)
    out = _folder(spark, "daily")
    with freed_shuffles(spark):
        write_fact_reports(t, DEMO_PARAMS, out, "2026-01-02", _folder(spark, "daily-work"))
    return report_totals(spark, out, "2026-01-02").withColumn("total", F.round("total", 4))


QUERIES: dict[str, Query] = {
    "empty_rerun": empty_rerun_q,
    "checked_parquet": checked_parquet_q,
    "rejected_cells": rejected_cells_q,
    "report_rollup": report_rollup_q,
    "deduct_sieved": deduct_sieved_q,
    "category_versions": category_versions_q,
    "ordered_write": ordered_write_q,
    "csv_read_by_name": csv_read_by_name_q,
    "optional_source": optional_source_q,
    "header_offset_ingest": header_offset_ingest_q,
    "positional_ingest": positional_ingest_q,
    "missing_tokens": missing_tokens_q,
    "workbook_columns": workbook_columns_q,
    "tolerant_text": tolerant_text_q,
    "complete_references": complete_references_q,
    "price_fanout": price_fanout_q,
    "daily_totals": daily_totals_q,
    "required_values": required_values_q,
    "null_keeping_filter": null_keeping_filter_q,
    "token_filter": token_filter_q,
    "vat_amount": vat_amount_q,
    "enrich_left": enrich_left_q,
    "calendar_inner": calendar_inner_q,
    "price_outer": price_outer_q,
    "deduct_invoices": deduct_invoices_q,
    "deducted_only": deducted_only_q,
    "deduct_orders": deduct_orders_q,
    "uncategorized_skus": uncategorized_skus_q,
    "returns_pivot": returns_pivot_q,
    "returns_pivot_coarse": returns_pivot_coarse_q,
    "price_list_nonvan": price_list_nonvan_q,
    "price_list_van": price_list_van_q,
    "non_null_counts": non_null_counts_q,
    "report_totals": report_totals_q,
    "extract_counts": extract_counts_q,
    "column_profile": column_profile_q,
    "latest_customer_row": latest_customer_row_q,
    "sku_union_first": sku_union_first_q,
    "sorted_report": sorted_report_q,
    "union_by_name": union_by_name_q,
    "category_upsert": category_upsert_q,
    "facility_extract": facility_extract_q,
    "route_decode": route_decode_q,
    "blank_default": blank_default_q,
    "tolerant_numeric": tolerant_numeric_q,
    "date_parse_format": date_parse_format_q,
    "volume_rule": volume_rule_q,
    "net_invoiced": net_invoiced_q,
    "sales_order": sales_order_q,
    "served_invoice": served_invoice_q,
    "customer_master": customer_master_q,
    "net_sellout": net_sellout_q,
    "renamed_report": renamed_report_q,
    "loss_metrics": loss_metrics_q,
    "partition_roundtrip": partition_roundtrip_q,
    "workbook_ingest": workbook_ingest_q,
}
