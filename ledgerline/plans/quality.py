"""Row-loss and fan-out counters for one run.

The source reports lose rows silently (missing pivot keys, unknown facilities,
dates absent from the calendar, unparsable created dates) and duplicate rows
when a reference repeats a key. These counters make both visible. Each is a
small aggregate over a table the reports read anyway.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import params as P
from ledgerline.functions import doc_key, parse_created_date
from ledgerline.operators import exclude_value, keep_value, key_fanouts, union_all
from ledgerline.params import Params
from ledgerline.plans.facts import RETURN_PIVOT_KEYS, clean_returns, price_reference
from ledgerline.plans.reports import price_lists


# Reference name -> the key that a lookup joins on.
LOOKUP_KEYS = {
    "customer": "customer_id", "category": "sku", "supervisor": "rep_id", "free_goods": "sku", "calendar": "txn_date",
    "gt_channel": "customer_class", "classification": "customer_class", "route": "customer_id", "new_customer": "customer_id",
}


def _marked(df: DataFrame, hits: DataFrame, key: str, mark: str) -> DataFrame:
    """``df`` with the boolean ``mark``: whether ``key`` is among the distinct keys ``hits`` (a missing key never is)."""
    hits = hits.filter(F.col(key).isNotNull()).distinct().withColumn(mark, F.lit(True))
    return df.join(hits, key, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def _rows(wide: DataFrame) -> DataFrame:
    names = wide.columns
    return wide.select(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names]).unpivot([], names, "metric", "rows")


def line_losses(refs: Mapping[str, DataFrame]) -> DataFrame:
    """Rows ``(metric, rows)``: invoice and order lines on days that the calendar lacks, one scan of each extract.

    Every line is marked (deducted, day known) and tagged with its first reason to be
    lost. Only tagged lines are shuffled, by their order and SKU, where deducted invoice
    lines take their orders' lines along before those are counted.
    """
    days = refs["calendar"].select(F.to_date("txn_date").alias("day"))
    deducted = refs["deductions"].select(F.col("invoice_key").alias("key"))
    order_key = doc_key("order_no", "sku").alias("order_key")
    inv = exclude_value(refs["invoice"], "item_type", P.TAX_ITEM_TYPE)
    inv = inv.select(F.to_date("txn_date").alias("day"), doc_key("doc_no", "sku").alias("key"), order_key)
    inv = _marked(_marked(inv, deducted, "key", "deducted"), days, "day", "known")
    inv = inv.select("order_key", F.when(F.col("deducted"), "deducted").when(~F.col("known"), "invoice").alias("reason"))
    so = keep_value(refs["sales_order"], "status", P.INVOICED_STATUS).select(F.to_date("txn_date").alias("day"), order_key)
    so = _marked(so, days, "day", "known").select("order_key", F.when(~F.col("known"), "order").alias("reason"))
    per_key = union_all([inv, so]).filter(F.col("reason").isNotNull()).groupBy("order_key").agg(
        *[F.count_if(F.col("reason") == r).alias(r) for r in ("deducted", "invoice", "order")])
    stays = F.col("order_key").isNull() | (F.col("deducted") == 0)
    return _rows(per_key.agg(F.sum("invoice").alias("invoices_not_in_calendar"),
                             F.sum(F.when(stays, F.col("order"))).alias("orders_not_in_calendar")))


def return_losses(refs: Mapping[str, DataFrame]) -> DataFrame:
    """Rows ``(metric, rows)``: return lines without a pivot key or facility class, pivot rows on unknown days; one scan."""
    days = refs["calendar"].select(F.to_date("txn_date").alias("day"))
    ret = clean_returns(refs["returns"], refs["deductions"]).withColumn("day", F.to_date("txn_date"))
    ret = _marked(ret, days, "day", "known")
    lacks_key = F.lit(False)
    for k in RETURN_PIVOT_KEYS:
        lacks_key = lacks_key | F.col(k).isNull()
    pivoted = ~lacks_key & F.col("facility_class").isin(list(P.FACILITIES))
    # A pivot row's date is one of its keys, so the lost rows are the distinct keys on unknown days.
    return _rows(ret.agg(
        F.count_if(lacks_key).alias("returns_missing_pivot_key"),
        F.count_if(~lacks_key & F.col("facility_class").isNull()).alias("returns_unknown_facility"),
        F.count_distinct(F.when(pivoted & ~F.col("known"), F.struct(*RETURN_PIVOT_KEYS))).alias("returns_not_in_calendar"),
    ))


def reference_losses(refs: Mapping[str, DataFrame]) -> DataFrame:
    """Rows ``(metric, rows)``: surplus rows per lookup key and unparsable created dates; one scan of each reference."""
    tagged = []
    for name, key in LOOKUP_KEYS.items():
        df = refs[name]
        value = F.to_date(key) if name == "calendar" else F.col(key)
        bad = parse_created_date("created").isNull() if name == "customer" else F.lit(False)
        tagged.append(df.select(F.lit(f"{name}_key_fanout").alias("metric"), value.cast("string").alias("k"), bad.cast("int").alias("bad")))
    per_key = union_all(tagged).groupBy("metric", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    surplus = F.when(F.col("k").isNotNull(), F.col("n") - 1)
    of = [F.sum(F.when(F.col("metric") == f"{name}_key_fanout", surplus)).alias(f"{name}_key_fanout") for name in LOOKUP_KEYS]
    return _rows(per_key.agg(F.sum("bad").alias("created_date_rejects"), *of))


def loss_metrics(refs: Mapping[str, DataFrame]) -> DataFrame:
    """Rows ``(metric, rows)``: what the reports lose and what references multiply, every fact extract scanned once."""
    return union_all([line_losses(refs), return_losses(refs), reference_losses(refs)])


def price_fanout(refs: Mapping[str, DataFrame], params: Params) -> DataFrame:
    """Rows ``(metric, rows)``: surplus rows per SKU of both price lists and of the joined price reference.

    A SKU listed under several descriptions has a row for each, and in the joined
    reference a row for each pair of them.
    """
    nonvan, van = price_lists(refs["price"], params)
    return key_fanouts({
        "price_nonvan_key_fanout": (nonvan, "sku"),
        "price_van_key_fanout": (van, "sku"),
        "price_reference_key_fanout": (price_reference(nonvan, van), "sku"),
    })
