"""The fact reports: net invoiced, sales order, served invoice, net sell-out, price lists.

Each takes the extract and reference DataFrames and returns the report rows,
unsorted; :func:`ledgerline.sources.write_report` orders them at the sink.
Money and quantities stay exact decimals (sums and totals are exact); volume is a
double quotient.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import params as P
from ledgerline.functions import strip_retired_suffix, with_vat
from ledgerline.operators import (
    attach_calendar,
    bounded_broadcast,
    exclude_value,
    first_per_key,
    keep_token,
    keep_value,
    lookup,
    pivot_sum,
    union_all,
)
from ledgerline.params import Params
from ledgerline.plans.facts import (
    RETURN_PIVOT_KEYS,
    clean_invoices,
    clean_returns,
    invoiced_orders,
    price_reference,
    returns_pivot,
    zero,
)
from ledgerline.plans.volume import with_volume
from ledgerline.session import delete_path
from ledgerline.sources.order import split, split_by_pass, split_path, splits

CUSTOMER_COLS = [
    "customer_name", "customer_class", "account_group", "rep_id", "rep_name",
    "branch", "barangay", "city", "province", "channel",
]

NET_INVOICED_COLS = [
    "distributor", "txn_date", "week", "branch", "rep_id", "rep_name", "account_group", "customer_id",
    "customer_name", "category", "sku", "sku_name", "volume", "net_value", "good_returns", "bad_returns",
    "customer_class", "barangay", "town", "province", "supervisor", "route_model", "gt_channel",
]

ORDER_REPORT_COLS = [
    "distributor", "txn_date", "week", "branch", "rep_id", "rep_name", "account_group", "customer_id",
    "customer_name", "category", "sku", "sku_name", "volume", "value", "supervisor", "customer_class",
]

SELLOUT_COLS = ["doc_no", "txn_date", "rep_id", "customer_id", "customer_name", "sku", "sku_name", "uom", "qty"]

PRICE_LIST_COLS = ["sku", "sku_name", "case_price", "subcase_price", "piece_price"]

# Sink order: the source reports' keys first, then tie-breakers. The extra keys
# make the order total (reruns write identical files) and let the range
# partitioner split a date that holds a large share of all rows.
REPORT_ORDER = {
    "net_invoiced": ["txn_date", "customer_id", "sku", "sku_name", "net_value"],
    "sales_order": ["txn_date", "customer_id", "sku", "sku_name", "value"],
    "served_invoice": ["txn_date", "customer_id", "sku", "sku_name", "value"],
    "net_sellout": ["txn_date", "doc_no", "sku", "qty"],
    "customer_master": ["created_on", "customer_id"],
}
# First keys that net invoiced, sales order and served invoice have in common: their passes are parted by them.
PASS_KEYS = REPORT_ORDER["net_invoiced"][:4]


def price_lists(price: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """(non-van list, van list): VAT case/subcase/piece prices per SKU and description.

    Excluded price classes are removed (missing class kept). Several remaining
    classes of one SKU add up, as the source pivot does.
    """
    p = price.withColumn("price_vat", with_vat("price", params.vat_multiplier))
    p = exclude_value(p, "price_class", P.EXCLUDED_PRICE_CLASS)
    names = dict(zip(params.price_uoms, ["case_price", "subcase_price", "piece_price"]))

    def pivot(df: DataFrame) -> DataFrame:
        out = pivot_sum(df, ["sku", "sku_name"], "uom", params.price_uoms, "price_vat", names=names,
                        only_listed=False)
        return out.select(F.col("sku").cast("string").alias("sku"), *PRICE_LIST_COLS[1:])

    return pivot(exclude_value(p, "channel", params.van_channel)), pivot(keep_value(p, "channel", params.van_channel))


# Rows of the price reference up to which the SKU references are joined one by one: they are then broadcast or small.
SKU_LOOKUPS_MAX_ROWS = 100_000


def sku_references(refs: Mapping[str, DataFrame], prices: DataFrame) -> DataFrame:
    """One row per SKU without its suffix: lists of its categories by raw SKU, of its case prices and of its case sizes."""
    parts = {
        "__categories": refs["category"].select(strip_retired_suffix("sku").alias("__sku"), F.struct(F.col("sku").alias("raw"), "category").alias("__categories")),
        "__prices": prices.select(F.col("sku").alias("__sku"), F.struct("nonvan_price", "van_price").alias("__prices")),
        "__sizes": refs["free_goods"].select(F.col("sku").alias("__sku"), F.struct("case_size").alias("__sizes")),
    }
    rows = None
    for df in parts.values():
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    return rows.filter(F.col("__sku").isNotNull()).groupBy("__sku").agg(*[F.collect_list(c).alias(c) for c in parts])


def with_sku_references(facts: DataFrame, refs: Mapping[str, DataFrame], prices: DataFrame) -> DataFrame:
    """``category`` of the raw SKU, and case prices and case size of the SKU without its suffix, which replaces it.

    The three are lookups by keys that share the bare SKU, so the facts are shuffled once for
    them, not once for each. As with :func:`ledgerline.operators.lookup`, repeated reference keys fan the facts out.
    """
    f = facts.withColumn("__sku", strip_retired_suffix("sku")).join(sku_references(refs, prices), "__sku", "left")
    f = f.withColumn("__categories", F.filter("__categories", lambda c: c["raw"] == F.col("sku")))
    taken = {"__categories": ["category"], "__prices": ["nonvan_price", "van_price"], "__sizes": ["case_size"]}
    for held, cols in taken.items():
        kept = [c for c in f.columns if c != held]
        # explode_outer keeps a fact without an entry.
        f = f.select(*kept, F.explode_outer(held).alias(held)).select(*kept, *[F.col(held)[c].alias(c) for c in cols])
    return f.withColumn("sku", F.col("__sku")).drop("__sku")


def enrich(facts: DataFrame, refs: Mapping[str, DataFrame], prices: DataFrame) -> DataFrame:
    """Customer, category, supervisor, calendar week, case prices and free-goods case size.

    The calendar inner join goes first: it only removes rows and commutes with the
    left joins, so the customer join shuffles fewer rows. The category joins on
    the raw SKU, prices and free goods on the SKU without the retired-code suffix: one by
    one where the references are small, else together. The customer's columns, which widen a
    row most, are attached last.
    """
    f = attach_calendar(facts, refs["calendar"])
    if prices.count() > SKU_LOOKUPS_MAX_ROWS:
        f = with_sku_references(f, refs, prices)
    else:
        f = lookup(f, refs["category"], "sku", ["category"])
        f = f.withColumn("sku", strip_retired_suffix("sku"))
        f = lookup(f, prices, "sku", ["nonvan_price", "van_price"])
        f = lookup(f, refs["free_goods"], "sku", ["case_size"])
    f = lookup(f, refs["customer"], "customer_id", CUSTOMER_COLS)
    return lookup(f, refs["supervisor"], "rep_id", ["supervisor"])


def case_prices(refs: Mapping[str, DataFrame], params: Params, path: str | None = None) -> DataFrame:
    """Case-price reference ``(sku, nonvan_price, van_price)``, written once (to ``path``, if given)
    and broadcast to the fact joins when it is within ``params.broadcast_max_rows`` rows and
    ``params.broadcast_max_bytes`` bytes."""
    nonvan, van = price_lists(refs["price"], params)
    return bounded_broadcast(price_reference(nonvan, van), params.broadcast_max_rows, params.broadcast_max_bytes, path)


def _prices(refs: Mapping[str, DataFrame], params: Params, prices: DataFrame | None) -> DataFrame:
    return prices if prices is not None else case_prices(refs, params)


def enriched_invoices(refs: Mapping[str, DataFrame], prices: DataFrame, sieved: bool = False) -> DataFrame:
    """Cleaned, enriched invoice lines: the rows that net invoiced and served invoice share.

    ``sieved`` as in :func:`ledgerline.plans.facts.clean_invoices`.
    """
    return enrich(clean_invoices(refs["invoice"], refs["deductions"], sieved), refs, prices)


def return_lines(refs: Mapping[str, DataFrame], params: Params, sieved: bool = False) -> DataFrame:
    """Pivoted returns with the columns of cleaned invoice lines; ``sieved`` as for those."""
    return returns_pivot(refs["returns"], refs["deductions"], vat=params.vat_multiplier, sieved=sieved).withColumn("served", zero())


def net_lines(refs: Mapping[str, DataFrame], params: Params, sieved: bool = False) -> DataFrame:
    """Cleaned invoice lines and, marked ``returned``, pivoted returns; with ``sieved`` the returns' deductions are sieved too."""
    maybe = params.broadcast_max_rows > 0
    invoices = clean_invoices(refs["invoice"], refs["deductions"], sieved=maybe)
    returns = return_lines(refs, params, sieved and maybe)
    return union_all([invoices.withColumn("returned", F.lit(False)), returns.withColumn("returned", F.lit(True))])


def enriched_by_pass(facts: DataFrame, refs: Mapping[str, DataFrame], prices: DataFrame, like: DataFrame, bounds: list,
                     path: str) -> list[DataFrame]:
    """:func:`enrich` for facts whose shuffles should not fill the disk, staged at ``path``: a table for each of the report's passes.

    The facts are staged by customer, each part is enriched with its own customers and added to
    the passes that it has rows of (:func:`ledgerline.sources.order.pass_bounds` of ``like``, by
    ``PASS_KEYS``). Shuffles thus hold a part of the facts; references by SKU meet every part.
    """
    spark = facts.sparkSession
    count = len(bounds) + 1
    number = F.pmod(F.xxhash64(F.col("customer_id").cast("string")), F.lit(count))
    split(facts, number, f"{path}/facts")
    out = None
    for i, part in enumerate(splits(spark, f"{path}/facts", facts.schema, count)):
        own = ChainMap({"customer": refs["customer"].filter(number == i)}, refs)
        out = enrich(part, own, prices)
        split_by_pass(out, PASS_KEYS, bounds, like, f"{path}/rows", part.count())
        delete_path(spark, split_path(f"{path}/facts", i))
    return splits(spark, f"{path}/rows", out.schema, len(bounds) + 1)


def net_invoiced(refs: Mapping[str, DataFrame], params: Params, prices: DataFrame | None = None,
                 invoices: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Invoices plus pivoted returns, enriched, with net value and volume.

    ``invoices`` are staged :func:`enriched_invoices`, ``lines`` staged, enriched
    :func:`net_lines`; without either, invoices and returns are enriched together in one pass.
    """
    if lines is not None:
        f = lines
    else:
        prices = _prices(refs, params, prices)
        if invoices is None:
            f = enrich(net_lines(refs, params), refs, prices)
        else:
            f = union_all([invoices, enrich(return_lines(refs, params), refs, prices)])
    f = f.withColumn("net_value", F.col("served") - F.col("bad_returns") - F.col("good_returns"))
    f = with_volume(f, "net_value", params)
    f = lookup(f, refs["gt_channel"], "customer_class", ["gt_channel"])
    f = f.withColumns({
        "distributor": F.lit(params.distributor),
        "town": F.col("city"),
        "route_model": F.col("channel"),
    })
    return f.select(*NET_INVOICED_COLS)


def _order_report(enriched: DataFrame, value: str, params: Params) -> DataFrame:
    f = with_volume(enriched, value, params)
    f = f.withColumns({"distributor": F.lit(params.distributor), "value": F.col(value)})
    return f.select(*ORDER_REPORT_COLS)


def sales_order_report(refs: Mapping[str, DataFrame], params: Params, prices: DataFrame | None = None,
                       orders: DataFrame | None = None) -> DataFrame:
    """Invoiced sales orders minus carried deductions, VAT value and volume; ``orders`` are staged, enriched order lines."""
    if orders is None:
        so = invoiced_orders(refs["sales_order"], refs["invoice"], refs["deductions"], params.vat_multiplier)
        orders = enrich(so, refs, _prices(refs, params, prices))
    return _order_report(orders, "value", params)


def served_invoice(refs: Mapping[str, DataFrame], params: Params, prices: DataFrame | None = None,
                   invoices: DataFrame | None = None) -> DataFrame:
    """Invoices only (no returns), served value and volume; ``invoices`` as in :func:`net_invoiced`."""
    if invoices is None:
        invoices = enriched_invoices(refs, _prices(refs, params, prices), sieved=params.broadcast_max_rows > 0)
    return _order_report(invoices, "served", params)


def net_sellout(refs: Mapping[str, DataFrame], params: Params) -> DataFrame:
    """Invoice quantities and negated return quantities per document line.

    Tax lines and customer-return-type returns are excluded (missing types kept);
    in token mode only product codes containing the token remain. Deductions do
    not apply here.
    """
    inv = exclude_value(refs["invoice"], "item_type", P.TAX_ITEM_TYPE).select(
        "doc_no", "txn_date", "rep_id", "customer_id", "customer_name",
        F.col("item_code").cast("string").alias("sku"), "sku_name", "uom", "qty",
    )
    ret = exclude_value(refs["returns"], "return_type", P.CUSTOMER_RETURN_TYPE).select(
        "doc_no", "txn_date", "rep_id", "customer_id", "customer_name",
        F.col("sku").cast("string").alias("sku"), "sku_name", "uom", (-F.abs(F.col("qty"))).alias("qty"),
    )
    inv = keep_token(inv, "sku", params.product_token, params.token_mode)
    ret = keep_token(ret, "sku", params.product_token, params.token_mode)
    return union_all([inv, ret]).select(*SELLOUT_COLS)


def product_catalogue(refs: Mapping[str, DataFrame]) -> DataFrame:
    """One ``(sku, sku_name)`` per SKU seen in invoices, returns and invoiced orders.

    Invoice names win over return names over order names; within one source the
    smallest name wins (the source's file order does not exist here). A return
    line contributes exactly when it survives the returns pivot (all pivot keys
    present, facility recognised), so those rows are read directly instead of
    aggregating the pivot first.
    """
    inv = clean_invoices(refs["invoice"], refs["deductions"]).select("sku", "sku_name", F.lit(0).alias("source"))
    ret = clean_returns(refs["returns"], refs["deductions"])
    keep = F.col("facility_class").isin(list(P.FACILITIES))
    for k in RETURN_PIVOT_KEYS:
        keep = keep & F.col(k).isNotNull()
    ret = ret.filter(keep).select("sku", "sku_name", F.lit(1).alias("source"))
    so = invoiced_orders(refs["sales_order"], refs["invoice"], refs["deductions"]).select(
        "sku", "sku_name", F.lit(2).alias("source"))
    # A count per (sku, source, name) first: a hash aggregate with map-side combine, which the
    # optimizer keeps (it would drop a plain distinct), so the sort-based step sees few rows.
    names = union_all([inv, ret, so]).groupBy("sku", "source", "sku_name").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 0")
    return first_per_key(names, ["sku"], ["source", "sku_name"]).select("sku", "sku_name")
