"""Cleaned facts: invoices, pivoted returns, invoiced sales orders, price reference."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import params as P
from ledgerline.functions import facility_code, with_vat
from ledgerline.operators import combine_prices, deduct, deduct_orders, deduct_sieved, exclude_value, keep_value, pivot_sum


def zero():
    """Decimal 0 of the money type."""
    return F.lit(0).cast("decimal(12,2)")


RETURN_PIVOT_KEYS = ["txn_date", "customer_id", "sku", "sku_name", "uom", "qty"]


def clean_invoices(invoice: DataFrame, deductions: DataFrame, sieved: bool = False) -> DataFrame:
    """Invoice lines without tax lines and deducted (document, SKU) pairs.

    With ``sieved`` a list too long to broadcast does not shuffle the lines that are surely not
    listed (:func:`ledgerline.operators.deduct_sieved`); both tables are then read more than once.

    Columns: txn_date, customer_id, sku, sku_name, uom, qty, served, bad_returns, good_returns.
    """
    inv = exclude_value(invoice, "item_type", P.TAX_ITEM_TYPE)
    inv = (deduct_sieved if sieved else deduct)(inv, deductions, "invoice_key")
    return inv.select(
        "txn_date",
        "customer_id",
        F.col("sku").cast("string").alias("sku"),
        "sku_name",
        "uom",
        "qty",
        F.coalesce(F.col("amount"), zero()).alias("served"),
        zero().alias("bad_returns"),
        zero().alias("good_returns"),
    )


def clean_returns(returns: DataFrame, deductions: DataFrame, vat: Decimal = P.VAT_MULTIPLIER, sieved: bool = False) -> DataFrame:
    """Return lines without deducted pairs, with VAT amount and BO/FG facility class; ``sieved`` as in :func:`clean_invoices`."""
    ret = returns.withColumn("amount", F.coalesce(F.col("amount"), zero()))
    ret = (deduct_sieved if sieved else deduct)(ret, deductions, "return_key")
    return ret.select(
        *[c for c in ret.columns if c not in ("facility",)],
        facility_code("facility").alias("facility_class"),
        with_vat("amount", vat).alias("amount_vat"),
    )


def returns_pivot(returns: DataFrame, deductions: DataFrame, keys=None, vat: Decimal = P.VAT_MULTIPLIER, sieved: bool = False) -> DataFrame:
    """Returns summed per line key into bad (BO) and good (FG) columns of VAT amount.

    Rows with a missing key or an unrecognised facility drop out; returns equal in
    every key (quantity included) collapse into one row.
    """
    keys = list(keys or RETURN_PIVOT_KEYS)
    ret = clean_returns(returns, deductions, vat, sieved)
    return pivot_sum(
        ret, keys, "facility_class", list(P.FACILITIES), "amount_vat",
        names={"BO": "bad_returns", "FG": "good_returns"},
    )


def invoiced_orders(sales_order: DataFrame, invoice: DataFrame, deductions: DataFrame, vat: Decimal = P.VAT_MULTIPLIER,
                    path: str | None = None) -> DataFrame:
    """Invoiced sales-order lines minus those whose invoice line is deducted, with VAT value.

    ``path`` as in :func:`ledgerline.operators.deduct_orders`.
    """
    so = keep_value(sales_order, "status", P.INVOICED_STATUS)
    inv = exclude_value(invoice, "item_type", P.TAX_ITEM_TYPE)
    so = deduct_orders(so, inv, deductions, "invoice_key", path)
    return so.select(
        "txn_date",
        "customer_id",
        F.col("sku").cast("string").alias("sku"),
        "sku_name",
        "uom",
        "qty",
        with_vat(F.coalesce(F.col("amount"), zero()), vat).alias("value"),
    )


def price_reference(nonvan_list: DataFrame, van_list: DataFrame) -> DataFrame:
    """``(sku, nonvan_price, van_price)``: case prices of both lists, full outer on SKU."""
    a = nonvan_list.select("sku", F.col("case_price").alias("nonvan_price"))
    b = van_list.select("sku", F.col("case_price").alias("van_price"))
    return combine_prices(a, b)
