"""Schemas of the landed extracts and reference tables (our column names).

Ids are text, money and quantities exact decimals, transaction dates dates.
``created`` stays text in the customer extract: it is parsed strictly by the
customer master and unparsable values are counted. Use with
:func:`ledgerline.sources.read_table` or :func:`ledgerline.sources.ingest_workbooks`.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

DDL = {
    "invoice": "txn_date date, customer_id string, customer_name string, sku string, item_code string, "
               "sku_name string, uom string, qty decimal(12,2), amount decimal(18,4), item_type string, "
               "doc_no string, order_no string, rep_id string",
    "returns": "txn_date date, doc_no string, rep_id string, customer_id string, customer_name string, sku string, "
               "sku_name string, facility string, amount decimal(18,4), uom string, qty decimal(12,2), "
               "return_type string",
    "sales_order": "txn_date date, customer_id string, sku string, sku_name string, uom string, qty decimal(12,2), "
                   "amount decimal(18,4), status string, order_no string",
    "customer": "customer_id string, customer_name string, customer_class string, account_group string, "
                "rep_id string, rep_name string, branch string, barangay string, city string, province string, "
                "channel string, status string, retail_env string, created string",
    "route": "customer_id string, route_code string",
    "price": "sku string, sku_name string, uom string, price decimal(18,6), price_class string, channel string",
    "category": "sku string, sku_name string, category string",
    "supervisor": "rep_id string, supervisor string",
    "calendar": "txn_date date, week int",
    "classification": "customer_class string, classification string",
    "gt_channel": "customer_class string, gt_channel string",
    "new_customer": "customer_id string, is_new string",
    "deductions": "invoice_key string, return_key string",
    "free_goods": "sku string, case_size decimal(12,2)",
}


def schema(name: str) -> StructType:
    """The schema of one extract or reference table."""
    return StructType.fromDDL(DDL[name])


TABLES = list(DDL)
