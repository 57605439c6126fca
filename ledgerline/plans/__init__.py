"""Report plans: the cleaned facts, the shared enrichment and the seven reports."""

from ledgerline.plans.customers import customer_master
from ledgerline.plans.facts import clean_invoices, clean_returns, invoiced_orders, price_reference, returns_pivot
from ledgerline.plans.reports import (
    net_invoiced,
    net_sellout,
    price_lists,
    product_catalogue,
    sales_order_report,
    served_invoice,
)
from ledgerline.plans.volume import with_volume

__all__ = [
    "clean_invoices",
    "clean_returns",
    "customer_master",
    "invoiced_orders",
    "net_invoiced",
    "net_sellout",
    "price_lists",
    "price_reference",
    "product_catalogue",
    "returns_pivot",
    "sales_order_report",
    "served_invoice",
    "with_volume",
]
