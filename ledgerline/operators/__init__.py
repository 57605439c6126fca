"""DataFrame -> DataFrame operators: filters, joins, aggregation, first-per-key, set ops, quality."""

from ledgerline.operators.aggregate import missing_counts, non_null_counts, pivot_sum, rollup_totals, row_counts, text_widths, totals
from ledgerline.operators.filters import drop_incomplete, exclude_value, keep_token, keep_value, rename_columns
from ledgerline.operators.joins import (
    attach_calendar,
    bounded_broadcast,
    combine_prices,
    deduct,
    deduct_orders,
    deduct_sieved,
    lookup,
    only_deducted,
    only_deducted_sieved,
)
from ledgerline.operators.quality import assert_unique, existing_categories, key_fanout, key_fanouts, rejected_cells, uncategorized
from ledgerline.operators.setops import union_all, upsert
from ledgerline.operators.window import first_per_key

__all__ = [
    "assert_unique",
    "attach_calendar",
    "bounded_broadcast",
    "combine_prices",
    "deduct",
    "deduct_orders",
    "deduct_sieved",
    "drop_incomplete",
    "exclude_value",
    "existing_categories",
    "first_per_key",
    "keep_token",
    "keep_value",
    "key_fanout",
    "key_fanouts",
    "lookup",
    "missing_counts",
    "non_null_counts",
    "only_deducted",
    "only_deducted_sieved",
    "pivot_sum",
    "rename_columns",
    "rejected_cells",
    "rollup_totals",
    "row_counts",
    "text_widths",
    "totals",
    "uncategorized",
    "union_all",
    "upsert",
]
