"""Column expressions (all JVM built-ins; no Python in the row path)."""

from ledgerline.functions.columns import (
    date_label,
    default_if_blank,
    doc_key,
    facility_code,
    in_values,
    is_blank,
    ne_keep_null,
    parse_created_date,
    route_parts,
    safe_div,
    strip_retired_suffix,
    tolerant_number,
    with_vat,
)

__all__ = [
    "date_label",
    "default_if_blank",
    "doc_key",
    "facility_code",
    "in_values",
    "is_blank",
    "ne_keep_null",
    "parse_created_date",
    "route_parts",
    "safe_div",
    "strip_retired_suffix",
    "tolerant_number",
    "with_vat",
]
