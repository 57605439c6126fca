"""Scalar column functions used by the operators and reports.

Null handling follows the source reports: a not-equal test keeps missing values,
membership of a missing value is false, tolerant numbers turn bad text into NULL
and guarded division yields NULL instead of failing under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline import params as P


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ne_keep_null(c: Column | str, value) -> Column:
    """``c != value`` where a missing ``c`` counts as different (kept).

    Plans as ``NOT (c <=> value)``, which Parquet receives as a pushed filter.
    """
    return ~_col(c).eqNullSafe(F.lit(value))


def in_values(c: Column | str, values: Iterable) -> Column:
    """Literal-set membership that is false, never NULL, for a missing value."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def is_blank(c: Column | str) -> Column:
    """Missing, empty or whitespace only."""
    c = _col(c)
    return c.isNull() | F.coalesce(c.rlike(r"^\s*$"), F.lit(False))


def default_if_blank(c: Column | str, default: str) -> Column:
    c = _col(c)
    return F.when(is_blank(c), F.lit(default)).otherwise(c)


def tolerant_number(c: Column | str) -> Column:
    """Numeric value as double; unparsable text becomes NULL."""
    return _col(c).try_cast("double")


def safe_div(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double, NULL when ``den`` is 0 or missing."""
    num, den = _col(num).cast("double"), _col(den).cast("double")
    return F.when(den != 0, num / den)


def with_vat(amount: Column | str, multiplier: Decimal = P.VAT_MULTIPLIER) -> Column:
    """Exact VAT-inclusive amount (decimal times decimal literal)."""
    return _col(amount) * F.lit(multiplier)


def doc_key(doc: Column | str, sku: Column | str) -> Column:
    """Deduction key ``<document>_<sku>``; NULL if either part is missing, so it never matches."""
    return F.concat(_col(doc).cast("string"), F.lit(P.DEDUCTION_KEY_SEPARATOR), _col(sku).cast("string"))


def strip_retired_suffix(sku: Column | str) -> Column:
    """Remove every occurrence of the retired-code suffix from a SKU code."""
    return F.replace(_col(sku), F.lit(P.RETIRED_SKU_SUFFIX), F.lit(""))


def facility_code(facility: Column | str) -> Column:
    """Return facility class BO/FG: virtual warehouses count as FG, anything else is NULL."""
    f = F.replace(_col(facility), F.lit(P.VIRTUAL_FACILITY), F.lit(P.VIRTUAL_FACILITY_AS))
    return F.nullif(F.regexp_extract(f, P.FACILITY_PATTERN, 1), F.lit(""))


def route_parts(code: Column | str) -> Column:
    """Decode a route code ``<route>_<day>_<weeks...>`` into coverage day, weeks and frequency."""
    parts = F.split(_col(code), P.ROUTE_SEPARATOR)
    day = F.coalesce(F.get(parts, 1), F.lit(""))
    raw_weeks = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), P.ROUTE_SEPARATOR)
    weeks = raw_weeks
    for pattern, label in reversed(P.ROUTE_WEEK_LABELS):
        weeks = F.when(raw_weeks == pattern, F.lit(label)).otherwise(weeks)
    biweekly = F.lit(False)
    for token in P.BIWEEKLY_TOKENS:
        biweekly = biweekly | weeks.contains(token)
    freq = (
        F.when(weeks.contains(P.WEEKLY_TOKEN), F.lit(P.WEEKLY_FREQ))
        .when(biweekly, F.lit(P.BIWEEKLY_FREQ))
        .otherwise(F.lit(""))
    )
    return F.struct(day.alias("coverage_day"), weeks.alias("coverage_weeks"), freq.alias("freq"))


def parse_created_date(text: Column | str) -> Column:
    """Strict ``MM/dd/yyyy`` parse; bad text becomes NULL (count it with a quality metric)."""
    return F.try_to_date(_col(text), P.CREATED_DATE_FORMAT)


def date_label(d: Column | str) -> Column:
    """``January 2, 2026`` style label used in report names."""
    return F.date_format(_col(d), P.REPORT_DATE_LABEL)
