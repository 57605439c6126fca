"""Run parameters and the fixed codes of the source system.

Deployment values (distributor label, special customers, product token) have no
defaults: each deployment supplies its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# Codes written by the distributor management system that the
# reports must recognise, and the labels the reports emit. Natural order.
TAX_ITEM_TYPE = "ITM_SALES_TAX"
INVOICED_STATUS = "Invoiced"
ACTIVE_STATUS = "Active/Approved"
BLOCKED_STATUS = "Blocked/On hold"
ON_HOLD_STATUS = "Approval On Hold"
EXCLUDED_PRICE_CLASS = "BEV Dealer"
VAN_CHANNEL = "VAN(EXTRUCK)"
BOOKING_CHANNEL = "BOOK(Booking)"
CUSTOMER_RETURN_TYPE = "CUSTOMER_RETURN"
CASE_UOMS = ("Case", "INF_PROD_CAS")
PRICE_UOMS = ("Case", "Subcase", "Piece")
FACILITIES = ("BO", "FG")
FACILITY_PATTERN = r"\b(FG|BO)\b"
VIRTUAL_FACILITY = "Virtual"
VIRTUAL_FACILITY_AS = "FG"
RETIRED_SKU_SUFFIX = "_old"
VAT_MULTIPLIER = Decimal("1.12")
SPECIAL_CLASSIFICATION = "H ACCT"
BLOCKED_ROUTE_TEXT = "NA"
NEW_CUSTOMER_DEFAULT = "YES"
ROUTE_SEPARATOR = "_"
ROUTE_WEEK_LABELS = (("WK1_WK3", "W1&W3"), ("WK2_WK4", "W2&W4"))
WEEKLY_TOKEN = "WKLY"
WEEKLY_FREQ = "F4"
BIWEEKLY_TOKENS = ("WK", "&")
BIWEEKLY_FREQ = "F2"
CREATED_DATE_FORMAT = "MM/dd/yyyy"
REPORT_DATE_LABEL = "MMMM d, yyyy"
DEDUCTION_KEY_SEPARATOR = "_"


@dataclass(frozen=True)
class Params:
    """Per-deployment settings of one reporting run."""

    distributor: str
    special_customers: tuple[str, ...] = ()
    product_token: str | None = None
    token_mode: str = "N"
    vat_multiplier: Decimal = VAT_MULTIPLIER
    case_uoms: tuple[str, ...] = CASE_UOMS
    price_uoms: tuple[str, ...] = PRICE_UOMS
    van_channel: str = VAN_CHANNEL
    booking_channel: str = BOOKING_CHANNEL
    # Largest price reference that is broadcast to the fact joins (rows; Parquet bytes).
    broadcast_max_rows: int = 1_000_000
    broadcast_max_bytes: int = 256 << 20

    def __post_init__(self):
        if self.token_mode not in ("Y", "N"):
            raise ValueError(f"token_mode must be 'Y' or 'N', got {self.token_mode!r}")
        if self.token_mode == "Y" and not self.product_token:
            raise ValueError("token_mode 'Y' needs a product_token")
