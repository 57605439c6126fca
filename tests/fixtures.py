"""Small literal extracts covering the report rules (FIXTURES.md cases)."""

from datetime import date
from decimal import Decimal as D

from ledgerline.schemas import DDL

INVOICE, RETURNS, SALES_ORDER, CUSTOMER = DDL["invoice"], DDL["returns"], DDL["sales_order"], DDL["customer"]

D1, D2, SUNDAY = date(2026, 1, 5), date(2026, 1, 6), date(2026, 1, 4)


def tables(spark):
    t = {}
    t["invoice"] = spark.createDataFrame([
        (D1, "C1", "One", "100_old", "KX100", "Widget", "Piece", D("10"), D("112.00"), "ITM_GOODS", "I1", "O1", "E1"),
        (D1, "C1", "One", "200", "KX200", "Gadget", "Case", D("2"), D("50.00"), None, "I1", "O1", "E1"),
        (D1, "C1", "One", "300", "AB300", "Gizmo", "Case", D("1"), D("5.00"), "ITM_SALES_TAX", "I1", "O1", "E1"),
        (D2, "C2", "Two", "200", "KX200", "Gadget", "Case", D("4"), D("100.00"), "ITM_GOODS", "I2", "O2", "E2"),
        (D2, "C2", "Two", "400", "KX400", "Thing", "Piece", D("3"), D("30.00"), "ITM_GOODS", "I2", "O2", "E2"),
        (SUNDAY, "C2", "Two", "200", "KX200", "Gadget", "Case", D("1"), D("25.00"), "ITM_GOODS", "I3", "O3", "E2"),
    ], INVOICE)
    t["returns"] = spark.createDataFrame([
        (D1, "R1", "E1", "C1", "One", "200", "Gadget", "MAIN BO", D("10.00"), "Case", D("1"), "BAD_ORDER"),
        (D1, "R1", "E1", "C1", "One", "200", "Gadget", "MAIN BO", D("10.00"), "Case", D("1"), "BAD_ORDER"),
        (D1, "R2", "E1", "C1", "One", "200", "Gadget", "Virtual WH", D("20.00"), "Case", D("1"), "CUSTOMER_RETURN"),
        (D1, "R3", "E1", "C1", "One", "200", "Gadget", "FG_1", D("99.00"), "Case", D("1"), None),
        (D1, "R4", "E1", "C1", "One", "200", "Gadget", "MAIN FG", D("5.00"), None, D("1"), None),
    ], RETURNS)
    t["sales_order"] = spark.createDataFrame([
        (D1, "C1", "100_old", "Widget", "Piece", D("10"), D("100.00"), "Invoiced", "O1"),
        (D1, "C1", "200", "Gadget", "Case", D("2"), D("40.00"), "Invoiced", "O1"),
        (D2, "C2", "200", "Gadget", "Case", D("4"), D("80.00"), "Open", "O2"),
    ], SALES_ORDER)
    t["customer"] = spark.createDataFrame([
        ("C1", "One", "RETAIL", "KEY", "E1", "Rep1", "North", "B1", "Town", "Prov", "VAN(EXTRUCK)", "Active/Approved",
         "URBAN", "01/02/2026"),
        ("C2", "Two", "WHOLESALE", "REG", "E2", "Rep2", "South", "B2", "City", "Prov", "BOOK(Booking)",
         "Blocked/On hold", "RURAL", "12/31/2025"),
        ("C3", "Three", "RETAIL", "REG", None, "Rep3", "South", "B3", "City", "Prov", "BOOK(Booking)",
         "Approval On Hold", "RURAL", "12/31/2025"),
        ("C4", "Four", "RETAIL", "REG", "E1", "Rep1", "South", "B3", "City", "Prov", "BOOK(Booking)", None, "RURAL",
         "bad"),
        ("S1", "Special", "RETAIL", "REG", "E1", "Rep1", "South", "B3", "City", "Prov", "BOOK(Booking)",
         "Active/Approved", "RURAL", "03/01/2024"),
    ], CUSTOMER)
    t["route"] = spark.createDataFrame([("C1", "R1_TUE_WKLY"), ("C2", "R2_MON_WK1_WK3"), ("C4", "R9")],
                                       "customer_id string, route_code string")
    t["price"] = spark.createDataFrame([
        ("100", "Widget", "Case", D("100.00"), "Regular", "BOOK(Booking)"),
        ("100", "Widget", "Case", D("200.00"), "Regular", "VAN(EXTRUCK)"),
        ("200", "Gadget", "Case", D("50.00"), "Regular", "BOOK(Booking)"),
        ("200", "Gadget", "Case", D("50.00"), None, "BOOK(Booking)"),
        ("200", "Gadget", "Case", D("999.00"), "BEV Dealer", "BOOK(Booking)"),
        ("200", "Gadget", "Piece", D("5.00"), "Regular", "BOOK(Booking)"),
        ("200", "Gadget", "Case", D("25.00"), "Regular", "VAN(EXTRUCK)"),
    ], "sku string, sku_name string, uom string, price decimal(12,2), price_class string, channel string")
    t["category"] = spark.createDataFrame([("100_old", "Widget", "Tools"), ("200", "Gadget", "Toys"),
                                           ("400", "Thing", " ")], "sku string, sku_name string, category string")
    t["supervisor"] = spark.createDataFrame([("E1", "Sup1"), ("E2", "Sup2"), (None, "Orphan")],
                                            "rep_id string, supervisor string")
    t["calendar"] = spark.createDataFrame([(D1, 2), (D2, 2)], "txn_date date, week int")
    t["classification"] = spark.createDataFrame([("RETAIL", "CL-R"), ("WHOLESALE", None)],
                                                "customer_class string, classification string")
    t["gt_channel"] = spark.createDataFrame([("RETAIL", "GT-R")], "customer_class string, gt_channel string")
    t["new_customer"] = spark.createDataFrame([("C1", "NO"), ("C2", "  ")], "customer_id string, is_new string")
    t["deductions"] = spark.createDataFrame([("I2_400", None), (None, "R4_200"), (None, None)],
                                            "invoice_key string, return_key string")
    t["free_goods"] = spark.createDataFrame([("200", D("0")), ("400", D("3"))], "sku string, case_size decimal(12,2)")
    return t
