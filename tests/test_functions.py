"""Scalar column functions: null rules and text decoding."""

from decimal import Decimal


from ledgerline.functions import (
    date_label,
    default_if_blank,
    doc_key,
    facility_code,
    in_values,
    ne_keep_null,
    parse_created_date,
    route_parts,
    safe_div,
    strip_retired_suffix,
    tolerant_number,
    with_vat,
)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_not_equal_keeps_missing(spark):
    df = spark.createDataFrame([("A",), ("TAX",), (None,)], "t string")
    assert sorted(rows(df.filter(ne_keep_null("t", "TAX")), "t"), key=str) == [("A",), (None,)]


def test_membership_of_missing_is_false(spark):
    df = spark.createDataFrame([("Case",), ("Piece",), (None,)], "u string")
    out = rows(df.select("u", in_values("u", ["Case"]).alias("m"), (~in_values("u", ["Case"])).alias("n")), "u", "m", "n")
    assert sorted(out, key=str) == [("Case", True, False), ("Piece", False, True), (None, False, True)]


def test_facility_classes(spark):
    cases = [("MAIN BO", "BO"), ("Virtual WH", "FG"), ("MAIN FG", "FG"), ("BO FG", "BO"), ("FG_1", None),
             ("VirtualWH", None), (None, None), ("Virtual BO", "FG")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "f string")
    got = dict(rows(df.select("f", facility_code("f").alias("c")), "f", "c"))
    assert got == dict(cases)


def test_route_decode(spark):
    cases = {
        "R1_TUE_WKLY": ("TUE", "WKLY", "F4"),
        "R1_MON_WK1_WK3": ("MON", "W1&W3", "F2"),
        "R1_WED_WK2_WK4": ("WED", "W2&W4", "F2"),
        "R1_THU_WK1": ("THU", "WK1", "F2"),
        "R1_FRI": ("FRI", "", ""),
        "R1": ("", "", ""),
        "R1_SAT_X_Y": ("SAT", "X_Y", ""),
        "R1__WKLY": ("", "WKLY", "F4"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "code string")
    out = df.select("code", route_parts("code").alias("p")).select("code", "p.*").collect()
    assert {r.code: (r.coverage_day, r.coverage_weeks, r.freq) for r in out} == cases


def test_blank_default(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("NO",)], "v string")
    assert sorted(r.d for r in df.select(default_if_blank("v", "YES").alias("d")).collect()) == ["NO", "YES", "YES",
                                                                                                   "YES"]


def test_tolerant_number_and_guarded_division(spark):
    df = spark.createDataFrame([("abc", 2.0), ("6", 0.0), ("6", 3.0), (None, 1.0)], "q string, d double")
    out = rows(df.select(tolerant_number("q").alias("n"), safe_div(tolerant_number("q"), "d").alias("r")), "n", "r")
    assert out == [(None, None), (6.0, None), (6.0, 2.0), (None, None)]


def test_doc_key_missing_part_is_null(spark):
    df = spark.createDataFrame([("D1", "S1"), ("D1", None), (None, "S1")], "d string, s string")
    assert [r.k for r in df.select(doc_key("d", "s").alias("k")).collect()] == ["D1_S1", None, None]


def test_vat_is_exact(spark):
    df = spark.createDataFrame([(Decimal("10.01"),)], "a decimal(12,2)")
    assert df.select(with_vat("a").alias("v")).first().v == Decimal("11.2112")


def test_strip_suffix_and_dates(spark):
    df = spark.createDataFrame([("100_old", "01/02/2026"), ("200", "12/31/2025"), ("300", "bad")], "s string, c string")
    out = df.select(strip_retired_suffix("s").alias("s"), parse_created_date("c").alias("d"),
                    date_label(parse_created_date("c")).alias("l")).collect()
    assert [r.s for r in out] == ["100", "200", "300"]
    assert [str(r.d) for r in out] == ["2026-01-02", "2025-12-31", "None"]
    assert [r.l for r in out] == ["January 2, 2026", "December 31, 2025", None]
