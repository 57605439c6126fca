"""Reports replaced by nothing, checked reads, rejected cells, workbook details, counters in one pass."""

import datetime
import io
import os
import tempfile
import zipfile
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import rollup_totals, row_counts
from ledgerline.params import Params
from ledgerline.plans import net_invoiced, price_lists
from ledgerline.plans.daily import COUNTED, REQUIRED, Watched, run_daily
from ledgerline.plans.quality import loss_metrics
from ledgerline.sources import ingest_checked, ingest_workbooks, read_checked, read_report, read_table, required_values, write_report
from ledgerline.sources.reports import date_folder
from ledgerline.sources.sheets import build_workbook, parse_workbook
from ledgerline.sources.workbook import write_workbooks
from tests.fixtures import tables


def folder(name):
    return os.path.join(tempfile.mkdtemp(prefix="ll-check-"), name)


# --- reports without rows ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("options", [{}, {"sort_by": ["k"]}, {"sort_by": ["k"], "global_order": False}, {"sort_by": ["k"], "small": True},
                                     {"fmt": "csv"}])
def test_a_date_is_replaced_also_by_nothing(spark, options):
    path = folder("report")
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", None)], "k string, v int")
    fmt = options.get("fmt", "parquet")
    assert write_report(df.filter("k > 'z'"), path, "2026-01-01", **options) == 0
    first = read_report(spark, path, fmt=fmt)
    assert first.count() == 0 and first.columns == ["k", "v", "report_date"]
    assert write_report(df, path, "2026-01-02", **options) == 3 and write_report(df, path, "2026-01-03", **options) == 3
    assert write_report(df.filter(F.lit(False)), path, "2026-01-02", **options) == 0
    assert read_report(spark, path, "2026-01-02", fmt=fmt).count() == 0
    assert read_report(spark, path, "2026-01-03", fmt=fmt).count() == 3
    assert [n for n in os.listdir(path) if n.startswith("_")] == []


def test_a_failed_write_leaves_the_date_as_it_was(spark):
    path = folder("report")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    write_report(df, path, "2026-01-02")
    with pytest.raises(Exception, match="no such day"):
        write_report(df.withColumn("v", F.raise_error(F.lit("no such day")).cast("int")), path, "2026-01-02")
    assert [r.v for r in read_report(spark, path, "2026-01-02").collect()] == [1] and os.listdir(path) == ["report_date=2026-01-02"]


def test_reading_by_schema_needs_no_files(spark):
    schema = T.StructType([T.StructField("k", T.StringType())])
    assert read_report(spark, folder("never"), "2026-01-02", schema=schema).count() == 0
    path = folder("labels")
    for label in ("a b=c", "1/2", "100%", "é"):
        write_report(spark.createDataFrame([(label,)], schema), path, label)
        assert [r.k for r in read_report(spark, path, label, schema=schema).collect()] == [label]
    assert date_folder("/x/", "1/2") == "/x/report_date=1%2F2"


def test_solved_skus_empty_the_report_and_the_run_goes_on(spark, params):
    out, t = folder("daily"), tables(spark)
    unsolved = dict(t, category=t["category"].limit(0))
    assert run_daily(unsolved, params, out, "2026-01-06", global_order=False)[f"{out}/new_skus"] > 0
    solved = dict(t, category=t["category"].withColumn("category", F.lit("X")))
    cells = spark.createDataFrame([("f", 3, "qty", "x")], "source_file string, source_row bigint, column_name string, text string")
    empty = dict(solved, invoice=t["invoice"].limit(0), returns=t["returns"].limit(0))
    written = run_daily(solved, params, out, "2026-01-06", global_order=False, rejected={"invoice": cells})
    assert written[f"{out}/new_skus"] == 0 and read_report(spark, f"{out}/new_skus", "2026-01-06").count() == 0
    assert [r.table_name for r in read_report(spark, f"{out}/rejected_cells").collect()] == ["invoice"]
    written = run_daily(empty, params, folder("first"), "2026-01-06")
    assert [n for p, n in written.items() if p.endswith("/net_invoiced")] == [0]


# --- reads -------------------------------------------------------------------------------------------------------

FREE = T.StructType([T.StructField("sku", T.StringType()), T.StructField("case_size", T.DecimalType(12, 2)), T.StructField("day", T.DateType())])


def test_checked_parquet_read(spark):
    path = folder("extract")
    spark.sql("select 7 as extra, date'2026-01-02' as day, 12 as case_size, 400L as sku").write.parquet(f"{path}/a")
    got = read_table(spark, f"{path}/a", FREE)
    assert got.schema == FREE and [tuple(r) for r in got.collect()] == [("400", D("12.00"), datetime.date(2026, 1, 2))]
    for sql, said in (("select '4' as sku, 1 as case_size", "no column day"),
                      ("select '4' as sku, 1 as case_size, timestamp'2026-01-02 03:04:05' as day", "day is timestamp, not date"),
                      ("select '4' as sku, 1.234 as case_size, date'2026-01-02' as day", "case_size is decimal"),
                      ("select '4' as sku, 99999999999L as case_size, date'2026-01-02' as day", "case_size is bigint"),
                      ("select '4' as sku, '1' as case_size, date'2026-01-02' as day", "case_size is string"),
                      ("select array(1) as sku, 1 as case_size, date'2026-01-02' as day", "sku is array")):
        bad = f"{path}/{abs(hash(sql))}"
        spark.sql(sql).write.parquet(bad)
        with pytest.raises(ValueError, match=said) as told:
            read_table(spark, bad, FREE)
        assert bad in str(told.value)
    spark.sql("select '4' as sku, 'x' as case_size, date'2026-01-02' as day").write.mode("append").parquet(f"{path}/a")
    with pytest.raises(ValueError, match="different types"):
        read_table(spark, f"{path}/a", FREE)


def test_rejected_cells_of_workbooks_and_csv(spark):
    path = folder("books")
    rows = [("1", "5", "2026-01-02"), ("2", "five", "2026-01-03"), ("3", "", "soon"), ("4", "N/A", "45000"), (None, "1.999", None)]
    os.makedirs(path)
    with open(f"{path}/a.xlsx", "wb") as f:
        f.write(build_workbook(["sku", "case_size", "day"], rows, header_row=3))
    good, bad = ingest_checked(spark, path, FREE, keep=["sku"], header_row=3)
    assert [(r.sku, r.case_size, str(r.day)) for r in good.orderBy("day").collect()] == [
        ("3", None, "None"), (None, D("2.00"), "None"), ("4", None, "2023-03-15"), ("1", D("5.00"), "2026-01-02"), ("2", None, "2026-01-03")]
    assert sorted((r.source_row, r.sku, r.column_name, r.text) for r in bad.collect()) == [(5, "2", "case_size", "five"), (6, "3", "day", "soon")]
    assert bad.select("source_file").distinct().first()[0].endswith("a.xlsx")
    spark.createDataFrame(rows[:3], "sku string, case_size string, day string").write.option("header", True).csv(f"{path}-csv")
    good, bad = read_checked(spark, f"{path}-csv", FREE, keep=["sku"])
    assert good.count() == 3 and sorted((r.sku, r.column_name, r.text) for r in bad.collect()) == [("2", "case_size", "five"), ("3", "day", "soon")]


# --- workbooks ---------------------------------------------------------------------------------------------------

def book(sheets, order, rows_of, date1904=False):
    """A workbook with sheet files listed in ``order``; relation ids need not follow the file names."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as zf:
        listed = "".join(f'<sheet name="s{i}" sheetId="{i + 1}" r:id="rId{n}"/>' for i, n in enumerate(order))
        zf.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>')
        zf.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="rId{n}" Type="{rel}/worksheet" Target="{"/xl/" if n % 2 else ""}worksheets/sheet{n}.xml"/>' for n in sheets) + "</Relationships>")
        for n in sheets:
            body = "".join(f'<row r="{i + 1}">' + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>" for v in r)
                           + "</row>" for i, r in enumerate(rows_of(n)))
            zf.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_the_first_sheet_is_the_workbooks_first():
    assert parse_workbook(book([1, 2, 3], [3, 1, 2], lambda n: [[f"sheet {n}"]])) == [["sheet 3"]]
    assert parse_workbook(book([1, 2, 10], [2, 1, 10], lambda n: [[f"sheet {n}"]])) == [["sheet 2"]]


def test_repeated_headers_and_serials_of_both_calendars(spark):
    path = folder("serials")
    os.makedirs(path)
    rows = [["k", "at", "k", "day"], ["first", 45000.5, "second", 45000.75], ["text", "2026-01-02T03:04:05", "x", "2026-01-02"]]
    for name, since_1904 in (("a", False), ("b", True)):
        with open(f"{path}/{name}.xlsx", "wb") as f:
            f.write(book([1], [1], lambda n: rows, since_1904))
    got = ingest_workbooks(spark, path, T.StructType.fromDDL("k string, at timestamp, day date")).collect()
    seen = {(r.source_file[-6], r.k): (str(r.at), str(r.day)) for r in got}
    assert seen == {("a", "first"): ("2023-03-15 12:00:00", "2023-03-15"), ("a", "text"): ("2026-01-02 03:04:05", "2026-01-02"),
                    ("b", "first"): ("2027-03-16 12:00:00", "2027-03-16"), ("b", "text"): ("2026-01-02 03:04:05", "2026-01-02")}


def test_texts_that_xml_cannot_hold_come_back(spark):
    texts = ["a\x01b", "line\r\nend", "tab\tnl\n", "_x0041_", "_x005F_", "x_xZZZZ_", "\x0b\x0c\x1f", "<&>\"'", " blank ", "￾", "\U0001f600"]
    path = folder("odd")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    write_workbooks(df, path)
    back = ingest_workbooks(spark, path, df.schema, missing_tokens=()).orderBy("i").collect()
    assert [r.t for r in back] == texts
    write_workbooks(df.filter("i < 0"), path)  # replaces the folder, also by nothing
    assert ingest_workbooks(spark, path, df.schema).count() == 0


# --- counters ----------------------------------------------------------------------------------------------------

def test_a_calendar_of_timestamps_loses_no_line(spark):
    t = tables(spark)
    plain = {r.metric: r.rows for r in loss_metrics(t).collect()}
    stamped = dict(t, calendar=t["calendar"].withColumn("txn_date", F.expr("cast(txn_date as timestamp) + interval 9 hours")))
    assert {r.metric: r.rows for r in loss_metrics(stamped).collect()} == plain
    twice = dict(t, calendar=stamped["calendar"].unionByName(stamped["calendar"].withColumn("txn_date", F.expr("txn_date + interval 1 hour"))))
    assert {r.metric: r.rows for r in loss_metrics(twice).collect()} == {**plain, "calendar_key_fanout": 2}


def test_losses_scan_each_fact_extract_once(spark):
    t, root = tables(spark), folder("landed")
    for name, df in t.items():
        df.write.parquet(f"{root}/{name}")
    landed = {name: spark.read.parquet(f"{root}/{name}") for name in t}
    plan = loss_metrics(landed)._jdf.queryExecution().optimizedPlan().toString()
    fields = {name: sorted(landed[name].columns) for name in t}
    scans = [set(line[line.index("[") + 1 : line.index("]")].replace(" ", "").split(",")) for line in plan.splitlines() if "Relation [" in line]
    named = [{c.split("#")[0] for c in s} for s in scans]
    for name in ("invoice", "returns", "sales_order", "customer"):
        assert sum(s == set(fields[name]) for s in named) == 1, name
    assert sorted(map(tuple, loss_metrics(landed).collect())) == sorted(map(tuple, loss_metrics(t).collect()))


def test_counts_are_observed_by_the_reports(spark, params):
    t, out = tables(spark), folder("observed")
    run_daily(t, params, out, "2026-01-06", global_order=False)
    rows = read_report(spark, f"{out}/extract_counts").drop("report_date")
    missing = read_report(spark, f"{out}/required_values").drop("report_date")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, row_counts({n: t[n] for n in COUNTED}).collect()))
    assert sorted(map(tuple, missing.collect())) == sorted(map(tuple, required_values({n: (t[n], c) for n, c in REQUIRED.items()}).collect()))
    unread, _ = Watched(t).counts(spark, patience=0.05)  # scans that no plan ran are counted on their own
    assert sorted(map(tuple, unread.collect())) == sorted(map(tuple, rows.collect()))


def test_rollup_tells_total_rows_from_missing_values(spark):
    df = spark.createDataFrame([("n", "r1", D("1.00")), ("n", None, D("2.00")), (None, "r1", D("4.00")), (None, None, D("8.00"))], "branch string, rep string, v decimal(12,2)")
    got = {(r.level, r.branch, r.rep): (r.rows, r.v) for r in rollup_totals(df, ["branch", "rep"], ["v"]).collect()}
    assert got == {(0, "n", "r1"): (1, D("1.00")), (0, "n", None): (1, D("2.00")), (0, None, "r1"): (1, D("4.00")), (0, None, None): (1, D("8.00")),
                   (1, "n", None): (2, D("3.00")), (1, None, None): (2, D("12.00")), (2, None, None): (4, D("15.00"))}
    none = rollup_totals(df.filter(F.lit(False)), ["branch", "rep"], ["v"]).collect()
    assert [(r.level, r.rows) for r in none] in ([], [(2, 0)])


def test_the_vat_multiplier_of_the_run_is_used(spark):
    t = tables(spark)
    plain, double = Params("x"), Params("x", vat_multiplier=D("2.24"))
    price = lambda p: {r.sku: r.case_price for r in price_lists(t["price"], p)[0].collect()}
    assert all(price(double)[k] == 2 * v for k, v in price(plain).items())
    bad = lambda p: sum(r.bad_returns + r.good_returns for r in net_invoiced(t, p).collect())
    assert bad(double) == 2 * bad(plain) != 0
