"""Report sink round trip and workbook ingest."""

import io
import os
import tempfile
import tracemalloc
import zipfile
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources import ingest_workbooks, read_report, read_table, report_label, required_values, write_report
from ledgerline.sources.sheets import build_workbook, parse_workbook, stream_workbook
from ledgerline.sources.workbook import write_workbooks


def test_report_partitions_overwrite_one_date(spark):
    path = tempfile.mkdtemp(prefix="ll-report-")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert write_report(df, path, "2026-01-02") == 2
    assert write_report(df.filter("v = 1"), path, "2026-01-03", sort_by=["k"]) == 1
    write_report(df, path, "2026-01-03", sort_by=["k"], global_order=False)  # rerun replaces only that date
    assert read_report(spark, path, "2026-01-02").count() == 2
    assert read_report(spark, path, "2026-01-03").count() == 2
    assert read_report(spark, path).count() == 4
    plan = read_report(spark, path, "2026-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_report_label(spark):
    assert spark.range(1).select(report_label("ACME", "Net Invoiced", "2026-01-02").alias("n")).first().n == \
        "ACME Net Invoiced_January 2, 2026"


def test_optional_table_and_required_values(spark):
    schema = T.StructType([T.StructField("sku", T.StringType()), T.StructField("qty", T.DecimalType(12, 2))])
    empty = read_table(spark, "/nonexistent/path/x.parquet", schema, optional=True)
    assert empty.count() == 0 and empty.schema == schema
    df = spark.createDataFrame([("a", None), (None, D("1"))], schema)
    got = {(r.table_name, r.column_name): r.missing for r in required_values({"t": (df, ["sku", "qty"])}).collect()}
    assert got == {("t", "sku"): 1, ("t", "qty"): 1}


def test_workbook_parse_with_header_offset(spark):
    folder = tempfile.mkdtemp(prefix="ll-xlsx-")
    rows = [("Report", None, None), (None, None, None), ("SKU CODE", "QTY", "DATE"), ("100", 2.5, "2026-01-02"),
            ("200", "abc", 46024)]
    with open(os.path.join(folder, "a.xlsx"), "wb") as fh:
        fh.write(build_workbook(list(rows[0]), rows[1:]))
    assert parse_workbook(open(os.path.join(folder, "a.xlsx"), "rb").read())[2] == ["SKU CODE", "QTY", "DATE"]
    schema = T.StructType([T.StructField("SKU CODE", T.StringType()), T.StructField("QTY", T.DoubleType()),
                           T.StructField("DATE", T.DateType()), T.StructField("MISSING", T.StringType())])
    out = ingest_workbooks(spark, folder, schema, header_row=3, allow_missing=["MISSING"]).orderBy("SKU CODE").collect()
    assert [(r["SKU CODE"], r["QTY"], str(r["DATE"]), r["MISSING"]) for r in out] == [
        ("100", 2.5, "2026-01-02", None), ("200", None, "2026-01-02", None)]


def test_workbook_export_import_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="ll-xlsx-")
    df = spark.createDataFrame([(f"C{i}", f"name & <{i}>", i * 1.5) for i in range(50)], "id string, name string, v double")
    written = write_workbooks(df.repartition(3), folder).collect()
    assert sum(r.rows for r in written) == 50
    back = ingest_workbooks(spark, folder, df.schema)
    assert sorted(map(tuple, back.drop("source_file").collect())) == sorted(map(tuple, df.collect()))


def test_workbook_positional_columns(spark):
    folder = tempfile.mkdtemp(prefix="ll-xlsx-")
    rows = [("x", "y"), ("note", None), ("RETAIL", "CL-R"), ("WHOLESALE", None)]
    with open(os.path.join(folder, "c.xlsx"), "wb") as fh:
        fh.write(build_workbook(list(rows[0]), rows[1:]))
    schema = T.StructType([T.StructField("customer_class", T.StringType()),
                           T.StructField("classification", T.StringType())])
    out = ingest_workbooks(spark, folder, schema, header_row=3, by_position=True).drop("source_file")
    assert sorted(map(tuple, out.dropna().collect())) == [("RETAIL", "CL-R")]


def test_landed_extracts_conform_to_schemas(spark):
    from ledgerline.demo.tables import DemoTables
    from ledgerline.schemas import TABLES, schema

    t = DemoTables(spark, "/root/testdata/sf0.001")
    for name in TABLES:
        got = {f.name: f.dataType.simpleString() for f in t[name].schema.fields}
        want = {f.name: f.dataType.simpleString() for f in schema(name).fields}
        assert set(got) == set(want), name
        for col, typ in want.items():
            if typ.startswith("decimal"):
                assert got[col].startswith("decimal"), (name, col)
            else:
                assert got[col] == typ, (name, col)


def test_workbook_export_splits_files_by_row_limit(spark):
    folder = tempfile.mkdtemp(prefix="ll-xlsx-")
    df = spark.range(25).selectExpr("cast(id as string) as id").coalesce(1)
    written = write_workbooks(df, folder, rows_per_file=10).collect()
    assert sorted(r.rows for r in written) == [5, 10, 10]
    back = ingest_workbooks(spark, folder, df.schema)
    assert sorted(int(r.id) for r in back.collect()) == list(range(25))


def _sheet(folder: str, name: str, rows: dict[int, list[str]]) -> None:
    """A workbook whose sheet XML leaves out blank rows and numbers the others."""
    cells = lambda n, vs: "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(vs))
    body = "".join(f'<row r="{n}">{cells(n, vs)}</row>' for n, vs in rows.items())
    plain = build_workbook(["x"], [])
    with zipfile.ZipFile(io.BytesIO(plain)) as src, zipfile.ZipFile(os.path.join(folder, name), "w") as out:
        for item in src.namelist():
            data = src.read(item)
            if b"<sheetData>" in data:
                head, _, rest = data.partition(b"<sheetData>")
                data = head + b"<sheetData>" + body.encode() + b"</sheetData>" + rest.partition(b"</sheetData>")[2]
            out.writestr(item, data)


def test_workbook_rows_are_numbered_by_the_sheet_and_dates_and_blanks_are_read(spark):
    folder = tempfile.mkdtemp(prefix="ll-xlsx-")
    _sheet(folder, "d.xlsx", {1: ["List"], 5: ["key", "day"], 6: ["a", "2026-01-02 00:00:00"], 7: ["N/A", "2026-01-03T10:00:00"],
                              9: ["b", "46024"], 10: ["NA", "oops"]})
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("day", T.DateType())])
    got = ingest_workbooks(spark, folder, schema, header_row=5).collect()
    assert [(r.key, str(r.day)) for r in got] == [("a", "2026-01-02"), (None, "2026-01-03"), ("b", "2026-01-02"), (None, "None")]


def test_workbook_without_a_wanted_column_raises(spark):
    folder = tempfile.mkdtemp(prefix="ll-xlsx-")
    _sheet(folder, "d.xlsx", {1: ["Txn Date"], 2: ["2026-01-02"]})
    schema = T.StructType([T.StructField("txn_date", T.DateType())])
    with pytest.raises(Exception, match="no column txn_date"):
        ingest_workbooks(spark, folder, schema).collect()


def test_csv_is_read_by_header_name(spark):
    folder = tempfile.mkdtemp(prefix="ll-csv-")
    with open(os.path.join(folder, "r.csv"), "w") as fh:
        fh.write("route_code,customer_id,n\nR1,C1,5\nR2,C2,x\n")
    text = T.StringType()
    schema = T.StructType([T.StructField("customer_id", text), T.StructField("route_code", text), T.StructField("n", T.IntegerType())])
    got = read_table(spark, folder, schema, fmt="csv").orderBy("customer_id").collect()
    assert [tuple(r) for r in got] == [("C1", "R1", 5), ("C2", "R2", None)]
    with pytest.raises(ValueError, match="no column other"):
        read_table(spark, folder, T.StructType([T.StructField("other", text)]), fmt="csv")


def test_csv_report_keeps_its_header_and_sort_only_columns_are_not_written(spark):
    path = tempfile.mkdtemp(prefix="ll-report-")
    df = spark.createDataFrame([("b", 1, 9), ("a", 2, 8)], "k string, v int, o int")
    write_report(df, path, "2026-01-02", sort_by=["o"], fmt="csv", sort_only=["o"])
    assert sorted((r.k, r.v) for r in read_report(spark, path, fmt="csv").collect()) == [("a", "2"), ("b", "1")]
    assert "o" not in read_report(spark, path, fmt="csv").columns


def test_newest_category_version_by_number_and_by_date(spark):
    from ledgerline.plans.categories import latest_categories, publish_categories

    one = spark.createDataFrame([("s", "n", "old")], "sku string, sku_name string, category string")
    two = one.withColumn("category", F.lit("new"))
    for old, new in (("9", "10"), ("2026-01-09", "2026-01-10"), ("a", "b")):
        path = tempfile.mkdtemp(prefix="ll-cat-")
        publish_categories(one, one, path, old)
        publish_categories(one, two, path, new)
        assert latest_categories(spark, path).first().category == "new"


def test_price_pivot_combines_before_its_shuffle(spark, params):
    from ledgerline.plans.reports import price_lists

    rows = [("hot" if i % 3 == 0 else f"s{i % 50}", "name", "CS", "A", "VAN", i + 0.5) for i in range(3000)]
    price = spark.createDataFrame(rows, "sku string, sku_name string, uom string, price_class string, channel string, price double")
    for pivot in price_lists(price, params):
        plan = pivot._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION" not in plan and plan.index("Exchange hashpartitioning") < plan.rindex("partial_sum")


def test_workbook_export_replaces_the_folder_of_an_earlier_run(spark):
    folder = os.path.join(tempfile.mkdtemp(prefix="ll-xlsx-"), "ACME net_invoiced_January 2, 2026")
    df = spark.range(20).selectExpr("cast(id as string) as id")
    for parts in (4, 1):
        assert sum(r.rows for r in write_workbooks(df.repartition(parts), folder).collect()) == 20
        assert ingest_workbooks(spark, folder, df.schema).count() == 20
    assert len(os.listdir(os.path.dirname(folder))) == 1


def test_failed_workbook_export_leaves_the_earlier_files(spark):
    folder = os.path.join(tempfile.mkdtemp(prefix="ll-xlsx-"), "out")
    write_workbooks(spark.range(3).selectExpr("cast(id as string) as id"), folder)
    with pytest.raises(Exception):
        write_workbooks(spark.range(3).selectExpr("raise_error('no rows') as id"), folder)
    assert os.listdir(os.path.dirname(folder)) == ["out"]
    assert ingest_workbooks(spark, folder, T.StructType([T.StructField("id", T.StringType())])).count() == 3


def test_workbook_ingest_shuffles_nothing(spark):
    folder = tempfile.mkdtemp(prefix="ll-xlsx-")
    df = spark.range(8).selectExpr("cast(id as string) as id")
    write_workbooks(df.repartition(4), folder)
    plan = ingest_workbooks(spark, folder, df.schema)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_workbook_export_memory_does_not_grow_with_rows():
    class Sink(io.RawIOBase):
        def writable(self):
            return True

        def write(self, data):
            return len(data)

    def peak(rows: int) -> int:
        tracemalloc.start()
        assert stream_workbook(Sink(), ["id", "name"], ((i, f"name {i}") for i in range(rows))) == rows
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    peak(10)
    assert peak(20_000) < 2 * peak(1_000)


def test_report_is_computed_once_and_read_back_in_order(spark):
    path = tempfile.mkdtemp(prefix="ll-report-")
    runs = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(v):
        runs.add(1)
        return v

    df = spark.range(2000).repartition(8).select(seen(F.col("id") * 7 % 2003).alias("k"), F.col("id").alias("tie"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # off, so that the small report has several files
    spark.conf.set(coalesce, "false")
    try:
        assert write_report(df, path, "2026-01-02", sort_by=["k", "tie"]) == 2000
    finally:
        spark.conf.set(coalesce, "true")
    assert runs.value == 2000
    part = os.path.join(path, "report_date=2026-01-02")
    files = sorted(f for f in os.listdir(part) if f.endswith(".parquet"))
    keys = [r.k for f in files for r in spark.read.parquet(os.path.join(part, f)).collect()]
    assert len(files) > 1 and keys == sorted(keys) and len(keys) == 2000


def test_sheets_are_parsed_by_chunks_without_an_event_for_each_element(monkeypatch):
    import io
    import zipfile

    from ledgerline.sources import sheets

    rows = [["a&b <c>", None, 1.5], ["_x0041_", "\x01", True], *[[f"text {i}", "", i] for i in range(500)]]
    content = sheets.build_workbook(["k", "v", "n"], rows, header_row=3)

    def read():
        with zipfile.ZipFile(io.BytesIO(content)) as zf:
            return [(n, [row.text(i) for i in range(row.width)]) for n, row in sheets.iter_sheet(zf, sheets.first_sheet(zf)[0])]

    def refuse(*args, **options):
        raise AssertionError("an event for each element")

    monkeypatch.setattr(sheets.ET, "iterparse", refuse)
    whole = read()
    assert whole[:3] == [(3, ["k", "v", "n"]), (4, ["a&b <c>", None, "1.5"]), (5, ["_x0041_", "\x01", "TRUE"])]
    assert len(whole) == 503 and whole[-1] == (505, ["text 499", "", "499"])
    for size in (1, 7, 100):  # rows are whole wherever a chunk ends
        monkeypatch.setattr(sheets, "_CHUNK", size)
        assert read() == whole
