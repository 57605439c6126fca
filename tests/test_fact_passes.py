"""Fact reports in passes: the rows and order of single writes, and shuffles and copies that do not pile up on the disk."""

import os
import tempfile
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import deduct_orders, only_deducted, only_deducted_sieved
from ledgerline.plans import daily
from ledgerline.plans.reports import REPORT_ORDER, net_invoiced, net_sellout, sales_order_report, served_invoice
from ledgerline.schemas import DDL
from ledgerline.session import freed_shuffles
from ledgerline.sources import order, read_report, reports, write_report, write_reports
from tests.fixtures import tables


def folder(name):
    return f"{tempfile.mkdtemp(prefix='ll-passes-')}/{name}"


def grown(spark):
    """The fixture's tables with some hundred lines of several dates, repeated and missing keys among them."""
    t = tables(spark)
    day = lambda i: None if i % 41 == 0 else date(2026, 1, 5) + timedelta(days=i % 7)
    who, sku = (lambda i: None if i % 31 == 0 else f"C{i % 5}"), (lambda i: None if i % 37 == 0 else ["100", "100_old", "200", "400"][i % 4])
    inv = [(day(i), who(i), "N", sku(i), f"KX{i % 9}", f"Thing {i % 3}", "Case", D(i % 6), None if i % 29 == 0 else D(i), "ITM_GOODS", f"I{i % 60}", f"O{i % 60}", "E1") for i in range(400)]
    ret = [(day(i), f"R{i % 50}", "E1", who(i), "N", sku(i), "Thing", ["MAIN BO", "FG_1", None][i % 3], D(i), "Case", D(1 + i % 2), "BAD_ORDER") for i in range(150)]
    so = [(day(i), who(i), sku(i), "Thing", "Case", D(i % 6), D(i), "Invoiced" if i % 4 else "Open", f"O{i % 60}") for i in range(300)]
    more = {"invoice": inv + inv[:20], "returns": ret, "sales_order": so + so[:20],
            "deductions": [(f"I{i % 60}_{sku(i)}", f"R{i % 50}_{sku(i)}") for i in range(0, 200, 7)], "calendar": [(date(2026, 1, 5) + timedelta(days=i), i) for i in range(2, 6)]}
    for name, rows in more.items():
        t[name] = t[name].unionByName(spark.createDataFrame(rows, DDL[name])) if name in DDL else t[name]
    return t


def in_order(spark, path):
    rows = []
    names = sorted(n for n in os.listdir(path) if n.endswith(".parquet"))
    numbers = [n.split("-")[1] for n in names]
    assert len(set(numbers)) == len(numbers)
    for n in names:
        rows += spark.read.parquet(f"{path}/{n}").collect()
    return rows


def test_reports_in_passes_hold_the_rows_and_order_of_single_writes(spark, params, monkeypatch):
    monkeypatch.setattr(order, "PASS_ROWS", 60)
    t, out, work = grown(spark), folder("out"), folder("work")
    bounds = order.pass_bounds(t["invoice"], daily.PASS_KEYS)
    assert len(bounds) >= 4
    written = daily.write_fact_reports(t, params, out, "2026-01-06", work)
    alone = {"net_invoiced": net_invoiced(t, params), "served_invoice": served_invoice(t, params), "sales_order": sales_order_report(t, params),
             "net_sellout": net_sellout(t, params)}
    for name, df in alone.items():
        found = in_order(spark, f"{out}/{name}/report_date=2026-01-06")
        assert sorted(map(str, found)) == sorted(map(str, df.collect())), name
        assert written[name] == len(found) > 100, name
        key = lambda r, name=name: [(r[k] is None, r[k]) if r[k] is not None else (True,) for k in REPORT_ORDER[name]]
        assert [key(r) for r in found] == sorted(map(key, found)), name
        assert os.listdir(f"{out}/{name}") == ["report_date=2026-01-06"]
    assert not os.path.exists(work)


def test_one_pass_of_staged_rows_is_on_the_disk_at_a_time(spark, params, monkeypatch):
    monkeypatch.setattr(order, "PASS_ROWS", 60)
    t, out, work = grown(spark), folder("out"), folder("work")
    held, deal = [], reports.deal_in_order

    def counted(df, *a, **k):
        held.append({n: len([x for x in os.listdir(f"{work}/{n}/rows") if x.startswith("__split=")]) for n in os.listdir(work) if os.path.isdir(f"{work}/{n}/rows")})
        return deal(df, *a, **k)

    monkeypatch.setattr(reports, "deal_in_order", counted)
    daily.write_fact_reports(t, params, out, "2026-01-06", work)
    lines = [h["lines"] for h in held if h.get("lines")]
    assert lines[0] >= 4 and lines == sorted(lines, reverse=True)
    assert all(lines.count(n) == 2 for n in set(lines) if n)  # both reports of a pass, then its rows go


def test_shuffles_go_with_their_statement(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum(1 for f in iter_files(local) if f.startswith("shuffle_"))

    def iter_files(manager):
        for top in manager.localDirsString():
            for _, _, names in os.walk(top):
                yield from names

    key, path = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", folder("t")
    with freed_shuffles(spark):
        before = count()
        spark.range(5000).repartition(7, "id").write.parquet(path)
        for _ in range(50):
            if count() <= before:
                break
            __import__("time").sleep(0.1)
        assert count() <= before
    assert spark.conf.get(key) == "false" and spark.read.parquet(path).count() == 5000


def test_a_failed_pass_leaves_the_dates_as_they_were(spark):
    a, b = folder("a"), folder("b")
    df = spark.range(10).select(F.col("id").alias("k"))
    for path in (a, b):
        write_report(df, path, "2026-01-02", sort_by=["k"])

    def passes():
        yield [df.filter("k < 5"), df]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        write_reports(passes(), [(a, ["k"]), (b, ["k"])], "2026-01-02")
    for path in (a, b):
        assert read_report(spark, path, "2026-01-02").count() == 10 and os.listdir(path) == ["report_date=2026-01-02"]
    with pytest.raises(ValueError, match="one pass"):
        write_report([], a, "2026-01-02", sort_by=["k"])
    with pytest.raises(ValueError, match="passes"):
        write_report([df], a, "2026-01-02")
    empty = df.limit(0)
    assert write_report([empty, df, empty], a, "2026-01-02", sort_by=["k"]) == 10
    assert [r.k for r in in_order(spark, f"{a}/report_date=2026-01-02")] == list(range(10))


def test_sieved_semi_join_and_staged_order_keys_keep_the_same_rows(spark):
    t = grown(spark)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(only_deducted_sieved(t["invoice"], t["deductions"], "invoice_key")) == rows(only_deducted(t["invoice"], t["deductions"], "invoice_key"))
    beyond = only_deducted_sieved(t["invoice"], t["deductions"], "invoice_key", max_bytes=16)
    assert rows(beyond) == rows(only_deducted(t["invoice"], t["deductions"], "invoice_key")) and beyond.count() > 0
    whole = deduct_orders(t["sales_order"], t["invoice"], t["deductions"])
    assert rows(deduct_orders(t["sales_order"], t["invoice"], t["deductions"], path=folder("keys"))) == rows(whole)
    assert 0 < whole.count() < t["sales_order"].count()
