"""Daily run into the dated sink, and the arrival-triggered stream."""

import os
import tempfile

from pyspark.sql import functions as F

from ledgerline.sources import ingest_workbooks, read_report
from ledgerline.plans import net_invoiced
from ledgerline.plans.daily import run_daily
from ledgerline.session import scratch_dir
from ledgerline.streaming import reports_on_arrival
from tests.fixtures import tables


def test_run_daily_writes_every_report(spark, params):
    out = tempfile.mkdtemp(prefix="ll-daily-")
    written = run_daily(tables(spark), params, out, "2026-01-06")
    names = {os.path.basename(p) for p in written}
    assert written[f"{out}/served_invoice"] == 3 and written[f"{out}/customer_master"] == 4
    assert {"net_invoiced", "sales_order", "served_invoice", "customer_master", "net_sellout",
            "price_list_nonvan", "price_list_van", "new_skus", "loss_metrics"} <= names
    assert read_report(spark, f"{out}/served_invoice", "2026-01-06").count() == 3
    assert read_report(spark, f"{out}/customer_master", "2026-01-06").count() == 4


def test_run_daily_shares_invoices_writes_workbooks_and_cleans_up(spark, params):
    out, books = tempfile.mkdtemp(prefix="ll-daily-"), tempfile.mkdtemp(prefix="ll-books-")
    t = tables(spark)
    written = run_daily(t, params, out, "2026-01-06", workbook_root=books)
    report = read_report(spark, f"{out}/net_invoiced", "2026-01-06").drop("report_date")
    alone = net_invoiced(t, params)
    assert sorted(map(str, report.select(*alone.columns).collect())) == sorted(map(str, alone.collect()))
    folders = {n for n in os.listdir(books)}
    assert folders == {f"Test Co {os.path.basename(p)}_January 6, 2026" for p in written}
    customers = read_report(spark, f"{out}/customer_master", "2026-01-06").drop("report_date")
    back = ingest_workbooks(spark, f"{books}/Test Co customer_master_January 6, 2026", customers.schema)
    assert "created_on" not in customers.columns and back.count() == 4
    work = f"{scratch_dir(spark).removeprefix('file:')}/daily"
    assert not os.path.isdir(work) or os.listdir(work) == []


def test_reports_on_arrival_processes_new_dates_once(spark, params):
    landing = tempfile.mkdtemp(prefix="ll-landing-")
    out = tempfile.mkdtemp(prefix="ll-out-")
    ckpt = tempfile.mkdtemp(prefix="ll-ckpt-")
    t = tables(spark)

    def land(day):
        for name, df in t.items():
            df.withColumn("report_date", F.lit(day)).write.mode("append").partitionBy("report_date").parquet(
                f"{landing}/{name}")

    def refs(day):
        return {name: spark.read.parquet(f"{landing}/{name}").filter(F.col("report_date") == day).drop("report_date")
                for name in t}

    land("2026-01-06")
    q = reports_on_arrival(spark, landing, refs, params, out, checkpoint=ckpt, global_order=False)
    q.awaitTermination()
    assert read_report(spark, f"{out}/served_invoice").select("report_date").distinct().count() == 1
    land("2026-01-07")
    q = reports_on_arrival(spark, landing, refs, params, out, checkpoint=ckpt, global_order=False)
    q.awaitTermination()
    days = sorted(str(r[0]) for r in read_report(spark, f"{out}/served_invoice").select("report_date").distinct().collect())
    assert days == ["2026-01-06", "2026-01-07"]
    assert read_report(spark, f"{out}/served_invoice", "2026-01-07").count() == 3
