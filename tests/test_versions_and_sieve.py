"""Category versions by several publishers; deduction lists beyond broadcast."""

import os
import re
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import deduct, deduct_sieved
from ledgerline.operators.joins import _key_list, key_sieve
from ledgerline.plans.categories import commit_categories, committed_categories, committed_version
from ledgerline.session import create_once, read_small

ROW = "sku string, sku_name string, category string"


def folder(name):
    return os.path.join(tempfile.mkdtemp(prefix="ll-versions-"), name)


def held(spark, path, version=None):
    return {r.sku: r.category for r in committed_categories(spark, path, version).collect()}


def test_the_second_publisher_builds_on_the_first(spark):
    path = folder("cat")
    row = lambda k, c: spark.createDataFrame([(k, "n", c)], ROW)
    assert committed_version(spark, path) == 0 and held(spark, path) == {}
    assert commit_categories(spark, path, row("a", "A")) == 1
    tries = []

    def other(version):
        tries.append(version)
        if version < 4:  # wins versions 2 and 3
            commit_categories(spark, path, row(f"x{version}", "X"))

    assert commit_categories(spark, path, row("a", "B"), before_commit=other) == 4
    assert tries == [2, 3, 4]
    assert held(spark, path) == {"a": "B", "x2": "X", "x3": "X"} and held(spark, path, 1) == {"a": "A"}
    kept = [n for n in os.listdir(path) if n.startswith("rows-")]
    assert len(kept) == 4  # what lost its number is gone
    with pytest.raises(RuntimeError, match="2 times"):
        commit_categories(spark, path, row("z", "Z"), attempts=2, before_commit=lambda v: commit_categories(spark, path, row("y", "Y")))
    assert "z" not in held(spark, path)


def test_one_of_many_creates_a_file(spark):
    path, won = folder("log"), []
    os.makedirs(path)
    threads = [threading.Thread(target=lambda i=i: won.append(i) if create_once(spark, f"{path}/1", str(i)) else None) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and read_small(spark, f"{path}/1") == str(won[0]) and sorted(os.listdir(path))[-1] == "1"


@pytest.fixture(scope="module")
def lines(spark):
    df = spark.range(0, 20_000, 1, 8).select(F.concat(F.lit("D"), F.col("id") % 5000).alias("doc_no"), F.col("id").cast("string").alias("sku"),
                                             F.col("id").alias("qty"), F.lit("x").alias("__note"))
    odd = spark.createDataFrame([(None, "1", 1, "y"), ("D1", None, 2, "y"), (None, None, 3, "y")], "doc_no string, sku string, qty long, __note string")
    path = folder("lines")
    df.unionByName(odd).write.parquet(path)
    return spark.read.parquet(path)


def test_sieved_deduction_keeps_the_same_rows_and_shuffles_only_possible_hits(spark, lines):
    listed = spark.range(300).select(F.concat(F.lit("D"), F.col("id"), F.lit("_"), F.col("id")).alias("invoice_key"))
    listed = listed.unionByName(listed.limit(5)).unionByName(spark.createDataFrame([(None,)], "invoice_key string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(map(str, deduct(lines, listed, "invoice_key").collect()))
        sieved = deduct_sieved(lines, listed, "invoice_key")
        assert sieved.columns == lines.columns and sorted(map(str, sieved.collect())) == want
        plan = sieved._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan
        wide = re.findall(r"shuffle records written[^0-9]*([0-9,]+)", plan)
        assert all(int(x.replace(",", "")) < 2000 for x in wide)
        marks, bits = key_sieve(_key_list(listed, "invoice_key"))
        assert bits >= 16 * 300 and marks.agg(F.sum(F.bitmap_count("__bits"))).first()[0] <= 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sieve_of_empty_and_too_long_lists(spark, lines):
    none = spark.createDataFrame([], "invoice_key string")
    assert deduct_sieved(lines, none, "invoice_key").count() == lines.count()
    listed = spark.range(300).select(F.concat(F.lit("D"), F.col("id"), F.lit("_"), F.col("id")).alias("invoice_key"))
    beyond = deduct_sieved(lines, listed, "invoice_key", max_bytes=16)
    assert "__bits" not in beyond._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, beyond.collect())) == sorted(map(str, deduct_sieved(lines, listed, "invoice_key").collect()))
    assert deduct_sieved(lines.limit(0), listed, "invoice_key").count() == 0
