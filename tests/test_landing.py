"""Landing of the derived extracts: what is asked for, without another shuffle, the same rows."""

import os
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.demo import queries, tables


@pytest.fixture(scope="module")
def sf_dir(spark):
    at = tempfile.mkdtemp(prefix="ll-raw-")
    day = F.timestamp_add("DAY", F.pmod("id", F.lit(40)).cast("int"), F.lit(datetime(2026, 1, 5)))
    raw = {
        "nation": spark.range(3).select(F.col("id").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name"), F.lit(0).cast("long").alias("n_regionkey")),
        "region": spark.range(1).select(F.col("id").alias("r_regionkey"), F.lit("R").alias("r_name")),
        "customer": spark.range(50).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Name "), "id").alias("c_name"), (F.col("id") % 3).alias("c_nationkey"),
                                           (F.col("id") * 250.0 - 500).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")),
        "supplier": spark.range(4).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"), (F.col("id") % 3).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")),
        "part": spark.range(60).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"),
                                       (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") + 1.5).alias("p_retailprice")),
        "orders": spark.range(200).select(F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"), F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"),
                                          F.lit(1.0).alias("o_totalprice"), day.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")),
        "lineitem": spark.range(800).select((F.col("id") % 200).alias("l_orderkey"), (F.col("id") * 7 % 60).alias("l_partkey"), (F.col("id") % 4).alias("l_suppkey"),
                                            (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 50 + 1.0).alias("l_quantity"), (F.col("id") * 3.5).alias("l_extendedprice"),
                                            F.lit(0.05).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.when(F.col("id") % 3 == 0, "R").otherwise("N").alias("l_returnflag"),
                                            F.when(F.col("id") % 5 == 0, "F").otherwise("O").alias("l_linestatus"), day.alias("l_shipdate")),
    }
    for name, df in raw.items():
        df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize(("query", "reads"), [
    ("blank_default", {"new_customer"}),
    ("positional_ingest", {"route"}),
    ("tolerant_text", {"invoice"}),
    ("non_null_counts", {"invoice", "returns", "deductions"}),
])
def test_a_query_lands_only_the_extracts_it_reads(spark, sf_dir, query, reads):
    link = f"{tempfile.mkdtemp(prefix='ll-raw-')}/{query}"  # a path of its own: nothing is landed for it yet
    os.symlink(sf_dir, link)
    assert queries.QUERIES[query](spark, link).count() > 0
    root = tables._ROOTS[(spark.sparkContext.applicationId, link)]
    assert {n for n in os.listdir(root.removeprefix("file:"))} == {f"{n}.parquet" for n in reads}


def test_landed_tables_hold_the_derived_rows(spark, sf_dir):
    landed, derived = tables.DemoTables(spark, sf_dir), tables.DemoTables(spark, sf_dir, landed=False)
    for name in tables.EXTRACTS:
        assert sorted(map(str, landed[name].collect())) == sorted(map(str, derived[name].collect())), name
    assert landed["invoice"].rdd.getNumPartitions() > 1  # small inputs are dealt to all cores


def test_large_inputs_are_landed_without_a_deal(spark, sf_dir, monkeypatch):
    plan = lambda: tables.DerivedTables(spark, sf_dir, spread=True).invoice._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan()
    monkeypatch.setattr(tables, "SPLIT_BYTES", 1)
    assert "Repartition" not in plan()


def test_facts_landed_in_parts_hold_the_same_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tables, "PART_BYTES", 1)
    link = f"{tempfile.mkdtemp(prefix='ll-raw-')}/parts"
    os.symlink(sf_dir, link)
    root = tables.land_extracts(spark, link, names=tables.FACTS)
    derived = tables.DerivedTables(spark, sf_dir)
    held = [tables.DerivedTables(spark, sf_dir, part=(i, tables.MOST_PARTS)).invoice.count() for i in range(tables.MOST_PARTS)]
    assert sum(held) == derived.invoice.count() and max(held) < sum(held)
    for name in tables.FACTS:
        assert sorted(map(str, spark.read.parquet(f"{root}/{name}.parquet").collect())) == sorted(map(str, getattr(derived, name).collect())), name
