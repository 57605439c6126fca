"""Operators on small literal fixtures (one test per rule)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline import operators as O


def test_pivot_sum_spreadsheet_semantics(spark):
    df = spark.createDataFrame(
        [
            ("k1", "BO", Decimal("1.00")),
            ("k1", "BO", Decimal("2.00")),
            ("k1", "FG", Decimal("5.00")),
            ("k2", "FG", Decimal("3.00")),
            ("k3", None, Decimal("9.00")),  # missing pivot value: dropped
            (None, "BO", Decimal("9.00")),  # missing key: dropped
            ("k4", "XX", Decimal("9.00")),  # unlisted value: dropped with only_listed
        ],
        "k string, f string, v decimal(12,2)",
    )
    out = {r.k: (r.bad, r.good) for r in O.pivot_sum(df, ["k"], "f", ["BO", "FG"], "v",
                                                       names={"BO": "bad", "FG": "good"}).collect()}
    assert out == {"k1": (Decimal("3.00"), Decimal("5.00")), "k2": (Decimal("0.00"), Decimal("3.00"))}
    kept = {r.k for r in O.pivot_sum(df, ["k"], "f", ["BO", "FG"], "v", only_listed=False).collect()}
    assert kept == {"k1", "k2", "k4"}


def test_pivot_columns_exist_without_rows(spark):
    df = spark.createDataFrame([("k1", "BO", 1.0)], "k string, f string, v double")
    out = O.pivot_sum(df, ["k"], "f", ["BO", "FG"], "v")
    assert out.columns == ["k", "BO", "FG"] and out.first().FG == 0


def test_deduct_and_only_deducted(spark):
    facts = spark.createDataFrame([("D1", "S1"), ("D1", "S2"), ("D2", "S1"), (None, "S1"), ("D3", None)],
                                  "doc_no string, sku string")
    keys = spark.createDataFrame([("D1_S1",), (None,), ("D2_S1",)], "invoice_key string")
    kept = O.deduct(facts, keys, "invoice_key")
    gone = O.only_deducted(facts, keys, "invoice_key")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([("D1", "S2"), (None, "S1"), ("D3", None)], key=str)
    assert sorted(map(tuple, gone.collect())) == [("D1", "S1"), ("D2", "S1")]
    assert kept.count() + gone.count() == facts.count()
    empty = spark.createDataFrame([], "invoice_key string")
    assert O.deduct(facts, empty, "invoice_key").count() == facts.count()


def test_deduct_orders_only_that_pair(spark):
    invoices = spark.createDataFrame([("I1", "S1", "O1"), ("I1", "S2", "O1")], "doc_no string, sku string, order_no string")
    orders = spark.createDataFrame([("O1", "S1"), ("O1", "S2"), ("O2", "S1")], "order_no string, sku string")
    keys = spark.createDataFrame([("I1_S1",)], "invoice_key string")
    out = sorted(map(tuple, O.deduct_orders(orders, invoices, keys).collect()))
    assert out == [("O1", "S2"), ("O2", "S1")]


def test_lookup_missing_keys_do_not_match(spark):
    fact = spark.createDataFrame([("C1", "R1"), ("C2", None)], "customer_id string, rep_id string")
    sup = spark.createDataFrame([("R1", "Ann"), (None, "Nobody")], "rep_id string, supervisor string")
    out = {r.customer_id: r.supervisor for r in O.lookup(fact, sup, "rep_id", ["supervisor"]).collect()}
    assert out == {"C1": "Ann", "C2": None}
    safe = {r.customer_id: r.supervisor for r in O.lookup(fact, sup, "rep_id", ["supervisor"], null_safe=True).collect()}
    assert safe == {"C1": "Ann", "C2": "Nobody"}


def test_calendar_inner_drops_missing_dates(spark):
    fact = spark.createDataFrame([("2026-01-05",), ("2026-01-04",)], "txn_date string").select(
        F.col("txn_date").cast("date").alias("txn_date"))
    cal = spark.createDataFrame([("2026-01-05", 2)], "txn_date string, week int").select(
        F.col("txn_date").cast("date").alias("txn_date"), "week")
    assert [r.week for r in O.attach_calendar(fact, cal).collect()] == [2]


def test_first_per_key_is_deterministic(spark):
    data = [("C1", None, "r2"), ("C1", "2025-12-31", "r9"), ("C1", "2026-01-02", "r1"), ("C2", "2026-01-01", "b"),
            ("C2", "2026-01-01", "a"), ("C3", None, "x")]
    expected = {"C1": ("2025-12-31", "r9"), "C2": ("2026-01-01", "a"), "C3": (None, "x")}
    for parts in (1, 3, 7):
        df = spark.createDataFrame(data, "k string, d string, r string").repartition(parts)
        df = df.withColumn("d", F.col("d").cast("date"))
        got = {row.k: (str(row.d) if row.d else None, row.r) for row in O.first_per_key(df, ["k"], ["d"]).collect()}
        assert got == expected


def test_upsert_updates_inserts_and_is_idempotent(spark):
    base = spark.createDataFrame([("S1", "Old", "A"), ("S2", "", "B")], "sku string, category string, sku_name string")
    upd = spark.createDataFrame([("S2", "New", "B2"), ("S3", "New", "C")], "sku string, category string, sku_name string")
    once = O.upsert(base, upd, "sku", ["category", "sku_name"])
    twice = O.upsert(once, upd, "sku", ["category", "sku_name"])
    expect = [("S1", "Old", "A"), ("S2", "New", "B2"), ("S3", "New", "C")]
    assert sorted(map(tuple, once.select("sku", "category", "sku_name").collect())) == expect
    assert sorted(map(tuple, twice.select("sku", "category", "sku_name").collect())) == expect


def test_uncategorized_reports_absent_and_blank(spark):
    products = spark.createDataFrame([("S1", "a"), ("S2", "b"), ("S3", "c")], "sku string, sku_name string")
    cat = spark.createDataFrame([("S1", "Food"), ("S2", "  ")], "sku string, category string")
    assert sorted(r.sku for r in O.uncategorized(products, cat).collect()) == ["S2", "S3"]
    assert [r.category for r in O.existing_categories(cat).collect()] == ["Food"]


def test_counts_and_profiles(spark):
    df = spark.createDataFrame([("a", None), ("bbb", 2)], "s string, n int")
    assert O.non_null_counts(df).first().asDict() == {"s": 2, "n": 1}
    miss = {r.column_name: r.missing for r in O.missing_counts(df, ["s", "n"], "t").collect()}
    assert miss == {"s": 0, "n": 1}
    widths = {r.column_name: r.width for r in O.text_widths(df, ["s"]).collect()}
    assert widths == {"s": 5}
    assert {r.table_name: r.rows for r in O.row_counts({"x": df, "y": df.limit(1)}).collect()} == {"x": 2, "y": 1}
    fan = O.key_fanout(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string"), ["k"], "m").first()
    assert fan.rows == 1


def test_keep_token_modes(spark):
    df = spark.createDataFrame([("KX1",), ("AB",), (None,)], "c string")
    assert [r.c for r in O.keep_token(df, "c", "KX", "Y").collect()] == ["KX1"]
    assert O.keep_token(df, "c", "KX", "N").count() == 3
    with pytest.raises(ValueError):
        O.keep_token(df, "c", "KX", "maybe")


def test_bounded_broadcast(spark):
    small = spark.range(10).withColumnRenamed("id", "k")

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()

    assert hinted(O.bounded_broadcast(small, 100))
    by_rows = O.bounded_broadcast(small, 5)
    by_bytes = O.bounded_broadcast(small, 100, max_bytes=10)
    assert not hinted(by_rows) and not hinted(by_bytes)
    assert by_rows.count() == 10 and by_bytes.count() == 10


def test_rename_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert O.rename_columns(df, {"a": "x", "zz": "y"}).columns == ["x", "b"]
    with pytest.raises(KeyError):
        O.rename_columns(df, {"zz": "y"}, strict=True)


def test_calendar_matches_timestamps_by_day(spark):
    fact = spark.createDataFrame([("2026-01-05 13:45:00",)], "ts string").select(
        F.col("ts").cast("timestamp").alias("txn_date"))
    cal = spark.createDataFrame([("2026-01-05", 2)], "d string, week int").select(
        F.col("d").cast("date").alias("txn_date"), "week")
    assert [r.week for r in O.attach_calendar(fact, cal).collect()] == [2]


def test_assert_unique(spark):
    O.assert_unique(spark.createDataFrame([("a",), ("b",), (None,), (None,)], "k string"), ["k"])
    with pytest.raises(ValueError):
        O.assert_unique(spark.createDataFrame([("a",), ("a",)], "k string"), ["k"], "category")


def test_key_fanouts_together(spark):
    a = spark.createDataFrame([("x",), ("x",), ("x",), ("y",), (None,), (None,)], "k string")
    b = spark.createDataFrame([("p",)], "k string")
    out = {r.metric: r.rows for r in O.key_fanouts({"a": (a, "k"), "b": (b, "k")}).collect()}
    assert out == {"a": 2, "b": 0}


def test_hot_customer_join_is_split_by_aqe(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("C"), (F.col("id") % 97).cast("string")))
        .alias("customer_id"), F.col("id").alias("line"))
    dim = spark.range(97).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("customer_id"),
                                 F.lit("x").alias("channel")).unionByName(
        spark.range(1).select(F.lit("HOT").alias("customer_id"), F.lit("hot").alias("channel")))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        joined = O.lookup(facts.repartition(8), dim, "customer_id", ["channel"])
        rows = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 3000 and sum(r.channel == "hot" for r in rows) == 1000
    assert "skew=true" in plan
