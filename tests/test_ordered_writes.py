"""Ordered writes: order over files, missing keys, hot keys, one pass over the rows."""

import datetime
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import read_report, write_report
from ledgerline.sources.order import FANOUT, _levels, deal_in_order, key_bounds


def rows_in_order(spark, path):
    found = []
    for name in sorted(n for n in os.listdir(path) if n.endswith(".parquet")):
        found.append([tuple(r) for r in spark.read.parquet(f"{path}/{name}").collect()])
    return found


def last(v):
    return (v is None, 0 if v is None else v)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    day = lambda: rng.choice([None, *[datetime.date(2026, 1, d) for d in (1, 1, 1, 1, 2, 3)]])
    rows = [(day(), rng.choice([None, "é", "C1", "C2", "c", "日"]), i, rng.random()) for i in range(20_000)]
    return spark.createDataFrame(rows, "d date, k string, i int, v double").repartition(5).cache(), rows


def test_order_over_files_is_total(spark, table):
    df, rows = table
    path = tempfile.mkdtemp(prefix="ll-order-") + "/t"
    deal_in_order(df, ["d", "k", "i"], rows_per_range=1500).write.parquet(path)
    files = rows_in_order(spark, path)
    assert len(files) >= 10 and max(map(len, files)) < 4000  # the hot date and its hot keys are split
    want = sorted(rows, key=lambda r: (last(r[0]), (r[1] is None, (r[1] or "").encode()), r[2]))
    assert [r for f in files for r in f] == want


@pytest.mark.parametrize("like_rows", [0, 1, 500])
def test_any_bounds_give_the_right_order(spark, table, like_rows):
    df, rows = table
    like = spark.range(like_rows).select(F.lit(datetime.date(2026, 1, 1)).alias("d"), F.col("id").cast("string").alias("i"), F.lit(1).alias("more"))
    path = tempfile.mkdtemp(prefix="ll-order-") + "/t"
    deal_in_order(df, ["d", "i"], like=like, rows_per_range=50).write.parquet(path)
    found = [r for f in rows_in_order(spark, path) for r in f]
    assert found == sorted(rows, key=lambda r: (last(r[0]), r[2]))


def test_bounds_of_one_value_and_of_nothing(spark):
    same = spark.range(1000).select(F.lit("x").alias("k"))
    assert len(key_bounds(same, ["k"], 8, 1000)) == 1 and key_bounds(same.limit(0), ["k"], 8, 0) == []
    assert deal_in_order(same, ["k"], rows_per_range=100).count() == 1000 and deal_in_order(same.limit(0), ["k"]).count() == 0


def test_an_ordered_write_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    source = spark.range(5000).withColumn("k", F.col("id") % 97)
    df = source.mapInPandas(count, "id long, k long")
    path = tempfile.mkdtemp(prefix="ll-order-") + "/t"
    assert write_report(df, path, "2026-01-02", sort_by=["k", "id"], like=source) == 5000
    assert seen.value == 5000
    back = [tuple(r)[:2] for r in read_report(spark, path, "2026-01-02").collect()]
    assert back == sorted(back, key=lambda r: (r[1], r[0]))


def test_bounds_are_sampled_by_a_task_for_each_partition(spark):
    tasks = tempfile.mkdtemp(prefix="ll-tasks-")

    def note(batches):
        from pyspark import TaskContext

        open(f"{tasks}/{TaskContext.get().taskAttemptId()}", "w").close()
        yield from batches

    like = spark.range(0, 8000, 1, 8).mapInPandas(note, "id long")
    assert len(key_bounds(like, ["id"], 4, 8000)) == 3
    assert len(os.listdir(tasks)) == 8


@pytest.mark.parametrize("count", [1, 2, 15, 16, 17, 255, 256, 300, 4095])
def test_a_row_meets_few_bounds_on_its_way_to_its_range(count):
    levels = _levels(list(range(count)))
    assert max(len(bounds) for level in levels for _, bounds in level) < FANOUT
    for key in range(-1, count):
        at = 0
        for level in levels:
            at = at * FANOUT + sum(b <= key for b in dict(level)[at])
        assert at == key + 1
