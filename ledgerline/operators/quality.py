"""Reference coverage and key-uniqueness checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import is_blank


def uncategorized(products: DataFrame, category: DataFrame) -> DataFrame:
    """Distinct ``(sku, sku_name)`` whose SKU has no non-blank category.

    A SKU absent from the category table and one whose category is blank are
    both reported. An anti join against the categorised SKUs cannot fan out.
    """
    known = category.filter(~is_blank("category")).select("sku")
    return products.select("sku", "sku_name").join(known, "sku", "left_anti").distinct()


def existing_categories(category: DataFrame) -> DataFrame:
    """Distinct category values present and not blank."""
    return category.filter(~is_blank("category")).select(F.col("category").cast("string").alias("category")).distinct()


def key_fanout(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows ``(metric, rows)``: surplus rows a join on ``keys`` would add (0 when unique)."""
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    per_key = df.filter(present).groupBy(*keys).count()
    return per_key.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("rows")).select(
        F.lit(name).alias("metric"), "rows"
    )


def key_fanouts(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows ``(metric, rows)`` for several single-key tables in one aggregation.

    The tagged keys of all tables are unioned and counted together (two
    shuffles in total instead of two per table); a table without duplicates
    reports 0.
    """
    from ledgerline.operators.setops import union_all

    keys = union_all([df.select(F.lit(name).alias("metric"), F.col(key).cast("string").alias("k"))
                      for name, (df, key) in tables.items()]).filter(F.col("k").isNotNull())
    surplus = keys.groupBy("metric", "k").count().groupBy("metric").agg(
        F.sum(F.col("count") - 1).cast("bigint").alias("rows"))
    spark = next(iter(tables.values()))[0].sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in tables])).alias("metric"))
    return names.join(surplus, "metric", "left").select("metric", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))


def rejected_cells(texts: DataFrame, typed: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row ``(*keep, column_name, text)`` per cell that has a text and no value once it is ``typed``.

    ``typed`` maps a text column to the expression that reads it. All columns are
    checked in one pass over the rows; a row without rejected cells gives nothing.
    """
    cells = [F.when(F.col(n).isNotNull() & c.isNull(), F.struct(F.lit(n).alias("column_name"), F.col(n).alias("text"))) for n, c in typed.items()]
    return texts.select(*keep, F.inline(F.array_compact(F.array(*cells))))


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> None:
    """Raise when a reference repeats a key (a join on it would fan facts out).

    One aggregate job; run it on references before the reports when duplicates
    must stop the run rather than be counted.
    """
    surplus = key_fanout(df, keys, name).first()["rows"]
    if surplus:
        raise ValueError(f"{name}: {surplus} surplus rows share a key in {list(keys)}")
