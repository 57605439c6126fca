"""Typed reads of landed extracts and reference tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    ShortType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from ledgerline.operators.aggregate import missing_counts
from ledgerline.operators.quality import rejected_cells
from ledgerline.operators.setops import union_all
from ledgerline.session import hadoop_path, scratch_dir


def _exists(spark: SparkSession, path: str) -> bool:
    hpath, filesystem = hadoop_path(spark, path)
    return bool(filesystem.globStatus(hpath))


# Whole numbers by width, and the digits that each can have.
_WHOLE = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}


def holds(wanted: DataType, found: DataType) -> bool:
    """Whether every value of the type ``found`` can be read as ``wanted`` without loss; anything can be read as text."""
    if wanted == found or isinstance(wanted, StringType):
        return not isinstance(found, (ArrayType, MapType, StructType, BinaryType)) or wanted == found
    if type(found) in _WHOLE:
        if type(wanted) in _WHOLE:
            return _WHOLE[type(found)] <= _WHOLE[type(wanted)]
        if isinstance(wanted, DecimalType):
            return wanted.precision - wanted.scale >= _WHOLE[type(found)]
        return isinstance(wanted, DoubleType) and _WHOLE[type(found)] <= 10
    if isinstance(found, DecimalType) and isinstance(wanted, DecimalType):
        return wanted.scale >= found.scale and wanted.precision - wanted.scale >= found.precision - found.scale
    if isinstance(found, FloatType):
        return isinstance(wanted, DoubleType)
    return isinstance(found, DateType) and isinstance(wanted, (TimestampType, TimestampNTZType))


def reconcile(path: str, wanted: StructType, found: StructType) -> None:
    """Raise ValueError naming the path and every column that ``found`` lacks or holds in a type that ``wanted`` would cut."""
    by_name = {f.name: f.dataType for f in found}
    lacking = [f.name for f in wanted if f.name not in by_name]
    cut = [f"{f.name} is {by_name[f.name].simpleString()}, not {f.dataType.simpleString()}"
           for f in wanted if f.name in by_name and not holds(f.dataType, by_name[f.name])]
    if lacking or cut:
        raise ValueError("; ".join([f"{path}: no column {', '.join(lacking)}"] * bool(lacking) + [f"{path}: {c}" for c in cut]))


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType,
    fmt: str = "parquet",
    optional: bool = False,
    **options,
) -> DataFrame:
    """Read one extract with an explicit schema (ids are text, money decimal).

    ``optional`` returns an empty table of the same schema when nothing exists at
    ``path``; a path that exists but cannot be read still raises. CSV columns are
    matched by their header names, whatever their order, and cast to the schema
    (unparsable values become NULL; :func:`read_checked` tells which); a column that no
    header names raises. Other formats carry their own schema: the footers of all files
    are merged in one distributed pass and reconciled with ``schema`` before anything is
    planned. A missing column, or a type that would have to be cut to fit, raises with the
    path and the column; wider tables, other orders and narrower types are read and cast.
    """
    if optional and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if fmt == "csv":
        texts = _csv_texts(spark, path, schema, options)
        return texts.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
    merged = {"mergeSchema": "true"} if fmt in ("parquet", "orc") else {}
    try:
        found = spark.read.options(**{**merged, **options}).format(fmt).load(path)
    except AnalysisException as e:
        raise ValueError(f"{path}: {e}") from e
    except Py4JJavaError as e:
        said = str(e.java_exception.getMessage())
        if "CANNOT_MERGE" not in said:
            raise
        raise ValueError(f"{path}: files hold a column in different types: {said}") from e
    reconcile(path, schema, found.schema)
    return found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def _csv_texts(spark: SparkSession, path: str, schema: StructType, options: Mapping) -> DataFrame:
    texts = spark.read.options(**{"header": "true", **options}).csv(path)
    if lacking := [f.name for f in schema if f.name not in texts.columns]:
        raise ValueError(f"{path}: no column {', '.join(lacking)}")
    return texts


def read_checked(spark: SparkSession, path: str, schema: StructType, keep: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """A CSV extract as :func:`read_table` gives it, and the cells that it turned to NULL.

    The texts are parsed once and staged; rejected cells are rows ``(source_file,
    source_row, column_name, text)`` with the row's ``keep`` texts in between. CSV
    readers split files inside, so ``source_row`` is NULL; ``keep`` tells the row.
    """
    texts = _csv_texts(spark, path, schema, options)
    names = [f"`{f.name}`" for f in schema]
    texts = texts.select(*names, texts.metadataColumn("_metadata")["file_path"].alias("source_file"), F.lit(None).cast("long").alias("source_row"))
    staged = f"{scratch_dir(spark)}/cells/{uuid.uuid4().hex}"
    texts.write.parquet(staged)
    texts = spark.read.schema(texts.schema).parquet(staged)
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema}
    rows = texts.select(*[c.alias(n) for n, c in typed.items()])
    return rows, rejected_cells(texts, typed, ["source_file", "source_row", *keep])


def required_values(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows ``(table_name, column_name, missing)``: per extract, rows lacking each key column."""
    return union_all([missing_counts(df, cols, name) for name, (df, cols) in tables.items()])
