"""Readers. Every text cell is read as text; a schema is checked before a row is read."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRule, UndeclaredColumn

OBJECT_SCHEMES = {"s3": "s3a", "gcs": "gs", "file": "file", "hdfs": "hdfs"}
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}$")


def read_csv(spark: SparkSession, path: str, *, has_header: bool, column_names: Sequence[str] | None = None,
             column_names_file: str | None = None, delimiter: str = ",") -> DataFrame:
    """``has_header`` has no default. Without a header the names come from a list or from a one-name-per-line file."""
    if not has_header and not (column_names or column_names_file):
        raise InvalidRule("a csv source without a header needs column_names or column_names_file")
    if column_names_file:
        # a list of column names: as long as a table is wide
        column_names = [r["value"].strip() for r in spark.read.text(column_names_file).collect() if r["value"].strip()]
    reader = spark.read.option("header", has_header).option("sep", delimiter).option("enforceSchema", False)
    if has_header:
        # the header is one line of one file; no inference pass over the data
        df = reader.option("inferSchema", False).csv(path)
        if column_names and list(column_names) != df.columns:
            raise UndeclaredColumn("the header differs from the declared columns")
        return df
    schema = T.StructType([T.StructField(c, T.StringType()) for c in column_names])
    return reader.option("enforceSchema", True).schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str, declared: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if declared is not None:
        check_declared_schema(df, declared)
    return df


@dataclass(frozen=True)
class Field:
    """A fixed-width column: 0-based start, width in characters."""

    name: str
    start: int
    width: int
    type: str = "string"


def read_fixed_width(spark: SparkSession, path: str, layout: Sequence[Field]) -> DataFrame:
    """Blank cells are null; ``type: int`` is read without failing on text."""
    cols = []
    for f in layout:
        cell = F.rtrim(F.substring("value", f.start + 1, f.width))
        cell = F.when(cell != "", F.trim(cell) if f.type == "int" else cell)
        cols.append((cell.try_cast("bigint") if f.type == "int" else cell).alias(f.name))
    return spark.read.text(path).select(*cols)


def object_uri(store: str, bucket: str, key: str) -> str:
    if store not in OBJECT_SCHEMES:
        raise InvalidRule(f"unknown store {store!r}")
    return f"{OBJECT_SCHEMES[store]}://{bucket}/{key.lstrip('/')}"


def read_object_store(spark: SparkSession, store: str, bucket: str, key: str, format: str | None = None, **options) -> DataFrame:
    """s3 and gcs names end in .csv or .parquet, or the format is given."""
    fmt = format or ("csv" if key.endswith(".csv") else "parquet" if key.endswith(".parquet") else None)
    if fmt not in ("csv", "parquet"):
        raise InvalidRule("an object name must end in .csv or .parquet, or name its format")
    uri = object_uri(store, bucket, key)
    return read_csv(spark, uri, **options) if fmt == "csv" else read_parquet(spark, uri, **options)


def read_database_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
                        lower: int | None = None, upper: int | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """One relation by name, read only, no SQL text. Give a partition column and its bounds to read in parallel."""
    if not IDENTIFIER.match(table):
        raise InvalidRule("a database source is one table name: letters, digits, underscores and dots")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in options.items():
        if k.lower() in ("query", "preparequery", "sessioninitstatement", "dbtable"):
            raise InvalidRule(f"option {k!r} would run SQL text")
        reader = reader.option(k, v)
    if partition_column:
        if not IDENTIFIER.match(partition_column) or lower is None or upper is None:
            raise InvalidRule("a partitioned read needs a column name and its bounds")
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", partitions))
    return reader.load()


def check_declared_schema(df: DataFrame, declared: Sequence[str]) -> None:
    """Both ways, from the header or footer alone."""
    missing = sorted(set(declared) - set(df.columns))
    extra = sorted(set(df.columns) - set(declared))
    if missing or extra:
        raise UndeclaredColumn(f"declared but absent: {missing}; present but undeclared: {extra}")
