"""Six shaping steps that run before masking, in the written order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRule, UndeclaredColumn
from .ordering import first_rows, keep_first

MAX_STEPS = 32
Step = Callable[[DataFrame], DataFrame]


def filter_rows(cond: Column) -> Step:
    return lambda df: df.where(F.coalesce(cond, F.lit(False)))


def derive_column(name: str, expr: Column) -> Step:
    return lambda df: df.withColumn(name, expr)


def sort_rows(*by: str, ascending: bool | Sequence[bool] = True) -> Step:
    """Nulls last (D)."""
    up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    order = [F.col(b).asc_nulls_last() if u else F.col(b).desc_nulls_last() for b, u in zip(by, up)]

    def step(df: DataFrame) -> DataFrame:
        out = df.orderBy(*order)
        out._sorted_by = tuple(order)
        return out
    return step


def limit_rows(n: int) -> Step:
    """Top-k: after a sort Spark keeps n rows per task. Without a sort the rows would be arbitrary, so refused."""
    def step(df: DataFrame) -> DataFrame:
        if not getattr(df, "_sorted_by", None):
            raise InvalidRule("limit needs a sort before it")
        return first_rows(df, df._sorted_by, n)
    return step


def dedupe_rows(*columns: str, order_by: Sequence[str] = ()) -> Step:
    """Whole rows, or the first row of each key in ``order_by`` order."""
    def step(df: DataFrame) -> DataFrame:
        if not columns:
            return df.dropDuplicates()
        if not order_by:
            raise InvalidRule("dedupe on columns needs order_by to say which row is first")
        return keep_first(df, columns, order_by)
    return step


def drop_columns(*columns: str) -> Step:
    def step(df: DataFrame) -> DataFrame:
        absent = sorted(set(columns) - set(df.columns))
        if absent:
            raise UndeclaredColumn(f"drop names absent columns: {', '.join(absent)}")
        return df.drop(*columns)
    return step


def shape(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    if len(steps) > MAX_STEPS:
        raise InvalidRule(f"a table takes at most {MAX_STEPS} steps")
    order = None
    for s in steps:
        df = s(df)
        order = getattr(df, "_sorted_by", None) or order
        if order:
            df._sorted_by = order
    return df
