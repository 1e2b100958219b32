"""The closed set of expressions for filter, derive, when, formula and derived columns.

Plain functions over columns. Blanks are two-valued here: ``ne``, ``not_in`` and ``not_`` are TRUE for a blank
cell, so blank rows are selected, where SQL would drop them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRule, NumberUsedAsText

# Words an operand column may not be named after inside a condition.
RESERVED_NAMES = ("null", "true", "false", "between", "like", "ilike", "matches", "startswith", "endswith")


def col(name: str) -> Column:
    if name.lower() in RESERVED_NAMES:
        raise InvalidRule(f"column name {name!r} is a word of the expression language")
    return F.col(f"`{name}`")


def _c(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def eq(a: Column, b: object) -> Column:
    return F.coalesce(a == _c(b), F.lit(False))


def ne(a: Column, b: object) -> Column:
    return ~a.eqNullSafe(_c(b))


def lt(a: Column, b: object) -> Column:
    return F.coalesce(a < _c(b), F.lit(False))


def le(a: Column, b: object) -> Column:
    return F.coalesce(a <= _c(b), F.lit(False))


def gt(a: Column, b: object) -> Column:
    return F.coalesce(a > _c(b), F.lit(False))


def ge(a: Column, b: object) -> Column:
    return F.coalesce(a >= _c(b), F.lit(False))


def is_in(a: Column, values: Sequence[object]) -> Column:
    return F.coalesce(a.isin(list(values)), F.lit(False))


def not_in(a: Column, values: Sequence[object]) -> Column:
    return ~is_in(a, values)


def is_null(a: Column) -> Column:
    return a.isNull()


def is_not_null(a: Column) -> Column:
    return a.isNotNull()


def and_(*p: Column) -> Column:
    out = F.coalesce(p[0], F.lit(False))
    for q in p[1:]:
        out = out & F.coalesce(q, F.lit(False))
    return out


def or_(*p: Column) -> Column:
    out = F.coalesce(p[0], F.lit(False))
    for q in p[1:]:
        out = out | F.coalesce(q, F.lit(False))
    return out


def not_(p: Column) -> Column:
    return ~F.coalesce(p, F.lit(False))


def add(a: Column, b: object) -> Column:
    return a + _c(b)


def sub(a: Column, b: object) -> Column:
    return a - _c(b)


def mul(a: Column, b: object) -> Column:
    return a * _c(b)


def div(a: Column, b: object) -> Column:
    return a / _c(b)


def floor_div(a: Column, b: object) -> Column:
    """Rounds down, exactly: the double quotient is off by little, and the remainder, taken in the operands' own type, says by
    how much. A zero divisor gives null."""
    b = F.nullif(_c(b), F.lit(0))
    near = F.floor(F.try_divide(a, b)).cast("bigint")
    near = near + F.floor((a - near * b) / b).cast("bigint")
    rest = a - near * b
    return near + F.when((rest != 0) & ((rest < 0) != (b < 0)), -1).when(F.abs(rest) >= F.abs(b), 1).otherwise(0)


def concat(*parts: object) -> Column:
    """Numbers turn to text; a blank part makes the result blank."""
    return F.concat(*[_c(p).cast("string") for p in parts])


def slice_(s: Column, i: int, j: int) -> Column:
    """0-based, end exclusive."""
    return F.substring(s, i + 1, max(j - i, 0))


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b, negative when b is earlier (our sign)."""
    return F.datediff(b, a)


def if_(cond: Column, a: object, b: object) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), _c(a)).otherwise(_c(b))


def case_when(*branches: tuple[Column, object], default: object = None) -> Column:
    out = F
    for cond, value in branches:
        out = out.when(F.coalesce(cond, F.lit(False)), _c(value))
    return out.otherwise(_c(default))


def text(x: Column) -> Column:
    return x.cast("string")


def zfill(s: Column, n: int) -> Column:
    """Pad with zeros on the left, after a sign; never cuts."""
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.when(s.startswith("-"), s.substr(F.lit(2), F.length(s))).otherwise(s)
    width = F.greatest(F.lit(n) - F.length(sign), F.length(body))
    return F.concat(sign, F.lpad(body, width, F.lit("0")))


def length(s: Column) -> Column:
    return F.length(s)


def last(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def round_(x: Column, places: int = 0) -> Column:
    """Half to even, like the formula language."""
    return F.bround(x, places)


def check_text_operands(df: DataFrame, *columns: str) -> None:
    """Refuse a number column used as text without ``text()``. Reads the schema only; no job runs."""
    for name in columns:
        if isinstance(df.schema[name].dataType, T.NumericType):
            raise NumberUsedAsText(f"column {name!r} is a number; wrap it in text()")


def check_columns(df: DataFrame, expr: Column) -> T.DataType:
    """The type of an expression over a frame, from analysis only."""
    return df.select(expr.alias("x")).schema["x"].dataType
