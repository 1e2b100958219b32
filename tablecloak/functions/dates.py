"""Dates declared in strptime notation, as Spark patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRule

# Strptime directive -> Spark datetime pattern.
DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%z": "XX",
}


def spark_pattern(strptime: str) -> str:
    out, i = [], 0
    while i < len(strptime):
        ch = strptime[i]
        if ch == "%":
            d = strptime[i:i + 2]
            if d == "%%":
                out.append("%")
            elif d in DIRECTIVES:
                out.append(DIRECTIVES[d])
            else:
                raise InvalidRule(f"date directive {d!r} is not supported")
            i += 2
        else:
            out.append("''" if ch == "'" else f"'{ch}'" if ch.isalpha() else ch)
            i += 1
    return "".join(out)


def parse(c: Column, strptime: str, kind: str = "string") -> Column:
    """Timestamp or null; date and timestamp columns pass."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return c.cast("timestamp")
    return F.try_to_timestamp(c, F.lit(spark_pattern(strptime)))


def render(ts: Column, strptime: str, kind: str = "string") -> Column:
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return ts.cast(kind)
    return F.date_format(ts, spark_pattern(strptime))
