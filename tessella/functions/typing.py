"""Typing of raw text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Declared type -> Spark type of its column.
TYPES = {"i": "bigint", "n": "double", "b": "boolean", "d": "date", "dt": "timestamp", "t": "string", "c": "string"}


def typed(raw: Column, kind: str) -> Column:
    """A raw text as its declared type; empty texts and failures are null, an unknown boolean is false."""
    value = F.nullif(raw, F.lit(""))
    match kind:
        case "i" | "n":
            return value.try_cast(TYPES[kind])
        case "b":
            return F.when(value.isNotNull(), F.lower(F.trim(value)).isin("true", "1", "yes"))
        case "d":
            return F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date")
        case "dt":
            return F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))
        case _:
            return value


def normalise(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Typed columns, with ``_bad_<column>`` holding the raw text where typing failed.

    Columns of ``kinds`` that the table lacks are left out; columns not in ``kinds`` stay text.
    A column cannot hold mixed types, so unlike row dictionaries a failed value moves aside.
    """
    out = []
    for name in raw.columns:
        kind = kinds.get(name, "t")
        value = typed(F.col(f"`{name}`"), kind)
        out.append(value.alias(name))
        if kind not in "tc":
            out.append(F.when(value.isNull() & (F.nullif(F.col(f"`{name}`"), F.lit("")).isNotNull()), F.col(f"`{name}`")).alias(f"_bad_{name}"))
    return raw.select(*out)


def loose_double(value: Column) -> Column:
    """A number, or 0 where there is none."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def loosely_equal(a: Column, b: Column) -> Column:
    """Equal as numbers where both are numbers, else as text."""
    x, y = a.cast("string").try_cast("double"), b.cast("string").try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.cast("string") == b.cast("string"))
