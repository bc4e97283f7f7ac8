"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOREVER = 99991231


def col(c: str | Column) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return c if isinstance(c, Column) else F.col("`" + c.replace("`", "``") + "`")


def present(c: str | Column) -> Column:
    """A double with NaN turned into NULL, the one form of a missing number."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def tidy(c: str | Column) -> Column:
    """A symbol trimmed and in upper case; NULL if nothing is left."""
    c = F.upper(F.regexp_replace(col(c), r"^\s+|\s+$", ""))
    return F.when(c != "", c)


def unpacked(c: str | Column) -> Column:
    """The date of a packed YYYYMMDD number; NULL if it is none."""
    return F.to_date(F.try_to_timestamp(col(c).cast("string"), F.lit("yyyyMMdd")))


def packed(c: str | Column) -> Column:
    """A date as a YYYYMMDD number."""
    c = col(c)
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def micros(c: str | Column) -> Column:
    """A date or timestamp as microseconds since 1970."""
    return F.unix_micros(col(c).cast("timestamp"))


def both_from(a: Column, b: Column) -> Column:
    """The later of two times, NULL if either is (``greatest`` alone passes over NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def ratio(a: Column, b: Column) -> Column:
    """IEEE division: a/0 is an infinity of a's sign, 0/0 is missing."""
    zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))
