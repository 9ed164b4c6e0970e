"""Scalar functions as column expressions; all of them stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the C locale.
BLANKS = r"[ \t\n\x0B\f\r]+"


def tokens(text: Column | str) -> Column:
    """The white-space separated tokens of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS), lambda t: t != "")


def chunks(token: Column, width: int = 32) -> Column:
    """A token in runs of ``width`` characters (characters, not bytes), the last one shorter."""
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(token) / width).cast("int") - 1, F.lit(0)))
    return F.transform(places, lambda i: F.substring(token, i * width + 1, F.lit(width)))


def byte_sum(text: Column) -> Column:
    """Sum of the bytes' values, signed as in C for bytes above 127."""
    digits = F.hex(F.encode(text, "UTF-8"))
    pairs = F.filter(F.regexp_extract_all(digits, F.lit("(..)"), 1), lambda p: p != "")
    signed = F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("bigint"))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, v: a + v - F.when(v > 127, 256).otherwise(0))


def key_part(key: Column | str, parts: int) -> Column:
    """The visible partition of a numeric key: key mod parts, never negative."""
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(parts)).cast("int")


def digit_count(n: Column) -> Column:
    """Decimal digits of a non-negative number; 0 has none."""
    return F.when(n == 0, 0).otherwise(F.length(n.cast("string"))).cast("bigint")


def zero_padded(n: Column, width: int = 19) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def random_integer(floor: int, ceiling: int, seed: int) -> Column:
    """Uniform integers of [floor, ceiling), reproducible for a seed and a partitioning."""
    return (F.lit(floor) + F.floor(F.rand(seed) * (ceiling - floor))).cast("bigint")


def is_cut(src_part: Column, dst_part: Column) -> Column:
    """An edge is external if its source is assigned and the ends' parts differ."""
    return F.coalesce(src_part.isNotNull() & ~src_part.eqNullSafe(dst_part), F.lit(False))
