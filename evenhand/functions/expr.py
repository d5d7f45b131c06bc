"""Arithmetic that keeps *undefined* apart from *zero*, and keyed draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """``num / den`` as DOUBLE; NULL when the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def nan_to_null(c) -> Column:
    return F.when(F.isnan(col(c)), None).otherwise(col(c))


def finite(c) -> Column:
    """NULL for NaN and both infinities (NaN sorts above infinity in Spark)."""
    x = col(c).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def indicator(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def mean_defined(*cols) -> Column:
    """Mean of the non-null arguments, NULL when none is defined."""
    values = F.filter(F.array(*[col(c) for c in cols]), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def digest(*parts) -> Column:
    """md5 over the parts joined with ``|``: an order and a source of draws that
    depend on the key only, never on partitioning or task order."""
    return F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))


def draw32(*parts) -> Column:
    """A BIGINT in [0, 2**32) taken from the first eight hex digits of the digest."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


def draw60(*parts) -> Column:
    """A BIGINT in [0, 2**60) taken from the first fifteen hex digits of the digest."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("bigint")


def uniform_index(draw: Column, size: Column) -> Column:
    """Map a 60-bit draw to 0 .. size-1 without a modulo bias towards low slots. The product is
    taken in DECIMAL, so every size that a BIGINT of rows can have is reached without overflow."""
    wide = draw.cast("decimal(19,0)") * size.cast("decimal(19,0)")
    return F.call_function("div", wide, F.lit(1 << 60).cast("decimal(19,0)")).cast("bigint")


def unpivot_structs(structs: list[Column]) -> Column:
    return F.inline(F.array(*structs))
