"""Cell equality between a golden and an agent value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from evalspark.constants import ABS_TOLERANCE, REL_TOLERANCE

_TOLERANT = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
)
_FLOATING = (T.FloatType, T.DoubleType)


def is_tolerant(dtype: T.DataType) -> bool:
    """Numbers and booleans compare with tolerance; decimals, text and dates exactly."""
    return isinstance(dtype, _TOLERANT)


def nan_to_null(value: Column, dtype: T.DataType) -> Column:
    """NaN and null are the same missing value in a result cell."""
    return F.when(~F.isnan(value), value) if isinstance(dtype, _FLOATING) else value


def close(left: Column, right: Column) -> Column:
    """|a-b| <= max(rel * max(|a|,|b|), abs), infinities only equal to themselves."""
    a, b = left.cast("double"), right.cast("double")
    bound = F.greatest(F.greatest(F.abs(a), F.abs(b)) * REL_TOLERANCE, F.lit(ABS_TOLERANCE))
    infinite = F.lit(float("inf"))
    finite = (F.abs(a) != infinite) & (F.abs(b) != infinite)
    return (a == b) | (finite & (F.abs(a - b) <= bound))


def cells_match(left: Column, right: Column, left_type: T.DataType, right_type: T.DataType) -> Column:
    """Tolerant, null-safe equality; never null."""
    if is_tolerant(left_type) and is_tolerant(right_type):
        same = close(left, right)
    elif is_tolerant(left_type) != is_tolerant(right_type) and not (
        isinstance(left_type, T.DecimalType) or isinstance(right_type, T.DecimalType)
    ):
        same = F.lit(False)  # text never equals a number
    elif left_type != right_type and T.StringType() in (left_type, right_type):
        same = F.lit(False)  # nor a date or a decimal
    else:
        same = left == right
    return F.coalesce(same, left.isNull() & right.isNull())


def cells_identical(left: Column, right: Column, left_type: T.DataType, right_type: T.DataType) -> Column:
    """Exact equality as used for counting: a missing value differs from everything."""
    comparable = is_tolerant(left_type) == is_tolerant(right_type)
    if comparable and isinstance(left_type, T.BooleanType) != isinstance(right_type, T.BooleanType):
        left, right = left.cast("double"), right.cast("double")
    return F.coalesce(left == right, F.lit(False)) if comparable else F.lit(False)
