"""Rounding that agrees with exact decimal arithmetic on the binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits, whose products are exact.
_SPLIT = 134_217_729.0


def _halves(x: Column) -> tuple[Column, Column]:
    high = x * _SPLIT - (x * _SPLIT - x)
    return high, x - high


def half_even(x: Column, digits: int) -> Column:
    """x to so many decimals: the nearest to the binary value itself, to an even last digit only if exactly in the middle.

    SQL's round() goes by the shortest decimal that stands for a double, and away from zero: it makes 2.68 of 2.675,
    which lies below the middle. Null stays null; digits are 0 to 15, and values whose digits no double can hold stay as they are.
    """
    x, ten = x.cast("double"), float(10**digits)
    size = F.abs(x)
    product = size * ten
    (a, b), (c, d) = _halves(size), _halves(F.lit(ten))
    error = ((a * c - product) + a * d + b * c) + b * d  # what the product lacks, exactly
    whole = F.floor(product).cast("double")
    over = (product - whole - 0.5) + error
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    near = (whole + F.when(up, 1.0).otherwise(0.0)) / ten
    return F.when(F.isnan(x) | (product >= 2.0**52), x).otherwise(near * F.signum(x))
