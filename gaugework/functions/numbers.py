"""Column expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_power2(value: Column) -> Column:
    """2 to the power of the truncated ``log2(value) + 0.5``; null for values that have no logarithm."""
    return F.when(value > 0, F.pow(F.lit(2.0), (F.log2(value) + 0.5).cast("int")))


def seven_digits(value: Column) -> Column:
    """Round to single precision, so that sums taken in another order still compare equal."""
    return value.cast("float").cast("double")
