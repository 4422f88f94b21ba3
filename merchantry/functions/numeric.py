"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def to_number(value: Column, as_type: str = MONEY) -> Column:
    """Text to number; what does not parse is null instead of an error."""
    return value.try_cast(as_type)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def total(value: Column) -> Column:
    """Sum where nothing adds up to 0 rather than null."""
    return F.coalesce(F.sum(value), F.lit(0))


def as_double(value: Column) -> Column:
    return value.cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def zero_as_one(value: Column) -> Column:
    return F.when(value == 0, F.lit(1)).otherwise(value)


def zero_as_null(value: Column) -> Column:
    return F.when(value != 0, value)


def half_even(value: Column, digits: int = 0) -> Column:
    """Round the scaled double half to even, so 1.225 (stored as 1.22500000000000009) gives 1.23."""
    scale = 10.0 ** digits
    number = value.cast("double")
    return F.rint(number) if digits == 0 else F.rint(number * scale) / scale


def clean_number(value: Column, digits: int = 0) -> Column:
    """Infinite or missing to 0, the rest rounded half to even."""
    number = value.cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return F.coalesce(half_even(finite, digits), F.lit(0.0))


def skewness_unbiased(value: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; null below three values."""
    n = F.count(value).cast("double")
    factor = F.when(n > 2, F.try_divide(F.sqrt(n * (n - 1)), n - 2))
    return factor * F.skewness(value)


def kurtosis_unbiased(value: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(value).cast("double")
    factor = F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)))
    return factor * ((n + 1) * F.kurtosis(value) + 6)
