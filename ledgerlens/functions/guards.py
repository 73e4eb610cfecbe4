"""Small guarded expressions shared by the feature and metric operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    value = value.cast("double")
    # Only a finite value minus itself is 0.
    return F.when(value - value == 0, value).otherwise(F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def label_title(name: Column) -> Column:
    """``random_forest`` -> ``Random Forest``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def short_label(name: Column, width: int = 18) -> Column:
    """Chart labels longer than ``width`` are cut and end in three dots."""
    return F.when(F.length(name) > width, F.concat(F.substring(name, 1, width), F.lit("..."))).otherwise(name)
