"""Cleaning: duplicates, sparse columns, identifiers, missing values, type narrowing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import finite_or_zero
from ..schema import FLAG, IDENTIFIERS, KEY, LABEL


def filter_class(df: DataFrame, value: int) -> DataFrame:
    return df.where(F.col(LABEL) == value)


def drop_duplicates(df: DataFrame, key: str = KEY) -> DataFrame:
    """One row per distinct content; the smallest key survives.

    The copies of a row collapse in the map-side aggregate, so a row copied a
    billion times shuffles once per task.
    """
    if key not in df.columns:
        return df.dropDuplicates()
    content = [c for c in df.columns if c != key]
    return df.groupBy(*content).agg(F.min(key).alias(key)).select(*df.columns)


def sparse_columns(df: DataFrame, threshold: float = 0.5) -> list[str]:
    """Columns whose share of nulls is strictly above ``threshold``."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if shares[c] is not None and shares[c] > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


def drop_identifiers(df: DataFrame) -> DataFrame:
    return df.drop(*IDENTIFIERS)


def drop_flag(df: DataFrame) -> DataFrame:
    return df.drop(FLAG)


def drop_target(df: DataFrame) -> DataFrame:
    return df.drop(LABEL)


def fill_missing(df: DataFrame, value: float = 0) -> DataFrame:
    """Null and NaN in numeric columns become ``value``."""
    return df.na.fill(value)


def replace_infinite(df: DataFrame) -> DataFrame:
    """Infinities (and missing values) in floating-point columns become 0."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite_or_zero(F.col(c)).alias(c) if c in floating else c for c in df.columns])


def clean(df: DataFrame, key: str = KEY) -> DataFrame:
    """Training clean-up: duplicates, then sparse columns, then identifiers."""
    distinct = drop_duplicates(df, key)
    return drop_identifiers(distinct.drop(*[c for c in sparse_columns(distinct) if c != key]))


def narrowed_types(df: DataFrame, key: str = KEY) -> dict[str, T.DataType]:
    """Smallest signed integer type per integer column by its range; doubles become floats."""
    integers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    types: dict[str, T.DataType] = {}
    if integers:
        row = df.agg(*[f(c).alias(f"{c}__{s}") for c in integers for s, f in (("lo", F.min), ("hi", F.max))]).first()
        for c in integers:
            lo, hi = row[f"{c}__lo"], row[f"{c}__hi"]
            if lo is None:
                continue
            for kind, bits in ((T.ByteType(), 7), (T.ShortType(), 15), (T.IntegerType(), 31)):
                if -(2**bits) <= lo and hi < 2**bits:
                    types[c] = kind
                    break
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            types[f.name] = T.FloatType()
    return types


def narrow_types(df: DataFrame) -> DataFrame:
    types = narrowed_types(df)
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else c for c in df.columns])
