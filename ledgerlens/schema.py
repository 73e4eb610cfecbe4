"""The transactions schema and the column groups the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = "txn_id"
LABEL = "isFraud"
FLAG = "isFlaggedFraud"
IDENTIFIERS = ("nameOrig", "nameDest")

# The five transaction types, in the sorted order that defines their codes.
TYPES = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
# The two types in which fraud can occur.
RISKY_TYPES = ("TRANSFER", "CASH_OUT")

TRANSACTIONS = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("newbalanceOrig", T.DoubleType()),
        T.StructField("nameDest", T.StringType()),
        T.StructField("oldbalanceDest", T.DoubleType()),
        T.StructField("newbalanceDest", T.DoubleType()),
        T.StructField(LABEL, T.IntegerType()),
        T.StructField(FLAG, T.IntegerType()),
    ]
)

# What a scoring request means when it leaves a field out.
REQUEST_DEFAULTS = {
    "step": 1,
    "type": "TRANSFER",
    "amount": 10000.0,
    "oldbalanceOrg": 50000.0,
    "newbalanceOrig": 40000.0,
    "oldbalanceDest": 0.0,
    "newbalanceDest": 10000.0,
}

REQUEST = T.StructType(
    [T.StructField(KEY, T.StringType())]
    + [f for f in TRANSACTIONS.fields if f.name in REQUEST_DEFAULTS]
)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = (LABEL, FLAG)) -> list[str]:
    """Numeric columns in schema order, without the label and the legacy flag."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def has(df: DataFrame, *columns: str) -> bool:
    """True when every named column is present (feature groups are conditional)."""
    return set(columns) <= set(df.columns)
