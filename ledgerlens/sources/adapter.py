"""The transactions table derived from the star-schema test tables.

The test data holds no transaction log, so the log is a projection of
``lineitem`` joined with its order, customer and supplier.  The suppliers are broadcast
if their counted rows are few; other join strategies are left to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LABEL, RISKY_TYPES, TRANSACTIONS
from ..session import new_folder, read_staged, write_staged

#: Suppliers (two numbers each) that are sent to every task.
_BROADCAST_ROWS = 1 << 20
_STAGED: dict[tuple[str, str], str] = {}


def transactions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lazy adapter view (FIXTURES.md section 2)."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    # What only lineitem decides is decided before its rows are shuffled, once: orders meet their customers first.
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    lineitem = read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (flag == "R").alias("back"), (status == "F").alias("settled"), (status == "O").alias("unsettled"),
        (1 + (F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) * 24 + F.col("l_quantity").cast("int")) % 743).cast("int").alias("step"),
    )
    priority = F.col("o_orderpriority")
    orders = read("orders").select(
        "o_orderkey", "o_custkey",
        F.when(priority == "1-URGENT", "CASH_OUT")
        .when(priority == "2-HIGH", "PAYMENT")
        .when(priority == "3-MEDIUM", "CASH_IN")
        .when(priority == "4-NOT SPECIFIED", "TRANSFER")
        .otherwise("DEBIT")
        .alias("type"),
    ).join(read("customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    supplier = read("supplier").select("s_suppkey", "s_acctbal")
    if supplier.count() <= _BROADCAST_ROWS:
        supplier = F.broadcast(supplier)
    lines = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    text = lambda c: F.col(c).cast("string")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    keyed = lines.select(
        "*",
        F.md5(
            F.concat_ws("|", text("l_orderkey"), text("l_linenumber"), text("l_partkey"),
                        text("l_suppkey"), cents)
        ).alias("txn_id"),
    )
    typed = keyed.select(
        "*",
        F.conv(F.substring("txn_id", 1, 8), 16, 10).cast("bigint").alias("h"),
        F.round(F.col("l_extendedprice") * 10, 2).alias("amount"),
    )
    returned = F.col("type").isin(*RISKY_TYPES) & F.col("back")
    settled = F.col("settled")
    noisy = (settled & (F.col("h") % 10 < 8)) | (F.col("unsettled") & (F.col("h") % 10 == 0))
    labelled = typed.select(
        "*",
        returned.cast("int").alias("drain"),
        (returned & noisy).cast("int").alias("isFraud"),
    ).select(
        "*",
        F.when(F.col("drain") == 1, F.col("amount"))
        .otherwise(F.round((F.col("c_acctbal") + 1000) * 100, 2))
        .alias("oldbalanceOrg"),
        F.when(settled, F.lit(0.0))
        .otherwise(F.round((F.col("s_acctbal") + 1000) * 100, 2))
        .alias("oldbalanceDest"),
    )
    amount, before_o, before_d = F.col("amount"), F.col("oldbalanceOrg"), F.col("oldbalanceDest")
    cash_in = F.col("type") == "CASH_IN"
    zero = F.lit(0.0)
    return labelled.select(
        "txn_id",
        "step",
        "type",
        "amount",
        F.concat(F.lit("C"), text("o_custkey")).alias("nameOrig"),
        "oldbalanceOrg",
        F.when(cash_in, F.round(before_o + amount, 2))
        .otherwise(F.greatest(F.round(before_o - amount, 2), zero))
        .alias("newbalanceOrig"),
        F.concat(
            F.when(F.col("type") == "PAYMENT", "M").otherwise("C"), text("l_suppkey")
        ).alias("nameDest"),
        "oldbalanceDest",
        F.when((F.col("drain") == 1) & (F.floor(F.col("h") / 10) % 10 < 6), before_d)
        .when(cash_in, F.greatest(F.round(before_d - amount, 2), zero))
        .otherwise(F.round(before_d + amount, 2))
        .alias("newbalanceDest"),
        "isFraud",
        ((F.col("isFraud") == 1) & (amount > 200000)).cast("int").alias("isFlaggedFraud"),
    ).to(TRANSACTIONS)


def transactions_path(spark: SparkSession, sf_dir: str) -> str:
    """The adapter view written once per application, partitioned by the label."""
    at = (spark.sparkContext.applicationId, str(sf_dir))
    if at not in _STAGED:
        path = new_folder(spark, "transactions")
        write_staged(transactions_view(spark, sf_dir), path, (LABEL,))
        _STAGED[at] = path
    return _STAGED[at]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan of the staged transactions table.

    Most operators make more than one pass (fit, then apply); here a class
    filter prunes directories and projections prune columns.
    """
    return read_staged(spark, transactions_path(spark, sf_dir), TRANSACTIONS)
