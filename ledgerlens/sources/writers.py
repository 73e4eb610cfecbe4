"""Sinks: augmented logs, result tables, JSON export and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import IDENTIFIERS, KEY


def write_augmented(df: DataFrame, path: str, file_format: str = "csv") -> None:
    """The augmented table without identifiers, split over as many files as there are partitions."""
    out = df.drop(*IDENTIFIERS, *([KEY] if file_format == "csv" else []))
    out.write.mode("overwrite").option("header", True).format(file_format).save(path)


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """Each result table as parquet, and as JSON lines for export."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        table.write.mode("overwrite").json(f"{path}/json/{name}")


def read_results(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_report(report: DataFrame, path: str) -> None:
    """One text file per model row of ``evaluation_report``."""
    report.select("model", "report").write.mode("overwrite").partitionBy("model").text(path)
