"""Rows taken as a whole, so that no column of a table can clash with a name used inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash() -> Column:
    """Hash of the column ``text``; a null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def packed(docs: DataFrame) -> DataFrame:
    """(row, id, hash): each whole row, its id as a number and the hash of its text."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"))


def row_key() -> Column:
    """One number for the id and the text of a row: rows of one id or none with different texts have different ones."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_hash())


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` isn't among the keys of ``gone`` (key)."""
    keyed = docs.select(F.struct("*").alias("row"), row_key().alias("key"))
    return keyed.join(gone, "key", "left_anti").select("row.*")
