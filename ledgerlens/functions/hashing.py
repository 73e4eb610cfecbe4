"""Hash order: the seeded, engine-independent replacement for random state.

A row's place in the order depends on the seed and its key alone, so the same
rows are drawn whatever the partitioning, retries or engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KEY


def hash_order(seed: int | str, key: str | Column = KEY) -> Column:
    """Hex string that orders rows for sampling: md5 of ``seed|key``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_uniform(salt: str | Column, key: str | Column = KEY) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of md5 of ``salt|key``."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(salt, F.lit("|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def content_key(columns: list[str]) -> Column:
    """Key for tables that come without one: md5 over the row's columns."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
