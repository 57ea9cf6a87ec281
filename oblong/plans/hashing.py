"""Draws by a seeded hash, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


def digits(seed: str, *columns) -> F.Column:
    """The first eight hexadecimal digits of a seeded hash, as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])), 1, 8), 16, 10).cast("long")


def digits_sql(seed: str, *columns: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}' || " + " || ".join(f"':' || CAST({c} AS VARCHAR)" for c in columns) + "), 1, 8) AS BIGINT)"
