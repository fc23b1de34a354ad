"""Uniform draws from keys, the same in Spark and in DuckDB.

The first 52 bits of an MD5 digest, moved to the middle of their cell, so that
a draw is never 0 or 1 and is exact in a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 1 << 52


def uniform(key: Column) -> Column:
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(CELLS))


def uniform_sql(key: str) -> str:
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT)::DOUBLE + 0.5) / {float(CELLS)!r}"
