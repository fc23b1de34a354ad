"""Joins whose result is far larger than their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.session import cut

#: Rows of one key on one side that a task meets; more are dealt into chunks of about so many.
CHUNK = 1_000


def _chunks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(name))


def _dealt(rows: DataFrame, keys: list[str], frequent: DataFrame, own: str, to: tuple[str, str], first: Column, last: Column) -> DataFrame:
    """Each row in the chunk ``to[0]`` that a hash of it names, once for every chunk of the other side from ``first`` to ``last`` (``to[1]``).

    The partitions' number is given, since small inputs would else be put into a few tasks.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    columns = rows.columns
    rows = rows.join(F.broadcast(frequent), keys, "left").withColumn(to[0], F.pmod(F.xxhash64(*columns), F.coalesce(F.col(own), F.lit(1))).cast("int"))
    return rows.select(*columns, to[0], F.explode(F.sequence(first, last)).alias(to[1])).repartition(parts, *keys, "__l", "__r")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` that deals the pairs of a frequent key over many tasks.

    A key with more than ``CHUNK`` rows on a side is cut into chunks there by a hash of
    its rows; each row meets every chunk of the other side, in a partition of that
    pair of chunks. So a key brings at most about ``CHUNK`` squared pairs to a
    partition at a time, and a row is copied once a chunk of the other side. No
    more than one key in ``CHUNK`` rows is that frequent, so the list of them is
    broadcast.
    """
    frequent = cut(_chunks(left, keys, "__left").join(_chunks(right, keys, "__right"), keys).filter("__left > 1 OR __right > 1"), "frequent")
    lefts, rights = (F.coalesce(F.col(n), F.lit(1)) - 1 for n in ("__left", "__right"))
    left = _dealt(left, keys, frequent, "__left", ("__l", "__r"), F.lit(0), rights)
    right = _dealt(right, keys, frequent, "__right", ("__r", "__l"), F.lit(0), lefts)
    return left.join(right, [*keys, "__l", "__r"]).drop("__l", "__r")


def spread_pairs(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, a, b): every two rows of a key once, as structs of their other columns, that with the smaller ``item`` first.

    ``item`` tells the rows of a key apart. Rows are dealt as ``spread_join`` does; of two chunks of a key only one order is made.
    """
    columns = [c for c in rows.columns if c not in keys]
    frequent = cut(_chunks(rows, keys, "__own").filter("__own > 1"), "frequent")
    rows = rows.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    left = _dealt(rows.select(*keys, F.struct(*columns).alias("__x")), keys, frequent, "__own", ("__l", "__r"), F.col("__l"), F.coalesce(F.col("__own"), F.lit(1)) - 1)
    right = _dealt(rows.select(*keys, F.struct(*columns).alias("__y")), keys, frequent, "__own", ("__r", "__l"), F.lit(0), F.col("__r"))
    first = F.col(f"__x.{item}") < F.col(f"__y.{item}")
    pairs = left.join(right, [*keys, "__l", "__r"]).filter((F.col("__l") < F.col("__r")) | first)
    return pairs.select(*keys, F.when(first, F.col("__x")).otherwise(F.col("__y")).alias("a"), F.when(first, F.col("__y")).otherwise(F.col("__x")).alias("b"))
