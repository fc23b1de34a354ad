"""Exact top-k by inner product: a Voronoi kNN join.

A bounded sample of vectors serves as pivots (``PIVOTS``). Every vector goes to
the cell of its nearest pivot; a cell's summary is its row count and radius,
and the queries of a cell form a group with a radius of their own. For a group
around pivot g with radius s and a cell around pivot c with radius r every
score lies within ``|g| r + s (|c| + r)`` of ``g . c``. Lower bounds and row
counts give each group a score that its k-th best partner reaches at least;
cells whose upper bound is below it are never looked at. Within a group the
same test, now around the query itself, drops more cells for single queries.

What is left is solved locally. Cells are cut into blocks of rows. Queries are
dealt into parts of up to ``QUERIES_PER_PART`` along a walk over near pivots, so
that a part's queries lie near each other and want much the same cells; a large
group is several parts. The plan is the list of (part, cell) that some query of
the part wants: a row is copied to the parts that want its cell and to no other,
a query to the blocks of the cells it wants. Each block keeps its k best for each query, and a
ranked window, limited to k rows a query on the map side, merges them. So a
vector that fills a third of all rows is many blocks, never one task. Where the
bounds prune little (high dimensions without clusters) all blocks are searched;
the result is exact either way.

Only the pivots and their summaries (a parameter's worth of rows) reach the
driver. The plan is a table, broadcast where it is short (``PLAN_ROWS``, checked)
and else joined on (cell, block), neither of which is hot.
Scores are integers: a block is multiplied in doubles where no sum can pass
2**53, in 64-bit integers where none can pass 2**63, else in whole numbers of
any length. Scores beyond the range of a long are returned as its ends, where
they tie.

Edge cases: vectors that are null or hold null or non-finite components, or
components that are no longer finite times ``SCALE``, take no part; shorter vectors count as padded with zeros; a query never meets rows of
its own id; a query id that repeats asks once, with the vector that sorts
first, while repeated candidate rows are candidates each; ties go to the
smaller id; queries without any partner return no rows; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.session import cut, small_batches

K, SCALE = 5, 256
PIVOTS = 64
ROWS_PER_BLOCK, QUERIES_PER_PART = 8_192, 8_192
PLAN_ROWS = 1_000_000
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
ROW = "id long, asks boolean, cell int, dist double, x binary"


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) as whole doubles; from 2**53 on every double is whole."""

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * SCALE
        return F.when(F.abs(scaled) < float(1 << 53), F.floor(scaled).cast("double")).otherwise(scaled)

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """No null, no NaN, no infinity, before and after scaling; false for a null vector."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def _matrix(xs: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(xs), width))
    for i, x in enumerate(xs):
        out[i, : len(x)] = x
    return out


def _unpack(xs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(xs), dtype="<f8").reshape(len(xs), -1)


class Cells:
    """Pivots with the summaries of their data and query groups, and the bounds from them."""

    def __init__(self, pivots: np.ndarray, count: np.ndarray, radius: np.ndarray, spread: np.ndarray, need: int):
        self.pivots, self.count, self.radius, self.need = pivots, count, radius, need
        self.norm = np.linalg.norm(pivots, axis=1)
        with np.errstate(invalid="ignore", over="ignore"):
            near = pivots @ pivots.T
            gap = self.norm[:, None] * radius + spread[:, None] * (self.norm + radius)
        self.group_cells = self._wanted(near, gap)

    def _wanted(self, near: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """For each row of scores to the pivots, the cells that may hold one of the best."""
        with np.errstate(invalid="ignore", over="ignore"):
            slack = 1e-6 * (1 + np.abs(near) + gap)
            low, high = near - gap - slack, near + gap + slack
        low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf  # a bound beyond doubles is none
        order = np.argsort(-low, axis=1)
        reach = np.cumsum(self.count[order], axis=1) >= self.need
        at = np.where(reach.any(axis=1), reach.argmax(axis=1), -1)
        sure = np.take_along_axis(low, order, axis=1)
        floor = np.where(at >= 0, sure[np.arange(len(low)), at], -np.inf)
        return (high >= floor[:, None]) & (self.count > 0)

    def cells_of(self, queries: np.ndarray, groups: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", over="ignore"):
            gap = np.linalg.norm(queries, axis=1)[:, None] * self.radius
            near = queries @ self.pivots.T
        return self._wanted(near, gap) & self.group_cells[groups]


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def best_of_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    q, x = _unpack(queries["x"]), _unpack(rows["x"])
    ids = rows["id"].to_numpy()
    with np.errstate(over="ignore"):
        largest = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    exact = largest < 2.0**62  # room for the rounding of the bound itself
    if largest >= 2.0**53:
        q, x = (q.astype(np.int64), x.astype(np.int64)) if exact and max(np.abs(q).max(), np.abs(x).max()) < 2.0**62 else (_whole(q), _whole(x))
    found, step = [], max(1, (1 << 21) // max(1, len(x)))
    for i in range(0, len(q), step):
        scores = q[i : i + step] @ x.T
        if scores.dtype == object:
            scores = np.clip(scores, LONG_MIN, LONG_MAX).astype(np.int64)
        for query, row in zip(queries["id"].iloc[i : i + step], scores, strict=True):
            others = ids != query
            own, named = row[others], ids[others]
            if len(own) > k:
                least = np.partition(own, len(own) - k)[len(own) - k]
                keep = own >= least
                own, named = own[keep], named[keep]
            order = np.lexsort((named, ~own if own.dtype.kind == "i" else -own))[:k]
            found += [(query, int(named[j]), int(own[j])) for j in order]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(df: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where ``asks`` holds, against all rows."""
    spark = df.sparkSession
    small_batches(spark, 5_000)
    vector = F.col(f"`{vector_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.when(usable(vector), vector).alias("v"))
    rows = rows.filter("v IS NOT NULL AND id IS NOT NULL").select("id", "asks", quantised(F.col("v")).alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = np.unique(_matrix(pd.Series([r["v"] for r in sample]), width), axis=0)
    cells = place(rows, centres, width)
    summary = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r"), F.max(F.when(F.col("asks"), F.col("dist"))).alias("s"), F.count_if("asks").alias("q"))
    repeats = cells.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    count, radius, spread, asking = (np.zeros(len(centres)) for _ in range(4))
    for r in summary.collect():  # one row a pivot
        count[r["cell"]], radius[r["cell"]], spread[r["cell"]], asking[r["cell"]] = r["n"], r["r"], r["s"] or 0.0, r["q"]
    asked, held = exchanged(cells, Cells(centres, count, radius, spread, k + repeats), asking)

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return best_of_block(q, x, k)

    keys = ["cell", "block", "part"]
    local = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def place(rows: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """Rows (id, asks, v) with the cell of the nearest pivot and the distance to it; written once."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["v"], width)
            with np.errstate(invalid="ignore", over="ignore"):
                square = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T
                cell = square.argmin(axis=1)
                dist = np.linalg.norm(x - centres[cell], axis=1)
            yield pd.DataFrame({"id": batch["id"], "asks": batch["asks"], "cell": cell, "dist": dist, "x": [v.tobytes() for v in x]})

    return cut(rows.mapInPandas(assign, ROW), "cells")


def dealt(pivots: np.ndarray, asking: np.ndarray) -> tuple[list[int], list[int]]:
    """First part and number of parts of each group, along a walk from pivot to nearest pivot."""
    left, walk = set(range(len(pivots))), []
    while left:
        near = min(left, key=lambda g: (float(np.square(pivots[g] - pivots[walk[-1]]).sum()) if walk else 0.0, g))
        left.remove(near)
        walk.append(near)
    first, parts, part, held = [0] * len(walk), [1] * len(walk), 0, 0
    for g in walk:
        n = int(asking[g])
        if held and held + n > QUERIES_PER_PART:
            part, held = part + 1, 0
        first[g], parts[g] = part, max(1, -(-n // QUERIES_PER_PART))
        part, held = (part + parts[g], 0) if n >= QUERIES_PER_PART else (part, held + n)
    return first, parts


def exchanged(rows: DataFrame, cells: Cells, asking: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(queries, rows) as (id, cell, block, part, x): what has to meet, and nothing else.

    ``asking``: queries by group.
    """
    blocks = np.maximum(1, -(-cells.count // ROWS_PER_BLOCK)).astype(int).tolist()
    with np.errstate(over="ignore"):
        first_part, parts = dealt(cells.pivots, asking)
    first = F.row_number().over(Window.partitionBy("id").orderBy("x"))
    queries = rows.filter("asks").withColumn("n", first).filter("n = 1").select("id", "cell", "x")

    def per_cell(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values])[F.col("cell")]

    part = (per_cell(first_part) + F.pmod(F.xxhash64("id"), per_cell(parts))).cast("int").alias("part")

    def wish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            wanted = cells.cells_of(_unpack(batch["x"]), batch["cell"].to_numpy())
            at, cell = np.nonzero(wanted)
            yield pd.DataFrame({"id": batch["id"].to_numpy()[at], "part": batch["part"].to_numpy()[at], "cell": cell, "x": batch["x"].to_numpy()[at]})

    all_blocks = F.explode(F.sequence(F.lit(0), per_cell(blocks) - 1)).alias("block")
    wishes = cut(queries.select("id", "cell", part, "x").mapInPandas(wish, "id long, part int, cell int, x binary"), "wishes")
    plan = cut(wishes.select("part", "cell").distinct(), "plan")
    block = F.pmod(F.xxhash64("id", "x"), per_cell(blocks)).cast("int").alias("block")
    held = rows.select("id", "cell", block, "x")
    held = held.join(F.broadcast(plan), "cell") if plan.count() <= PLAN_ROWS else held.join(plan.select("part", "cell", all_blocks), ["cell", "block"])
    return wishes.select("id", "cell", all_blocks, "part", "x"), held.select("id", "cell", "block", "part", "x")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(df, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM v),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, sum(q.c * d.c)::BIGINT AS score
  FROM e q JOIN e d ON q.i = d.i AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op8_topk": op8_topk}
ORACLES = {"op8_topk": SQL}
