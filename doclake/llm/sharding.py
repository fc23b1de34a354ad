"""Sharding by a hierarchical weighted hash tree.

A row walks down region, rack and shard. At each node every child draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's path,
and the smallest draw wins, so a child is taken in proportion to its weight.
A draw depends on nothing but key, path and weight: changing one child's weight
moves rows only into or out of that child, and a subtree whose weights did not
change keeps its rows where they were.

Law ``key``: the id and the shard count decide. ``HashTree.for_shards(n)`` lays
the largest block of 16 shards out as 2 regions x 2 racks x 4 shards and hangs
every further shard under the root as a region of its own, so growing by one
shard moves rows only into the new shard. (Folding grown regions into the block
is a planned re-layout, which moves rows.)

Slots number a shard's rows 0, 1, 2, ... in order of id. They are counted in
blocks of ids: a running sum over the small table of block counts gives each
block its first slot, so no task ever sorts a whole shard.

Edge cases: a null text has no bytes (size 1, CRC 0); a null id is the key '',
sorts first and gets a slot like any other; rows that repeat an id share its
shard and get slots of their own; an empty table gives no rows; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.llm.draws import uniform, uniform_sql
from doclake.session import cut

LEVELS = 3
ROWS_PER_BLOCK = 100_000
MIN_BLOCKS = 64


@dataclass(frozen=True)
class HashTree:
    """``weights``: leaf weights by path such as 'r0/k1/s6'; ``shards``: their numbers."""

    weights: dict[str, float]
    shards: dict[str, int]

    @classmethod
    def for_shards(cls, n: int, block: int = 16) -> HashTree:
        if n < block:
            paths = [f"r{i}/k0/s{i}" for i in range(n)]
        else:
            paths = [f"r{i // 8}/k{i // 4}/s{i}" for i in range(block)] + [f"g{i}/k0/s{i}" for i in range(block, n)]
        return cls(dict.fromkeys(paths, 1.0), {p: i for i, p in enumerate(paths)})

    def children(self) -> list[tuple[str, str, float]]:
        """(parent, child, weight) of every inner edge; the root is ''."""
        total: dict[tuple[str, str], float] = {}
        for path, weight in self.weights.items():
            parts = path.split("/")
            for i in range(len(parts)):
                edge = "/".join(parts[:i]), "/".join(parts[: i + 1])
                total[edge] = total.get(edge, 0.0) + weight
        return [(a, b, w) for (a, b), w in total.items() if w > 0]


def place(df: DataFrame, key: Column, tree: HashTree, out: str) -> DataFrame:
    """Add the shard of each row as column ``out``; one projection a level."""
    by_parent: dict[str, list[tuple[str, float]]] = {}
    for parent, child, weight in tree.children():
        by_parent.setdefault(parent, []).append((child, weight))
    path = f"__{out}_path"
    df = df.withColumn(path, F.lit(""))
    for level in range(LEVELS):
        nodes = {p: c for p, c in by_parent.items() if len(p.split("/")) - (p == "") == level}
        options = F.create_map(
            *[
                x
                for parent, kids in nodes.items()
                for x in (F.lit(parent), F.array(*[F.struct(F.lit(c).alias("path"), F.lit(w).alias("weight")) for c, w in kids]))
            ]
        )
        drawn = F.transform(
            F.element_at(options, F.col(path)),
            lambda c: F.struct((-F.log(uniform(F.concat(key, F.lit("|"), c["path"]))) / c["weight"]).alias("draw"), c["path"].alias("path")),
        )
        df = df.withColumn(path, F.array_min(drawn)["path"])
    leaves = F.create_map(*[F.lit(x) for p, s in tree.shards.items() for x in (p, s)])
    return df.withColumn(out, F.element_at(leaves, F.col(path)).cast("int")).drop(path)


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Gapless slots from 0 in each shard, in the order of ``order`` (the first a long)."""
    low, high, count = rows.agg(F.min(order[0]), F.max(order[0]), F.count(F.lit(1))).first()
    blocks = max(MIN_BLOCKS, -(-count // ROWS_PER_BLOCK))
    if low is None or low == high:
        block = F.lit(1)
    else:
        block = F.width_bucket(F.col(order[0]).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(blocks))
    rows = rows.withColumn("__block", F.coalesce(block, F.lit(-1)).cast("long"))
    counts = rows.groupBy(shard, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(shard).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(shard, "__block", F.coalesce(before, F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy(shard, "__block").orderBy(*[F.asc_nulls_first(c) for c in order]))
    return (
        rows.withColumn("__rank", within)
        .join(first, [shard, "__block"])
        .withColumn("slot", (F.col("__first") + F.col("__rank") - 1).cast("long"))
        .drop("__block", "__n", "__first", "__rank")
    )


def shard_documents(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col(f"`{text_col}`")
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = place(place(rows, key, HashTree.for_shards(shards), "shard"), key, HashTree.for_shards(shards + 1), "grown_shard")
    return with_slots(cut(rows, "placed"), "shard", ["id", "size", "text_crc32"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _walk_sql(tree: HashTree, out: str) -> str:
    """CTEs that walk the tree in DuckDB."""
    edges = ", ".join(f"('{a}', '{b}', {w!r})" for a, b, w in tree.children())
    leaves = ", ".join(f"('{p}', {s})" for p, s in tree.shards.items())
    draw = f"-ln({uniform_sql('''k || '|' || child''')}) / weight"
    levels = [f"{out}_0 AS (SELECT DISTINCT k, '' AS path FROM d)"]
    for i in range(LEVELS):
        levels.append(f"{out}_{i + 1} AS (SELECT k, arg_min(child, {draw}) AS path FROM {out}_{i} JOIN {out}_edges ON parent = path GROUP BY k)")
    return (
        f"{out}_edges(parent, child, weight) AS (VALUES {edges}), {out}_leaves(path, {out}) AS (VALUES {leaves}), "
        + ", ".join(levels)
        + f", {out}_at AS (SELECT k, {out}::INTEGER AS {out} FROM {out}_{LEVELS} JOIN {out}_leaves USING (path))"
    )


SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS i, doc_id, coalesce(doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
steps(n, c, s) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT n, xor(c >> 1, 3988292384 * (c & 1)), s + 1 FROM steps WHERE s < 8),
remainders AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE s = 8),
crc AS (
  SELECT i, xor(4294967295, list_reduce(list_transform(range(1, size), lambda p: ('0x' || substr(h, 2 * p - 1, 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32 FROM d, remainders),
{_walk_sql(HashTree.for_shards(16), "shard")}, {_walk_sql(HashTree.for_shards(17), "grown_shard")}
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM d JOIN crc USING (i) JOIN shard_at USING (k) JOIN grown_shard_at USING (k)
"""

QUERIES = {"op3_sharding": op3_sharding}
ORACLES = {"op3_sharding": SQL}
