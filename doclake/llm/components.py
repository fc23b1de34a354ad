"""Connected components of an edge table by hooking and contraction.

Each round every node hooks to its smallest neighbour (if smaller than itself),
pointer jumping takes every node to the root of its tree, and the edges are
rewritten between roots. Hooks only ever go to smaller numbers, so there are no
cycles, and every root has a neighbour that is none, so each round at least
halves the nodes that are left. Edges, pointers and components stay in tables in
the shared folder; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.session import cut_at, drop_path


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, root): the smallest node reachable, for every node of an edge."""
    return components_at(edges)[0]


def components_at(edges: DataFrame) -> tuple[DataFrame, str]:
    """As ``components``, with the path of the table for ``drop_path``."""
    total, total_path = None, None
    edges, edges_path = cut_at(_both(edges), "edges")
    while not edges.isEmpty():
        hooks = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        hooks, hooks_path = _flat(*cut_at(hooks, "hooks"))
        old = total_path
        if total is None:
            total, total_path = hooks, hooks_path
        else:
            total, total_path = cut_at(_follow(total, hooks), "roots")
        left = _both(
            edges.join(hooks.toDF("a", "ra"), "a").join(hooks.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        )
        spent = edges_path
        edges, edges_path = cut_at(left, "edges")
        for path in {spent, old, hooks_path} - {None, total_path}:
            drop_path(edges.sparkSession, path)
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")), edges_path
    drop_path(edges.sparkSession, edges_path)
    return total, total_path


def _both(edges: DataFrame) -> DataFrame:
    edges = edges.filter("a <> b")
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _follow(pointers: DataFrame, further: DataFrame) -> DataFrame:
    further = further.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return pointers.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def _flat(pointers: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Pointer jumping until every node points at a root."""
    while True:
        roots = pointers.select("root").distinct().join(pointers.select(F.col("node").alias("root"), F.col("root").alias("next")), "root")
        if roots.filter("root <> next").isEmpty():
            return pointers, path
        new, new_path = cut_at(_follow(pointers, pointers), "hooks")
        drop_path(new.sparkSession, path)
        pointers, path = new, new_path
