"""What near-dedup leaves on disk: bands dealt once, no text moved for nothing, spent shuffles gone."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from doclake.llm import near_dedup
from doclake.session import SPARING, held


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(spark):
    """Shuffles whose files are kept."""
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_op2_moves_no_text(spark, corpus_dir):
    plan = plan_of(near_dedup.op2_near_dedup(spark, corpus_dir))
    assert "doc:struct<doc_id:bigint>" in plan and "text" not in plan


def test_named_columns_of_near_duplicates(spark, odd):
    whole = near_dedup.near_duplicates(odd, width=2).select("doc.doc_id", "doc.size", "n_shingles", "component_id", "stays")
    some = near_dedup.near_duplicates(odd, width=2, columns=["size"])
    assert some.schema["doc"].dataType.names == ["size"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in some.select("doc.size", "n_shingles", "component_id", "stays").collect()), key=key)
    assert got == sorted((tuple(r)[1:] for r in whole.collect()), key=key)


def test_bands_are_dealt_once(spark, corpus_dir):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    rows = near_dedup.sketched(docs, "text", 2)
    assert "bands" not in rows.columns
    classes = rows.filter("n > 0").groupBy("set_key").agg(F.min("row_id").alias("node"))
    bands = near_dedup.dealt_bands(rows, classes)
    members = bands.join(near_dedup.common_bands(bands), "band")
    found = {(r["node"], r["band"]) for r in members.collect()}
    final = plan_of(members).split("Initial Plan")[0]
    dealt = [line for line in final.splitlines() if "REPARTITION_BY_COL" in line]
    assert sum("ReusedExchange" not in line for line in dealt) == 1, final

    every = {(r["node"], b) for r in bands.groupBy("node").agg(F.collect_list("band").alias("b")).collect() for b in r["b"]}
    by_band = {}
    for node, band in every:
        by_band.setdefault(band, set()).add(node)
    sets = {}
    for band, nodes in by_band.items():
        if len(nodes) > 1:
            sets[frozenset(nodes)] = min(band, sets.get(frozenset(nodes), band))
    assert found == {(node, band) for nodes, band in sets.items() for node in nodes}


def test_spent_shuffles_go(spark, corpus_dir):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    before = shuffles(spark)
    near_dedup.near_duplicates(docs, width=2)
    assert shuffles(spark) <= before


def test_settings_are_held_and_given_back(spark):
    before = {key: spark.conf.get(key, None) for key in SPARING}
    with contextlib.suppress(ZeroDivisionError), held(spark, SPARING):
        assert all(spark.conf.get(key) == value for key, value in SPARING.items())
        1 / 0
    assert {key: spark.conf.get(key, None) for key in SPARING} == before
