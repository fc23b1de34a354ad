"""Exact dedup against an immutable snapshot, screened by binary-fuse filters.

A *snapshot* is a Parquet table of distinct texts (digest, text, largest id,
row count) that is never changed once written, with one static binary-fuse
filter per hash bucket of its digests. An incoming batch is grouped by itself
first (copies inside the batch), its distinct digests are screened by the
filters, and only the positives join the snapshot's exact buckets, where the
bytes are compared. A filter has no false negatives, so a digest it rejects is
new; its false positives (about 1 in 256) fall out at the byte check.

Shapes at scale: a text crosses the network once, already combined per map
task, so a third of all rows being one text costs one row per task. Snapshot and
batch are tables bucketed by digest, with as many buckets as there are shuffle
partitions, so the exact join of the suspects finds both sides in place and
moves digests only. Filters hold about 32k digests each whatever the input's
size, and the last join, from rows to groups, is a plain equi-join of narrow
rows that AQE may split where one group is hot.

Rows are combined by digest and compared by bytes. Two texts under one SHA-256
have never been seen; should bytes differ, ``Collision`` is raised, as the digest
is part of the result and could not tell the two groups apart.

Edge cases: a null text counts as empty; empty texts are equal to each other;
a null id never wins over a non-null one (a group with only null ids keeps
null); rows that repeat an id are rows of their own and count in group_size;
an empty table gives an empty result; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.session import bucketed, cut

KEYS_PER_FILTER = 32_768
MIN_FILTERS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- the filter


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and a seed."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for n keys."""
    if n <= 1:
        return 4, 3
    segment = 1 << min(18, max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return segment, max(3, int(np.ceil(n * factor / segment)) + 2)


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots per key, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    base = first * np.uint64(segment)
    a = base + (h & mask)
    b = base + np.uint64(segment) + ((h >> np.uint64(18)) & mask)
    c = base + np.uint64(2 * segment) + ((h ^ (h >> np.uint64(41))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40) & mask)
    return np.stack([a, b, c]).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """A static filter over distinct 64-bit keys: header, then one byte a slot.

    Peeling runs in rounds over whole arrays: every slot that holds one key
    frees that key, and the fingerprints are filled in the reverse order.
    """
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    segment, segments = _shape(len(keys))
    for seed in range(1, 200):
        with np.errstate(over="ignore"):
            h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            slots = _slots(h, segment, segments)
        size = segment * segments
        count = np.bincount(slots.ravel(), minlength=size)
        which = np.zeros(size, dtype=np.int64)  # xor of the keys' numbers in a slot
        number = np.arange(len(keys), dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(which, row, number)
        rounds, left = [], len(keys)
        single = np.flatnonzero(count == 1)
        while len(single):
            peeled, at = np.unique(which[single], return_index=True)
            rounds.append((peeled, single[at]))
            left -= len(peeled)
            touched = slots[:, peeled]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(which, row, peeled)
            near = np.unique(touched)
            single = near[count[near] == 1]
        if left == 0:
            prints, table = _print(h), np.zeros(size, dtype=np.uint8)
            for peeled, at in reversed(rounds):
                s = slots[:, peeled]
                table[at] = 0
                table[at] = prints[peeled] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
            return np.array([seed, segment, segments], dtype="<u8").tobytes() + table.tobytes()
        segments += max(1, segments // 16)
    raise RuntimeError("no seed peels these keys")


def probe_filter(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True where a key may be in the filter; never False for one that is."""
    seed, segment, segments = np.frombuffer(blob[:24], dtype="<u8").tolist()
    table = np.frombuffer(blob, dtype=np.uint8, offset=24)
    with np.errstate(over="ignore"):
        h = _mix(np.asarray(keys, dtype=np.uint64), seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        s = _slots(h, segment, segments)
    return table[s[0]] ^ table[s[1]] ^ table[s[2]] == _print(h)


def _key64(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[:8] for d in digests), dtype="<u8")


# -------------------------------------------------------------- the operator


def normalised(text) -> F.Column:
    """Lower-case A-Z only; null as empty. Pure ASCII takes the fast path."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def digested(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, digest): the normalised text and its SHA-256."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), normalised(F.col(f"`{text_col}`")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


class Collision(RuntimeError):
    """Two different texts have one SHA-256."""


def grouped(rows: DataFrame, name: str) -> DataFrame:
    """One row per distinct text, in a table bucketed by digest: digest, text, keep, n.

    The aggregation's only key is the digest, so its shuffle is the table's bucketing.
    """
    groups = rows.groupBy("digest").agg(F.min("text").alias("text"), F.max("text").alias("last"), F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    table = bucketed(groups.select("digest", "text", "keep", "n", (F.col("text") != F.col("last")).alias("differs")), name, "digest")
    if not table.filter("differs").isEmpty():
        raise Collision("copies of one digest differ")
    return table.drop("differs")


def _bucket(n_filters: int) -> F.Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n_filters)).cast("int").alias("bucket")


class Snapshot:
    """An immutable set of texts with its filters."""

    def __init__(self, texts: DataFrame, filters: DataFrame, n_filters: int):
        self.texts, self.filters, self.n_filters = texts, filters, n_filters

    @classmethod
    def write(cls, rows: DataFrame, expected: int) -> Snapshot:
        """``rows``: (id, text, digest); ``expected``: a bound on how many."""
        n_filters = max(MIN_FILTERS, -(-expected // KEYS_PER_FILTER))
        texts = grouped(rows, "snapshot")

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "filter": [build_filter(_key64(pdf["digest"]))]})

        filters = texts.select(_bucket(n_filters), "digest").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")
        return cls(texts, cut(filters, "filters"), n_filters)

    def screen(self, digests: DataFrame) -> DataFrame:
        """The digests that the filters cannot rule out."""

        def probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if not len(keys) or not len(filters):
                return pd.DataFrame({"digest": pd.Series([], dtype=object)})
            return pd.DataFrame({"digest": keys["digest"][probe_filter(filters["filter"].iloc[0], _key64(keys["digest"]))]})

        keys = digests.select(_bucket(self.n_filters), "digest").distinct()
        return keys.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(probe, "digest binary")


def dedup_batch(snapshot: Snapshot, rows: DataFrame) -> DataFrame:
    """Groups of snapshot and batch together: digest, text, keep, n.

    Batch copies are grouped by themselves; those that the filters let through
    join the exact buckets on digest and bytes.
    """
    batch = grouped(rows, "batch")
    suspects = batch.join(cut(snapshot.screen(batch.select("digest")), "positives"), "digest", "left_semi")
    exact = snapshot.texts.select("digest", F.col("text").alias("old_text"), F.col("keep").alias("old_keep"), F.col("n").alias("old_n"))
    known = suspects.join(exact, "digest").select(
        "digest", F.greatest("keep", "old_keep").alias("keep"), (F.col("n") + F.col("old_n")).alias("n"), (F.col("text") == F.col("old_text")).alias("same")
    )
    known = cut(known, "known")
    if not known.filter("NOT same").isEmpty():
        raise Collision("a new text and a stored one of one digest differ")
    known = known.drop("same")
    rest = snapshot.texts.select("digest", "keep", "n").unionByName(batch.select("digest", "keep", "n"))
    return known.unionByName(rest.join(known.select("digest"), "digest", "left_anti"))


def exact_dedup(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The lower half of the id range is taken in first and becomes the snapshot;
    the rest arrives as the batch, null ids with it.
    """
    low, high, count = df.agg(F.min(f"`{id_col}`"), F.max(f"`{id_col}`"), F.count(F.lit(1))).first()
    rows = digested(df, id_col, text_col)
    old = (F.col("id") < F.lit(0 if low is None else (low + high) // 2 + 1)) & F.col("id").isNotNull()
    snapshot = Snapshot.write(rows.filter(old), count)
    groups = dedup_batch(snapshot, rows.filter(~old))
    several = groups.filter("n > 1").select("digest", F.col("keep"), F.col("n"))
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return (
        rows.select("id", "digest")
        .join(several, "digest", "left")
        .select(
            F.col("id").alias(id_col),
            keep.alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("id") == keep, F.col("id").isNull() & keep.isNull()).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {"op7_exact_dedup": SQL}
