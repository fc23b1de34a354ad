"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources share the total size by weight, no source above ``cap``
times its own size; what a capped source cannot take is shared again by weight.
That fixed point is ``min(cap * size, t * weight)`` with one level ``t``, found
from running sums over the sources, ordered by how soon each is capped.

Copies: a source with ratio ``target / size`` gives every document the ratio's
whole part in certain copies. The fraction left is an inclusion probability
``p`` for one copy more: each document draws a uniform ``u``, is ranked by its
random odds over its inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and the
smallest ranks are taken until their sizes fill what the certain copies left,
stopping at the document that comes nearest. The sample's size in words is
therefore fixed up to half a document, while ``p`` differs from document to
document: it is proportional to the document's weight, scaled so that the
expected words are the source's rest (documents of ``p >= 1`` rank first).

Weights count in millionths, so their sums are exact whatever the order of
rows. ``weight_col`` names a column of them; without one all are alike. The
query weighs a document of n words ``2 n / (n + LENGTH_SCALE)``: fragments are
repeated less readily than documents of some length.

Shapes at scale: ranks are cut into fine bins by a monotone map to (0, 1). Bin
sums (pre-aggregated, bins grow with the rows) say in which bin a source's cut
falls; only that bin's documents are sorted. A source with a third of all rows
is so never sorted or collected as a whole.

Edge cases: a null text has size 0; a null source is a source of its own, last
in order; rows that repeat an id are documents of their own, and equal ranks
are broken by size; a source of size 0 has target 0 and is not taken; negative or null document weights count
as 0; an empty table gives no rows; other columns are kept (``mixed``) or
ignored (the query), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.llm.draws import uniform, uniform_sql
from doclake.session import cut

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
ROWS_PER_BIN = 2_000
MIN_BINS = 256
SEED = "mix-1"
MILLIONTHS = 1_000_000
LENGTH_SCALE = 200


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, ...) -> with weight and target. One row per source.

    Weights 1, 2, 3, repeating, over the sources by code point, null last.
    """
    order = [F.col("source").isNull(), F.col("source")]
    place = F.row_number().over(Window.orderBy(*order))
    rows = sizes.withColumn("weight", (F.pmod(place - 1, F.lit(3)) + 1).cast("long"))
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    soon = Window.orderBy(F.col("source_size") / F.col("weight"), *order)
    upto = soon.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.sum("source_size").over(everyone).alias("__all"),
        F.sum("weight").over(everyone).alias("__w"),
        F.coalesce(F.sum("source_size").over(upto), F.lit(0)).alias("__s0"),
        F.coalesce(F.sum("weight").over(upto), F.lit(0)).alias("__w0"),
    )
    level = (F.col("__all") - cap * F.col("__s0")) / (F.col("__w") - F.col("__w0"))
    fits = level * F.col("weight") <= F.lit(float(cap)) * F.col("source_size")
    # capping raises the level while the capped are below it and lowers it after: the right one is the largest
    rows = rows.withColumn("__level", F.max(F.when(fits, level)).over(everyone))
    capped = F.lit(float(cap)) * F.col("source_size")
    target = F.least(capped, F.coalesce(F.col("__level") * F.col("weight"), capped))
    return rows.select(*sizes.columns, "weight", target.alias("target"))


def sample(rows: DataFrame, by_source: DataFrame, seed: str = SEED) -> DataFrame:
    """Add the certain copies and the Pareto rank to rows (id, source, size, units); ``by_source`` has ``mass``, the sum of units times size."""
    shares = by_source.withColumn("__ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    shares = shares.select(
        F.col("source").alias("__source"),
        "source_size",
        "target",
        F.floor("__ratio").cast("long").alias("__certain"),
        (F.col("target") - F.floor("__ratio") * F.col("source_size")).alias("__rest"),
        F.col("mass").cast("double").alias("__mass"),
    )
    rows = rows.join(shares, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    p = F.when(F.col("__mass") > 0, F.least(F.lit(1.0), F.col("__rest") * F.col("units") / F.col("__mass"))).otherwise(0.0)
    u = uniform(F.concat(F.lit(seed + "|"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    odds = (u / (1 - u)) / (p / (1 - p))
    # certain inclusions rank first, impossible ones last
    q = F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(float("inf"))).otherwise(odds)
    return rows.withColumn("__q", q).drop("__mass")


def length_weight(size: Column) -> Column:
    """``2 n / (n + LENGTH_SCALE)`` in whole millionths."""
    return F.floor(F.lit(2 * MILLIONTHS) * size / (size + LENGTH_SCALE)) / F.lit(float(MILLIONTHS))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight_col: str | None = None, seed: str = SEED) -> DataFrame:
    """All columns of ``df`` in struct ``doc``, with size, source_size, target and copies."""
    weight = F.col(f"`{weight_col}`").cast("double") if weight_col else F.lit(1.0)
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        weight.alias("weight"),
    )
    return choose(rows, seed)


def choose(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows (id, source, size, weight, ...) with source_size, target, copies."""
    units = F.round(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)) * MILLIONTHS).cast("long")
    columns = rows.columns
    rows = cut(rows.withColumn("units", F.coalesce(units, F.lit(0))), "sizes")
    count = rows.count()
    bins = max(MIN_BINS, -(-count // ROWS_PER_BIN))
    mass = F.sum(F.col("units").cast("decimal(20,0)") * F.col("size")).alias("mass")
    by_source = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), mass)), "targets")
    ranked = sample(rows, by_source, seed)
    at = F.when(F.col("__q") == float("inf"), F.lit(bins)).otherwise(F.floor(F.col("__q") / (1 + F.col("__q")) * bins)).cast("long")
    ranked = ranked.withColumn("__bin", at)
    # where each source's cut falls: the bin that holds the words' end
    sums = ranked.filter(F.col("__q") < float("inf")).groupBy("source", "__bin", "__rest").agg(F.sum("size").alias("__n"))
    run = Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(run), F.lit(0)))
    edge = cut(
        sums.filter((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("__n") > F.col("__rest"))).select(
            F.col("source").alias("__es"), F.col("__bin").alias("__eb"), F.col("__before").alias("__ebefore")
        ),
        "edges",
    )
    joined = ranked.join(edge, F.col("source").eqNullSafe(F.col("__es")), "left").drop("__es")
    inside = Window.partitionBy("source").orderBy("__q", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    on_edge = joined.filter(F.col("__bin") == F.col("__eb"))
    before = F.col("__ebefore") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    near = 2 * before + F.col("size") <= 2 * F.col("__rest")
    on_edge = on_edge.withColumn("copies", F.col("__certain") + near.cast("long"))
    off = joined.filter(F.col("__eb").isNull() | (F.col("__bin") != F.col("__eb")))
    # without an edge bin the whole source fits into what is left
    below = (F.col("__q") < float("inf")) & (F.col("__rest") > 0) & (F.col("__eb").isNull() | (F.col("__bin") < F.col("__eb")))
    off = off.withColumn("copies", F.col("__certain") + below.cast("long"))
    keep = [*columns, "source_size", "target", "copies"]
    return on_edge.select(*keep).unionByName(off.select(*keep))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = df.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("weight", length_weight(F.col("size")))
    return choose(rows).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = f"""
WITH d AS (
  SELECT *, {2 * MILLIONTHS} * size // (size + {LENGTH_SCALE}) AS units FROM (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(units::HUGEINT * size)::DOUBLE AS mass FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
r AS (
  SELECT *, sum(source_size) OVER () AS a, sum(weight) OVER () AS tw,
         coalesce(sum(source_size) OVER f, 0) AS s0, coalesce(sum(weight) OVER f, 0) AS w0
  FROM w WINDOW f AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (a - {CAP} * s0)::DOUBLE / (tw - w0)::DOUBLE AS level FROM r),
t AS (
  SELECT source, source_size, mass,
         least({CAP}.0::DOUBLE * source_size, coalesce(max(CASE WHEN level * weight <= {CAP}.0::DOUBLE * source_size THEN level END) OVER () * weight,
               {CAP}.0::DOUBLE * source_size)) AS target
  FROM l),
x AS (
  SELECT doc_id, size, units, mass, d.source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest,
         {uniform_sql(f"'{SEED}|' || coalesce(doc_id::VARCHAR, '')")} AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p <= 0 THEN 'infinity'::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END AS q
  FROM (SELECT *, CASE WHEN mass > 0 THEN least(1.0::DOUBLE, rest * units / mass) ELSE 0 END AS p FROM x WHERE rest > 0)),
c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target, (size * (certain + (2 * before + size <= 2 * rest)::INT))::BIGINT AS taken FROM c
UNION ALL
SELECT doc_id, size, source_size, target, (size * certain)::BIGINT AS taken FROM x WHERE NOT rest > 0
"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": SQL}
