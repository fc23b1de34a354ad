"""Journal queries, with their SQL. The journal is derived from the catalog's locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.operators import journal
from doclake.plans.corpus_sql import sql
from doclake.sources.corpus import Catalog


def _journal(c: Catalog) -> tuple[DataFrame, DataFrame]:
    seq = F.col("seq")
    items = c.location.select(
        seq.alias("row_id"), F.concat(F.lit("op-"), (seq % 20).cast("string")).alias("operation_id"), F.concat(F.lit("item-"), (seq % 50).cast("string")).alias("item_id"), "root_id",
        F.when(seq % 23 == 4, F.concat(F.lit("moved/"), F.col("relative_path"))).otherwise(F.col("relative_path")).alias("new_path"),
        F.when(seq % 29 != 5, F.col("location_id")).alias("location_id_after"),
        F.when((seq % 20 < 10) & (seq % 11 == 3), "failed").when(seq % 37 == 6, "uncertain").otherwise("succeeded").alias("state"),
    )
    n = F.col("id")
    operations = c.spark.range(21).select(
        F.concat(F.lit("op-"), n.cast("string")).alias("operation_id"), F.concat(F.lit("plan-"), (n % 3).cast("string")).alias("plan_id"),
        F.when(n % 4 == 3, "undo").otherwise("apply").alias("kind"), F.when(n % 9 == 7, "running").otherwise("completed").alias("status"),
    )
    return operations, items


def standing_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.standing_moves(*_journal(Catalog(spark, sf_dir)))


def operation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.operation_summary(*_journal(Catalog(spark, sf_dir)))


def journal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    return journal.journal_findings(*_journal(c), c.location)


_TABLES = (
    """items AS (SELECT seq AS row_id, 'op-' || seq % 20 AS operation_id, 'item-' || seq % 50 AS item_id, root_id,
         CASE WHEN seq % 23 = 4 THEN 'moved/' ELSE '' END || relative_path AS new_path, CASE WHEN seq % 29 <> 5 THEN location_id END AS location_id_after,
         CASE WHEN seq % 20 < 10 AND seq % 11 = 3 THEN 'failed' WHEN seq % 37 = 6 THEN 'uncertain' ELSE 'succeeded' END AS state FROM location)""",
    """operations AS (SELECT 'op-' || n AS operation_id, 'plan-' || n % 3 AS plan_id, CASE WHEN n % 4 = 3 THEN 'undo' ELSE 'apply' END AS kind,
         CASE WHEN n % 9 = 7 THEN 'running' ELSE 'completed' END AS status FROM range(21) t(n))""",
)

QUERIES = {"standing_moves": standing_moves, "operation_summary": operation_summary, "journal_findings": journal_findings}
ORACLES = {
    "standing_moves": sql(
        """SELECT plan_id, item_id, max(row_id) AS row_id, arg_max(new_path, row_id) AS new_path FROM items JOIN operations USING (operation_id)
           WHERE kind = 'apply' AND state = 'succeeded' GROUP BY 1, 2""",
        *_TABLES,
    ),
    "operation_summary": sql(
        """SELECT operation_id, count(row_id) AS items, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state IN ('failed', 'uncertain')) AS problems,
             CASE WHEN bool_or(coalesce(state IN ('failed', 'uncertain'), false)) THEN 'completed_with_problems' ELSE 'completed' END AS status
           FROM operations LEFT JOIN items USING (operation_id) GROUP BY 1""",
        *_TABLES,
    ),
    "journal_findings": sql(
        """SELECT operation_id, NULL::BIGINT AS row_id, 'warning' AS severity, 'operation_unfinished' AS code FROM operations WHERE status = 'running'
           UNION ALL SELECT operation_id, row_id, 'warning', 'item_uncertain' FROM items WHERE state = 'uncertain'
           UNION ALL SELECT operation_id, row_id, 'error', CASE WHEN l.location_id IS NULL THEN 'item_without_location' ELSE 'item_location_mismatch' END
           FROM items i LEFT JOIN location l ON l.location_id = location_id_after
           WHERE i.state = 'succeeded' AND (l.location_id IS NULL OR l.relative_path <> new_path OR l.root_id <> i.root_id)""",
        *_TABLES,
    ),
}
