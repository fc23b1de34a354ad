"""The organizer's journal: what stands, how operations ended, and where journal and catalog disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Item states that leave an operation with problems, and finding codes.
PROBLEMS = ("failed", "uncertain")
UNFINISHED, UNCERTAIN, NO_LOCATION, ELSEWHERE = "operation_unfinished", "item_uncertain", "item_without_location", "item_location_mismatch"


def standing_moves(operations: DataFrame, items: DataFrame) -> DataFrame:
    """(plan_id, item_id, row_id, new_path): the last successful move of each plan item that was applied."""
    applied = operations.filter("kind = 'apply'").select("operation_id", "plan_id")
    rows = items.filter("state = 'succeeded'").join(applied, "operation_id")
    return rows.groupBy("plan_id", "item_id").agg(F.max(F.struct("row_id", "new_path")).alias("m")).select("plan_id", "item_id", "m.row_id", "m.new_path")


def operation_summary(operations: DataFrame, items: DataFrame) -> DataFrame:
    """Items by state of each operation and the status it closes with; one row per operation, without items too."""
    counts = items.groupBy("operation_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("state") == "succeeded").alias("succeeded"), F.count_if(F.col("state").isin(*PROBLEMS)).alias("problems")
    )
    rows = operations.select("operation_id").join(counts, "operation_id", "left").fillna(0, ["items", "succeeded", "problems"])
    return rows.withColumn("status", F.when(F.col("problems") > 0, "completed_with_problems").otherwise("completed"))


def journal_findings(operations: DataFrame, items: DataFrame, locations: DataFrame) -> DataFrame:
    """(operation_id, row_id, severity, code): unfinished operations, unconfirmed moves, and successes the catalog does not show."""
    open_ = operations.filter("status = 'running'").select("operation_id", F.lit(None).cast("long").alias("row_id"), F.lit("warning").alias("severity"), F.lit(UNFINISHED).alias("code"))
    unsure = items.filter("state = 'uncertain'").select("operation_id", "row_id", F.lit("warning").alias("severity"), F.lit(UNCERTAIN).alias("code"))
    places = locations.select(F.col("location_id").alias("location_id_after"), F.col("relative_path").alias("at"), F.col("root_id").alias("at_root"))
    done = items.filter("state = 'succeeded'").join(places, "location_id_after", "left")
    code = F.when(F.col("at").isNull(), NO_LOCATION).when((F.col("at") != F.col("new_path")) | (F.col("at_root") != F.col("root_id")), ELSEWHERE)
    wrong = done.select("operation_id", "row_id", F.lit("error").alias("severity"), code.alias("code")).filter("code IS NOT NULL")
    return open_.unionByName(unsure).unionByName(wrong)
