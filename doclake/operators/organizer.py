"""Renaming plans as tables: building, risk, staleness, root checks, relocation, recovery and plan files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.naming import component_problems, path_key
from doclake.operators.views import union

# The policy's number and the risk of each operation, by how sure the title is.
POLICY = 1
RISK = {"rename": ("low", "medium"), "move": ("medium", "high"), "rename+move": ("medium", "high")}
ITEM = ("item_id", "root_id", "location_id", "artifact_id", "document_id", "old_path", "new_path", "operation", "status", "risk", "blocked")


def operation_of(old: Column, new: Column) -> Column:
    folder = lambda p: F.regexp_replace(p, "[^/]*$", "")
    name = lambda p: F.substring_index(p, "/", -1)
    return F.when(new.isNull() | (old == new), "unchanged").when(folder(old) == folder(new), "rename").when(name(old) == name(new), "move").otherwise("rename+move")


def plan_items(wanted: DataFrame, location: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Items of a plan from (location_id, root_id, artifact_id, document_id, old_path, new_path, sure).

    A destination is blocked where its name is not usable or a current path of the
    catalog stands there that this plan does not itself vacate.
    """
    rows = wanted.withColumn("operation", operation_of(F.col("old_path"), F.col("new_path")))
    rows = rows.withColumn("new_path", F.coalesce("new_path", "old_path")).withColumn("key", path_key(F.col("new_path"), case_sensitive)).withColumn("old_key", path_key(F.col("old_path"), case_sensitive))
    left = rows.filter("operation <> 'unchanged'").select("root_id", F.col("old_key").alias("key"))
    occupied = location.filter("NOT ended").select("root_id", path_key(F.col("relative_path"), case_sensitive).alias("key")).distinct()
    taken = occupied.join(left, ["root_id", "key"], "left_anti").withColumn("taken", F.lit(True))
    rows = rows.join(taken, ["root_id", "key"], "left").withColumn("problem", F.get(component_problems(F.col("new_path")), F.lit(0)))
    moves = F.col("operation") != "unchanged"
    blocked = F.when(moves & F.col("problem").isNotNull(), F.concat(F.lit("name:"), "problem")).when(moves & F.col("taken") & (F.col("key") != F.col("old_key")), "occupied")
    risk = F.lit("low")
    for operation, (sure, unsure) in RISK.items():
        risk = F.when(F.col("operation") == operation, F.when(F.col("sure"), sure).otherwise(unsure)).otherwise(risk)
    status = F.when(~moves, "unchanged").when(F.col("blocked").isNotNull(), "blocked").otherwise("planned")
    rows = rows.withColumn("blocked", blocked).withColumns({"risk": risk, "item_id": F.concat(F.lit("i-"), "location_id")}).withColumn("status", status)
    return rows.select(*ITEM)


def plan_summary(items: DataFrame) -> DataFrame:
    """(aspect, name, items): how many items by operation, by status and by risk, in one pass."""
    pairs = F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(a).alias("name")) for a in ("operation", "status", "risk")])
    return items.select(F.explode(pairs).alias("p")).groupBy("p.aspect", "p.name").agg(F.count(F.lit(1)).alias("items"))


def plan_hash(items: DataFrame) -> DataFrame:
    """(items, digest): what a catalog registers of a plan. Item hashes are combined in an order-free sum, so no task sees the plan."""
    digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(c, F.lit("")) for c in ("item_id", "root_id", "location_id", "artifact_id", "old_path", "new_path")]).cast("binary"), 256)
    low = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(digest, 16, 15), 16, 10).cast("decimal(38,0)")
    return items.agg(F.count(F.lit(1)).alias("items"), F.sum(low).alias("a"), F.sum(high).alias("b")).select("items", F.md5(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).cast("binary")).alias("digest"))


def write_plan(items: DataFrame, folder: str) -> None:
    """A plan as JSON lines; ``sources.files.read_plan`` reads it."""
    items.select(F.col("item_id").alias("item"), "root_id", "location_id", "artifact_id", "old_path", "new_path").write.mode("overwrite").json(folder)


def registered(plans: DataFrame, registry: DataFrame, policy: int = POLICY) -> DataFrame:
    """(plan_id, state) of plan files (plan_id, digest, policy) against what was registered: ok, unknown, altered or stale_policy."""
    rows = plans.join(registry.select("plan_id", F.col("digest").alias("known")), "plan_id", "left")
    state = F.when(F.col("known").isNull(), "unknown").when(F.col("known") != F.col("digest"), "altered").when(F.col("policy") != policy, "stale_policy").otherwise("ok")
    return rows.select("plan_id", state.alias("state"))


def root_problems(planned: DataFrame, root: DataFrame) -> DataFrame:
    """(root_id, problem) for the roots of a plan (root_id, root_key): gone, another folder, not allowed or offline; null if it may be used."""
    rows = planned.join(root.select("root_id", F.col("root_key").alias("now"), "allow_organize", "status"), "root_id", "left")
    problem = F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("root_key"), "another_folder").when(~F.col("allow_organize"), "not_allowed").when(F.col("status") != "online", "offline")
    return rows.select("root_id", problem.alias("problem"))


def staleness(items: DataFrame, location: DataFrame, values: DataFrame, documents: DataFrame, standing: DataFrame) -> DataFrame:
    """(item_id, state) of each item against the catalog as it is: pending, already_applied or why it is stale.

    ``items`` carry the title they were made with; ``standing``: (item_id, location_id_after)
    of successful moves. The file is looked for where the item says it lies.
    """
    now = location.filter("NOT ended").select("root_id", F.col("relative_path").alias("old_path"), F.col("artifact_id").alias("at"), F.col("state").alias("place"))
    rows = items.join(now, ["root_id", "old_path"], "left")
    title = values.filter("field = 'title'").select("document_id", F.col("value").alias("title_now"))
    rows = rows.join(title, "document_id", "left").join(documents.select("document_id", "retired"), "document_id", "left")
    after = location.filter("NOT ended AND state = 'active'").select(F.col("location_id").alias("location_id_after")).withColumn("stands", F.lit(True))
    rows = rows.join(standing.select("item_id", "location_id_after").join(after, "location_id_after", "left"), "item_id", "left")
    here = F.coalesce((F.col("at") == F.col("artifact_id")) & (F.col("place") == "active"), F.lit(False))
    state = (
        F.when(here & ~F.col("title").eqNullSafe(F.col("title_now")), "stale_values")
        .when(here & F.col("retired"), "stale_merged")
        .when(here, "pending")
        .when(F.col("stands"), "already_applied")
        .when(F.col("location_id_after").isNotNull(), "stale_moved_again")
        .otherwise("stale_file")
    )
    return rows.select("item_id", state.alias("state"))


def destination_verdicts(items: DataFrame, location: DataFrame) -> DataFrame:
    """(item_id, free): whether no other current path of the catalog is at the destination."""
    held = location.filter("NOT ended").select("root_id", F.lower("relative_path").alias("key"), F.col("location_id").alias("holder"))
    rows = items.withColumn("key", F.lower("new_path")).join(held, ["root_id", "key"], "left")
    return rows.groupBy("item_id").agg((F.count_if(F.col("holder").isNotNull() & (F.col("holder") != F.col("location_id"))) == 0).alias("free"))


def relocated(location: DataFrame, moves: DataFrame, seq: int) -> DataFrame:
    """Locations after moves (location_id, new_path): the old row ends as moved and names its successor, which opens.

    Columns location_id, root_id, relative_path, artifact_id, ended, end_reason, successor_location_id.
    """
    columns = ["location_id", "root_id", "relative_path", "artifact_id", "ended", "end_reason", "successor_location_id"]
    rows = location.select(*columns).join(moves.select("location_id", "new_path"), "location_id", "left")
    successor = F.concat("location_id", F.lit(f"@{seq}"))
    moved = F.col("new_path").isNotNull() & ~F.col("ended")
    closed = rows.select(
        "location_id", "root_id", "relative_path", "artifact_id", (F.col("ended") | moved).alias("ended"), F.when(moved, "moved").otherwise(F.col("end_reason")).alias("end_reason"),
        F.when(moved, successor).otherwise(F.col("successor_location_id")).alias("successor_location_id"),
    )
    opened = rows.filter(moved).select(
        successor.alias("location_id"), "root_id", F.col("new_path").alias("relative_path"), "artifact_id", F.lit(False).alias("ended"),
        F.lit(None).cast("string").alias("end_reason"), F.lit(None).cast("string").alias("successor_location_id"),
    )
    return closed.unionByName(opened)


def recovered(items: DataFrame) -> DataFrame:
    """(item_id, outcome) of unfinished journal items from what is on disk.

    ``items``: item_id, state, and the digests found at the source, the destination and
    the temporary name (null where nothing is), with the digest expected.
    """
    own = lambda c: F.coalesce(F.col(c) == F.col("expected"), F.lit(False))
    source, temp = F.col("source").isNotNull(), F.col("temp").isNotNull()
    outcome = (
        F.when(F.col("state") == "planned", "not_started")
        .when(own("destination") & ~source & ~temp, "succeeded")
        .when(own("source") & ~temp & ~own("destination"), "never_moved")
        .when(temp & ~source & ~own("destination"), "restore")
        .otherwise("uncertain")
    )
    return items.select("item_id", outcome.alias("outcome"))


def undo_items(journal: DataFrame) -> DataFrame:
    """What undoing an operation would do: its successful moves backwards, the last first within each root."""
    rows = journal.filter("state = 'succeeded'")
    return rows.select("operation_id", "row_id", "root_id", F.col("new_path").alias("from_path"), F.col("old_path").alias("to_path"), (-F.col("row_id")).alias("order"))


def events(closed: DataFrame, opened: DataFrame) -> DataFrame:
    """(location_id, event, detail): both sides of each move."""
    return union([closed.select("location_id", F.lit("moved_to").alias("event"), F.col("new_path").alias("detail")), opened.select("location_id", F.lit("moved_from").alias("event"), F.col("old_path").alias("detail"))])


def organizable(root: DataFrame, toggles: DataFrame) -> DataFrame:
    """(root_id, allow_organize, changed, usable) after a person's permissions (root_id, allow): usable are allowed roots that are online."""
    rows = root.select("root_id", "allow_organize", "status").join(toggles, "root_id", "left")
    allow = F.coalesce("allow", "allow_organize")
    return rows.select("root_id", allow.alias("allow_organize"), (allow != F.col("allow_organize")).alias("changed"), (allow & (F.col("status") == "online")).alias("usable"))
