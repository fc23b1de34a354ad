"""Candidate lifecycle, decisions and snapshots: MERGE-shaped joins and folds over append-only logs."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions.identifiers import TEXT_FIELDS, agreement_key
from doclake.functions.naming import collision_key, shorten
from doclake.functions.text import alnum_key

# Source ranks and states.
SOURCE_RANK = {"user": 100, "provider": 50, "pdf_layout": 30, "pdf_info": 20, "pdf_text_doi": 10}
DECIDED = ("accepted", "rejected")
SYMMETRIC = ("same_document", "related_to", "equivalent_to")


def upsert(stored: DataFrame, found: DataFrame, keys: list[str], values: list[str], stale_of: tuple[str, ...] = ("proposed", "set_aside")) -> DataFrame:
    """Outcome per key of recording ``found`` over ``stored`` (column status): new, unchanged, updated, revived, decided, stale, kept."""
    old = stored.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.col("status").alias("old_status"), F.lit(True).alias("had"))
    new = found.select(*keys, *values, F.col("status").alias("new_status"), F.lit(True).alias("has"))
    return outcomes(old.join(new, keys, "full_outer"), keys, values, stale_of)


def outcomes(rows: DataFrame, keys: list[str], values: list[str], stale_of: tuple[str, ...] = ("proposed", "set_aside")) -> DataFrame:
    """``upsert`` for rows in which stored and found stand side by side: ``had``, ``old_status``, old values; ``has``, ``new_status``, values."""
    same = F.col("old_status") == F.col("new_status")
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(v))
    outcome = (
        F.when(F.col("had").isNull(), "new")
        .when(F.col("has").isNull(), F.when(F.col("old_status").isin(*stale_of), "stale").otherwise("kept"))
        .when(F.col("old_status").isin(*DECIDED), "decided")
        .when(same, "unchanged")
        .when(F.col("old_status") == "stale", "revived")
        .otherwise("updated")
    )
    status = F.when(F.col("had").isNull(), F.col("new_status")).when(F.col("has").isNull(), F.when(F.col("old_status").isin(*stale_of), "stale").otherwise(F.col("old_status")))
    status = status.when(F.col("old_status").isin(*DECIDED), F.col("old_status")).otherwise(F.col("new_status"))
    return rows.select(*keys, outcome.alias("outcome"), status.alias("status"))


def orient(rows: DataFrame) -> DataFrame:
    """Symmetric relations have their smaller id first."""
    swap = F.col("kind").isin(*SYMMETRIC) & (F.col("source_id") > F.col("target_id"))
    return rows.withColumns({"source_id": F.when(swap, F.col("target_id")).otherwise(F.col("source_id")), "target_id": F.when(swap, F.col("source_id")).otherwise(F.col("target_id"))})


def source_rank(source):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i in SOURCE_RANK.items() for x in i]), source), F.lit(0))


def safe_batch(candidates: DataFrame, values: DataFrame) -> DataFrame:
    """What the safe rule does for each (document, field) with safe proposals: accept, upgrade or the reason it does not."""
    safe = candidates.filter("status = 'proposed' AND review = 'safe' AND (field <> 'doi' OR classification = 'own')")
    key = agreement_key(F.col("field"), F.col("value"))
    order = F.struct(source_rank(F.col("source")).alias("r"), (-F.col("priority")).alias("p"), "value")
    groups = safe.groupBy("document_id", "field").agg(F.countDistinct(key).alias("keys"), F.max_by(F.struct("value", "source"), order).alias("best"))
    held = values.select("document_id", "field", F.col("value").alias("held"), F.col("source").alias("held_source"), "locked", "accepted_by")
    rows = groups.join(held, ["document_id", "field"], "left").withColumn("value", F.col("best.value"))
    same = agreement_key(F.col("field"), F.col("held")) == agreement_key(F.col("field"), F.col("value"))
    upgrade = (
        ~F.col("locked")
        & F.startswith("accepted_by", F.lit("rule:"))
        & F.col("field").isin(*TEXT_FIELDS)
        & (alnum_key(F.col("held")) == alnum_key(F.col("value")))
        & (source_rank(F.col("best.source")) > source_rank(F.col("held_source")))
    )
    action = (
        F.when(F.col("keys") > 1, "disagree")
        .when(F.col("held").isNull() | (F.col("held") == F.col("value")), "accept")
        .when(same, F.when(upgrade, "upgrade").otherwise("same_words"))
        .otherwise("differs")
    )
    return rows.select("document_id", "field", F.when(F.col("keys") == 1, F.col("value")).alias("value"), action.alias("action"))


def decide(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates after decisions (candidate_id, decision accept or reject).

    Open candidates that agree with an accepted one of their document and field
    are accepted with it; a rejection stands for itself; accepted ones stay.
    """
    rows = candidates.withColumn("key", agreement_key(F.col("field"), F.col("value"))).join(decisions, "candidate_id", "left")
    taken = rows.filter("decision = 'accept'").select("document_id", "field", "key").distinct().withColumn("agrees", F.lit(True))
    rows = rows.join(taken, ["document_id", "field", "key"], "left")
    open_ = F.col("status").isin("proposed", "stale", "set_aside")
    status = (
        F.when(F.col("decision") == "accept", "accepted")
        .when((F.col("decision") == "reject") & (F.col("status") != "accepted"), "rejected")
        .when(open_ & F.col("agrees"), "accepted")
        .otherwise(F.col("status"))
    )
    return rows.select("candidate_id", "document_id", "field", F.col("status").alias("old_status"), status.alias("status"))


def item_decisions(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions (candidate_id, decision) for queue items (document_id, field, value, accept): the surest proposal is accepted, or all are rejected."""
    open_ = candidates.filter("status = 'proposed'").join(items, ["document_id", "field", "value"])
    place = F.row_number().over(Window.partitionBy("document_id", "field", "value").orderBy("priority", "candidate_id"))
    return open_.withColumn("place", place).filter("place = 1 OR NOT accept").select("candidate_id", F.when(F.col("accept"), "accept").otherwise("reject").alias("decision"))


def value_states(events: DataFrame) -> DataFrame:
    """(document_id, field, value, locked, accepted_by) after a log of set, clear, lock and unlock (seq, action, value, actor).

    Folds to the newest of each kind of event; a rule's value does not count while the
    field is locked, a person's does.
    """
    locks = events.filter("action IN ('lock', 'unlock')").select("document_id", "field", F.col("seq").alias("at"), (F.col("action") == "lock").alias("on"))
    values = events.filter("action IN ('set', 'clear')")
    before = values.filter("actor <> 'user'").select("document_id", "field", "seq").join(locks, ["document_id", "field"]).filter("at < seq")
    barred = before.groupBy("document_id", "field", "seq").agg(F.max_by("on", "at").alias("on")).filter("on").select("document_id", "field", "seq")
    values = values.join(barred, ["document_id", "field", "seq"], "left_anti")
    last = values.groupBy("document_id", "field").agg(F.max_by(F.struct("action", "value", "actor"), "seq").alias("v"))
    now = locks.groupBy("document_id", "field").agg(F.max_by("on", "at").alias("locked"))
    rows = last.join(now, ["document_id", "field"], "left").filter("v.action = 'set'")
    return rows.select("document_id", "field", "v.value", F.coalesce("locked", F.lit(False)).alias("locked"), F.col("v.actor").alias("accepted_by"))


def verify_hashes(known: DataFrame, read: DataFrame) -> DataFrame:
    """(location_id, result) of reading files again; ``read``: location_id, artifact_id, outcome (ok, changing, unreadable)."""
    again = read.select("location_id", F.col("artifact_id").alias("now"), "outcome")
    rows = known.select("location_id", "artifact_id").join(again, "location_id", "left")
    result = F.when(F.col("outcome").isNull(), "missing").when(F.col("outcome") != "ok", F.col("outcome")).when(F.col("now") == F.col("artifact_id"), "ok").otherwise("mismatch")
    return rows.select("location_id", result.alias("result"))


def fold_events(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Last value per key of an append-only log."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("value"), F.count(F.lit(1)).alias("events"))


def history(events: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Old and new value of every change."""
    old = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    return events.select(*key, *order, old.alias("old_value"), F.col(value).alias("new_value")).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Insert-or-replace: the newest row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("r")).select(key, "r.*")


def unexpired(rows: DataFrame, now: str, column: str = "expires_at") -> DataFrame:
    return rows.filter(F.col(column) > F.lit(now).cast("timestamp"))


def insert_ignore(stored: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Set insertion: stored rows stay, new keys come once."""
    return stored.unionByName(added.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def merge_documents(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges between survivors after merges: ends mapped, loops dropped, repeats folded into the smallest id."""
    for end in ("source_id", "target_id"):
        edges = edges.join(survivors.select(F.col("document_id").alias(end), F.col("survivor").alias("__s")), end, "left")
        edges = edges.withColumn(end, F.coalesce("__s", end)).drop("__s")
    edges = orient(edges.filter("source_id <> target_id"))
    return edges.groupBy("kind", "source_id", "target_id").agg(F.min("relation_id").alias("relation_id"), F.count(F.lit(1)).alias("folded"))


# ------------------------------------------------------------- reconciliation


def reconcile(known: DataFrame, seen: DataFrame) -> DataFrame:
    """One row per (root_id, path_key) of either snapshot with its outcome.

    ``known``: root_id, path_key, artifact_id, size, state. ``seen``: root_id,
    path_key, artifact_id, size, outcome (ok, changing, unreadable).
    """
    keys = ["root_id", "path_key"]
    old = known.select(*keys, F.col("artifact_id").alias("old_artifact"), F.col("size").alias("old_size"), F.col("state").alias("old_state"), F.lit(True).alias("was"))
    new = seen.select(*keys, "artifact_id", "size", "outcome", F.lit(True).alias("now"))
    rows = old.join(new, keys, "full_outer")
    have = rows.join(known.select(F.col("artifact_id")).distinct().withColumn("held", F.lit(True)), "artifact_id", "left")
    result = (
        F.when(F.col("now").isNull(), F.when(F.col("old_state") == "missing", "still_missing").otherwise("missing"))
        .when(F.col("outcome") == "changing", "changing")
        .when(F.col("outcome") == "unreadable", "inaccessible")
        .when(F.col("was").isNull(), F.when(F.col("held"), "new_location").otherwise("new_artifact"))
        .when(F.col("old_artifact") != F.col("artifact_id"), "replaced")
        .when(F.col("old_state") != "active", "reappeared")
        .when(F.col("old_size") != F.col("size"), "touched")
        .otherwise("unchanged")
    )
    return have.select(*keys, "old_artifact", "artifact_id", result.alias("result"))


def pair_moves(result: DataFrame) -> DataFrame:
    """Missing and new paths of one artifact paired one to one.

    Where an artifact has one of each, a join pairs them. The rest is greedy
    (same name, then same folder, then path) within one artifact.
    """
    gone = result.filter("result IN ('missing', 'still_missing')").select(F.col("old_artifact").alias("artifact_id"), "root_id", F.col("path_key").alias("old_path"))
    come = result.filter("result = 'new_location'").select("artifact_id", "root_id", F.col("path_key").alias("new_path"))
    keys = ["root_id", "artifact_id"]
    counts = gone.groupBy(*keys).agg(F.count(F.lit(1)).alias("g")).join(come.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")), keys)
    single = counts.filter("g = 1 AND c = 1").select(*keys)
    simple = gone.join(single, keys).join(come, keys).select(*keys, "old_path", "new_path")
    several = counts.filter("g > 1 OR c > 1").select(*keys)

    def greedy(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        left, rows = sorted(old["old_path"]), []
        for path in sorted(new["new_path"]):
            if not left:
                break
            name, folder = path.rpartition("/")[2], path.rpartition("/")[0]
            best = min(left, key=lambda p: (p.rpartition("/")[2] != name, p.rpartition("/")[0] != folder, p))
            left.remove(best)
            rows.append((old["root_id"].iloc[0], old["artifact_id"].iloc[0], best, path))
        return pd.DataFrame(rows, columns=["root_id", "artifact_id", "old_path", "new_path"])

    fresh = [F.col(k).alias(k) for k in keys]  # both sides come from one table: give the right one columns of its own
    arrived = come.join(several, keys).select(*fresh, F.col("new_path").alias("new_path"))
    rest = gone.join(several, keys).groupBy(*keys).cogroup(arrived.groupBy(*keys))
    return simple.unionByName(rest.applyInPandas(greedy, "root_id string, artifact_id string, old_path string, new_path string"))


def mass_missing(result: DataFrame, least: int = 10, share: float = 0.5) -> DataFrame:
    """Roots of which suspiciously many paths are gone."""
    counts = result.filter("old_artifact IS NOT NULL").groupBy("root_id").agg(F.count_if(F.col("result") == "missing").alias("missing"), F.count(F.lit(1)).alias("known"))
    return counts.filter((F.col("missing") >= least) & (F.col("missing") >= share * F.col("known")))


def extraction_action(artifact: DataFrame, extraction: DataFrame, profile: str, force: bool = False, imported: bool = False) -> DataFrame:
    """Per artifact: extract, re_extract, keep_imported, failed_before or current."""
    rows = artifact.join(extraction.select("artifact_id", "status", "source", "profile_id"), "artifact_id", "left")
    action = (
        F.when(F.col("status").isNull(), "extract")
        .when(F.lit(force), "re_extract")
        .when(F.col("source") == "imported", "re_extract" if imported else "keep_imported")
        .when(F.col("profile_id") != profile, "re_extract")
        .when(F.col("status") == "failed", "failed_before")
        .otherwise("current")
    )
    return rows.select("artifact_id", action.alias("action"))


# --------------------------------------------------------------- destinations


def disambiguate(rows: DataFrame) -> DataFrame:
    """(item, artifact_id, wanted) -> final path; every member of a colliding group gets a tag, copies a counter."""
    group = Window.partitionBy("collision")
    rows = rows.withColumn("collision", collision_key(F.col("wanted")))
    rows = rows.withColumn("members", F.count(F.lit(1)).over(group)).withColumn("copy", F.row_number().over(Window.partitionBy("collision", "artifact_id").orderBy("item")))
    folder = F.when(F.contains("wanted", F.lit("/")), F.regexp_replace("wanted", "[^/]*$", "")).otherwise("")
    name = F.substring_index("wanted", "/", -1)
    has_ext = name.rlike(r"^.+\.[^.]*$")
    stem = F.when(has_ext, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    ext = F.when(has_ext, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    tag = F.concat(F.lit(" ["), F.substring("artifact_id", 1, 8), F.lit("]"), F.when(F.col("copy") > 1, F.concat(F.lit(" -"), F.col("copy").cast("string"))).otherwise(""))
    final = F.when(F.col("members") == 1, F.col("wanted")).otherwise(F.concat(folder, shorten(F.concat(stem, tag)), ext))
    return rows.select("item", "artifact_id", "wanted", final.alias("final"))


def dependency_order(moves: list[tuple[int, str, str]]) -> list[tuple[int, str]]:
    """Order of moves (id, from, to) so that no destination is occupied; a cycle is opened by staging its smallest id."""
    left, order = dict((i, (a, b)) for i, a, b in moves), []
    occupied = {a for _, a, _ in moves}
    staged: set[int] = set()
    while left:
        ready = sorted(i for i, (_, b) in left.items() if b not in occupied)
        if not ready:
            first = min(set(left) - staged)
            order.append((first, "stage"))
            occupied.discard(left[first][0])
            staged.add(first)
            continue
        for i in ready:
            a, _ = left.pop(i)
            order.append((i, "move"))
            if i not in staged:
                occupied.discard(a)
    return order


