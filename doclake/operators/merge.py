"""Decisions on documents and relations: merges, splits, canonical choices, retractions and accepted relation proposals.

Merges come as a mapping (document_id, survivor) that is already followed to its
end (``relate.merged_survivors``), so a whole batch of merges is one join a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.operators.lifecycle import orient


PREFIX = 8  # fixed value: the shortest prefix of an id that names it


def to_survivors(rows: DataFrame, survivors: DataFrame, *columns: str) -> DataFrame:
    """Rows with the named document columns mapped to their survivors."""
    for column in columns:
        ends = survivors.select(F.col("document_id").alias(column), F.col("survivor").alias("__to"))
        rows = rows.join(ends, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")
    return rows


def preferred(pairs: DataFrame, values: DataFrame, documents: DataFrame) -> DataFrame:
    """(a, b, survivor): the one with more accepted values, then the older (column no), then the smaller id."""
    weight = values.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    known = documents.select("document_id", "no").join(weight, "document_id", "left").select("document_id", F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "no", "document_id").alias("w"))
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("document_id").alias(end), F.col("w").alias(f"w{end}")), end)
    return pairs.select("a", "b", F.least("wa", "wb")["document_id"].alias("survivor"))


def merged_artifacts(document_artifact: DataFrame, survivors: DataFrame) -> DataFrame:
    """(document_id, artifact_id, role, canonical): what is absorbed comes as another copy."""
    moved = document_artifact.join(survivors.select("document_id", "survivor"), "document_id", "left")
    came = F.col("survivor").isNotNull()
    return moved.select(
        F.coalesce("survivor", "document_id").alias("document_id"), "artifact_id", F.when(came, "alternate_copy").otherwise("primary").alias("role"), (F.col("canonical") & ~came).alias("canonical")
    )


def merged_members(members: DataFrame, survivors: DataFrame, keys: list[str]) -> DataFrame:
    """Memberships or tags of the survivors: a union, each key once."""
    return to_survivors(members.select("document_id", *keys), survivors, "document_id").distinct()


def merged_values(values: DataFrame, survivors: DataFrame) -> DataFrame:
    """(document_id, field, value, carried): the survivor's own value, else the first absorbed document's."""
    rows = values.select("document_id", "field", "value", "no").join(survivors.select("document_id", "survivor"), "document_id", "left")
    rows = rows.withColumn("into", F.coalesce("survivor", "document_id"))
    best = rows.groupBy("into", "field").agg(F.min(F.struct(F.col("survivor").isNotNull().alias("carried"), F.col("no"), F.col("value"))).alias("b"))
    return best.select(F.col("into").alias("document_id"), "field", "b.value", "b.carried")


def merged_proposals(candidates: DataFrame, survivors: DataFrame) -> DataFrame:
    """(candidate_id, kind, source_id, target_id, members, status) of relation proposals after merges.

    Ends move to the survivors. A pair that has become one document is accepted, a
    second proposal of the same pair and kind goes stale, group members are replaced;
    decided proposals stay as they are.
    """
    plain = candidates.select("candidate_id", "level", "kind", "source_id", "target_id", "members", "status")
    open_, decided = plain.filter("status = 'proposed'"), plain.filter("status <> 'proposed'")
    pairs = open_.filter("level <> 'group'")
    moved = to_survivors(pairs.withColumns({"old_source": F.col("source_id"), "old_target": F.col("target_id")}), survivors, "source_id", "target_id")
    moved = orient(moved).withColumn("touched", (F.col("source_id") != F.col("old_source")) | (F.col("target_id") != F.col("old_target")))
    order = Window.partitionBy("kind", "source_id", "target_id").orderBy("touched", "candidate_id")
    moved = moved.withColumn("copy", F.row_number().over(order))
    one = F.col("source_id") == F.col("target_id")
    status = F.when(one, "accepted").when(F.col("touched") & (F.col("copy") > 1), "stale").otherwise(F.col("status"))
    ends = {e: F.when(one, F.col(f"old_{n}")).otherwise(F.col(e)) for e, n in (("source_id", "source"), ("target_id", "target"))}
    moved = moved.withColumn("status", status).withColumns(ends)
    groups = open_.filter("level = 'group'")
    new = to_survivors(groups.select("candidate_id", F.explode("members").alias("document_id")), survivors, "document_id")
    new = new.groupBy("candidate_id").agg(F.array_sort(F.collect_set("document_id")).alias("members"))
    groups = groups.drop("members").join(new, "candidate_id")
    columns = ["candidate_id", "kind", "source_id", "target_id", "members", "status"]
    return moved.select(*columns).unionByName(groups.select(*columns)).unionByName(decided.select(*columns))


def split(document_artifact: DataFrame, documents: DataFrame, taken: DataFrame) -> DataFrame:
    """(artifact_id, outcome, document_id, canonical) after taking artifacts (artifact_id) out of their documents, and who is canonical then.

    The document that such an artifact was before a merge (``taken.former``) is revived,
    else a new one is made; a document's last artifact stays.
    """
    counts = document_artifact.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    asked = taken.select("artifact_id", "former").withColumn("asked", F.lit(True))
    rows = document_artifact.join(counts, "document_id").join(asked, "artifact_id", "left")
    place = F.row_number().over(Window.partitionBy("document_id", F.col("asked").isNotNull()).orderBy(F.desc("canonical"), "artifact_id"))
    rows = rows.withColumn("place", place).withColumn("left", F.count_if(F.col("asked").isNull()).over(Window.partitionBy("document_id")))
    # where everything is asked for, the first stays
    goes = F.col("asked").isNotNull() & (F.col("n") > 1) & ((F.col("left") > 0) | (F.col("place") > 1))
    dead = documents.filter("retired").select(F.col("document_id").alias("former"), F.lit(True).alias("retired"))
    rows = rows.withColumn("goes", goes).join(dead, "former", "left")
    revived = F.col("goes") & F.coalesce("retired", F.lit(False))
    to = F.when(revived, F.col("former")).when(F.col("goes"), F.concat(F.lit("doc-"), F.substring("artifact_id", 1, 12))).otherwise(F.col("document_id"))
    lost = F.max((F.col("goes") & F.col("canonical")).cast("int")).over(Window.partitionBy("document_id")) == 1
    heir = F.row_number().over(Window.partitionBy("document_id", "goes").orderBy(F.desc("canonical"), "artifact_id")) == 1
    canonical = F.col("goes") | F.col("canonical") | (lost & heir)
    outcome = F.when(revived, "revived").when(F.col("goes"), "created").when(F.col("asked").isNotNull(), "refused").otherwise("kept")
    return rows.select("artifact_id", outcome.alias("outcome"), to.alias("document_id"), canonical.alias("canonical"))


def chosen_canonical(document_artifact: DataFrame, wanted: DataFrame) -> DataFrame:
    """(document_id, artifact_id, canonical) after choices (document_id, artifact_id); a choice of a foreign artifact changes nothing."""
    own = wanted.join(document_artifact.select("document_id", "artifact_id"), ["document_id", "artifact_id"], "left_semi")
    pick = own.groupBy("document_id").agg(F.min("artifact_id").alias("chosen"))
    rows = document_artifact.select("document_id", "artifact_id", "canonical").join(pick, "document_id", "left")
    return rows.select("document_id", "artifact_id", F.when(F.col("chosen").isNull(), F.col("canonical")).otherwise(F.col("artifact_id") == F.col("chosen")).alias("canonical"))


def retracted(relations: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, outcome) of taking relations back by id or a prefix of PREFIX digits and more: retracted, already, ambiguous or not_found."""
    held = relations.select("relation_id", "retracted", F.substring("relation_id", 1, PREFIX).alias("key"))
    hits = asked.select("asked", F.substring("asked", 1, PREFIX).alias("key")).join(held, "key", "left").filter("relation_id IS NULL OR startswith(relation_id, asked)")
    found = hits.groupBy("asked").agg(F.count("relation_id").alias("n"), F.bool_or("retracted").alias("gone"))
    found = asked.select("asked").distinct().join(found, "asked", "left")
    return found.select("asked", F.when(F.coalesce("n", F.lit(0)) == 0, "not_found").when(F.col("n") > 1, "ambiguous").when(F.col("gone"), "already").otherwise("retracted").alias("outcome"))


def accepted_effects(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """(candidate_id, effect) of accepting proposals (candidate_id): what each would do, by its kind and state."""
    rows = asked.select("candidate_id").distinct().join(candidates.select("candidate_id", "kind", "level", "status"), "candidate_id", "left")
    effect = (
        F.when(F.col("status").isNull(), "not_found")
        .when(F.col("status") == "accepted", "already_accepted")
        .when(F.col("status") == "stale", "refused_stale")
        .when(F.col("level") == "group", "collection")
        .when(F.col("kind") == "same_document", "merged")
        .otherwise("relation")
    )
    return rows.select("candidate_id", effect.alias("effect"))


def rejected_proposals(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """(candidate_id, outcome, status) of rejecting: an accepted proposal cannot be rejected, a second rejection changes nothing."""
    rows = asked.select("candidate_id").distinct().join(candidates.select("candidate_id", "status"), "candidate_id", "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "accepted", "refused").when(F.col("status") == "rejected", "unchanged").otherwise("rejected")
    return rows.select("candidate_id", outcome.alias("outcome"), F.when(outcome == "rejected", "rejected").otherwise(F.col("status")).alias("status"))


def proposal_order(candidates: DataFrame, rank) -> DataFrame:
    """Proposals with their place in the list: surest first, then kind and id; places are dealt within a (confidence, kind)."""
    by = Window.partitionBy("confidence", "kind").orderBy("candidate_id")
    return candidates.select("candidate_id", "confidence", "kind", rank(F.col("confidence")).alias("rank"), F.row_number().over(by).alias("place"))
