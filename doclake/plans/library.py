"""Organisation, merges and decisions on relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.operators import merge, organise, relate, views
from doclake.plans.corpus_sql import CHAIN, sql
from doclake.plans.views import ALL
from doclake.sources.corpus import Catalog


def _query(make):
    return lambda spark, sf_dir: make(Catalog(spark, sf_dir))


def _survivors(c: Catalog) -> DataFrame:
    return relate.merged_survivors(c.document).select("document_id", "survivor")


def collections_added(c: Catalog) -> DataFrame:
    """Texts by number into the English collection: some are members, some merged away, some no documents."""
    asked = c.document.filter("no % 5 < 3").select(F.lit("col-en").alias("collection_id"), F.when(F.col("no") % 50 == 1, F.concat("document_id", F.lit("x"))).otherwise(F.col("document_id")).alias("document_id"))
    return organise.added(c.collection_member, asked, c.live, ["collection_id", "document_id"])


def tags_given(c: Catalog) -> DataFrame:
    return organise.tagged(c.document_tag, c.document.filter("no % 4 = 1"), ["GOOD   text", "To Read", "to read"], c.live)


def tags_taken(c: Catalog) -> DataFrame:
    return organise.removed(c.document_tag, c.document.filter("no % 3 = 0").select("document_id", F.lit("good text").alias("tag_key")), ["document_id", "tag_key"])


def group_collections(c: Catalog) -> DataFrame:
    groups = c.relation_candidate.filter("level = 'group'").select(F.when(F.col("status") == "proposed", "Texts in en").otherwise(F.concat(F.lit("Set "), "candidate_id")).alias("name"), "members")
    return organise.group_collections(groups, c.collection, c.collection_member, c.live)


def scope_documents(c: Catalog) -> DataFrame:
    scopes = ("all", "view:inbox", "view:untagged", "collection:Texts in fr", "tag:Toxic")
    return views.union([organise.in_scope(c, s).select(F.lit(s).alias("scope"), "document_id") for s in scopes])


def survivor_choice(c: Catalog) -> DataFrame:
    pairs = c.relation_candidate.filter("kind = 'same_document'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return merge.preferred(pairs, c.metadata_value, c.document)


def document_splits(c: Catalog) -> DataFrame:
    taken = c.document_artifact.filter("no % 20 = 8").select("artifact_id", F.when(F.col("no") % 60 == 8, F.concat(F.lit("doc-"), (F.col("no") + 3).cast("string"))).alias("former"))
    return merge.split(c.document_artifact, c.document, taken)


def canonical_choices(c: Catalog) -> DataFrame:
    wanted = c.document_artifact.filter("NOT canonical AND no % 20 = 8").select("document_id", "artifact_id")
    foreign = c.document_artifact.filter("no % 20 = 18").select(F.lit("doc-0").alias("document_id"), "artifact_id")
    return merge.chosen_canonical(c.document_artifact, wanted.unionByName(foreign))


def relation_retractions(c: Catalog) -> DataFrame:
    named = c.document_relation.withColumn("relation_id", F.concat(F.md5(F.col("relation_id").cast("binary")), F.lit("-"), "relation_id"))
    asked = named.select(F.substring("relation_id", 1, 12).alias("asked")).union(named.select(F.concat(F.substring("relation_id", 1, 10), F.lit("zz")).alias("asked")))
    return merge.retracted(named, asked.union(c.spark.createDataFrame([("",), ("0",)], "asked string")))


def _asked(c: Catalog) -> DataFrame:
    known = c.relation_candidate.filter(F.substring("candidate_id", -1, 1) != "7").select("candidate_id")
    return known.union(c.document.filter("no % 100 = 0").select(F.concat(F.lit("none-"), "document_id").alias("candidate_id")))


QUERIES = {
    "collections_added": _query(collections_added),
    "tags_given": _query(tags_given),
    "tags_taken": _query(tags_taken),
    "group_collections": _query(group_collections),
    "proposals_naming": _query(lambda c: organise.proposals_naming(c.relation_candidate, c.live)),
    "scope_documents": _query(scope_documents),
    "survivor_choice": _query(survivor_choice),
    "merged_artifacts": _query(lambda c: merge.merged_artifacts(c.document_artifact, _survivors(c))),
    "merged_tags": _query(lambda c: merge.merged_members(c.document_tag, _survivors(c), ["tag_key"])),
    "merged_collections": _query(lambda c: merge.merged_members(c.collection_member, _survivors(c), ["collection_id"])),
    "merged_values": _query(lambda c: merge.merged_values(c.metadata_value, _survivors(c))),
    "merged_proposals": _query(lambda c: merge.merged_proposals(c.relation_candidate, _survivors(c)).withColumn("members", F.array_join("members", "|"))),
    "document_splits": _query(document_splits),
    "canonical_choices": _query(canonical_choices),
    "relation_retractions": _query(relation_retractions),
    "proposal_effects": _query(lambda c: merge.accepted_effects(c.relation_candidate, _asked(c))),
    "proposal_rejections": _query(lambda c: merge.rejected_proposals(c.relation_candidate, _asked(c))),
    "proposal_order": _query(lambda c: merge.proposal_order(c.relation_candidate, views.confidence_rank)),
}

_SURVIVORS = "sv AS (SELECT document_id, arg_max(survivor, depth) AS survivor FROM chain GROUP BY document_id)"
_ASKED = """asked AS (SELECT candidate_id FROM relation_candidate WHERE right(candidate_id, 1) <> '7' UNION SELECT 'none-' || document_id FROM document WHERE no % 100 = 0)"""
ORACLES = {
    "collections_added": sql(
        """SELECT 'col-en' AS collection_id, d AS document_id, CASE WHEN d NOT IN (SELECT document_id FROM live) THEN 'refused'
             WHEN d IN (SELECT document_id FROM collection_member WHERE collection_id = 'col-en') THEN 'held' ELSE 'added' END AS outcome
           FROM (SELECT document_id || CASE WHEN no % 50 = 1 THEN 'x' ELSE '' END AS d FROM document WHERE no % 5 < 3)"""
    ),
    "tags_given": sql(
        """SELECT document_id, tag_key, tag FROM document_tag UNION ALL
           SELECT document_id, t.k, t.v FROM document, (VALUES ('good text', 'GOOD text'), ('to read', 'To Read')) t(k, v)
           WHERE no % 4 = 1 AND document_id IN (SELECT document_id FROM live) AND (document_id, t.k) NOT IN (SELECT (document_id, tag_key) FROM document_tag)"""
    ),
    "tags_taken": sql("SELECT document_tag.* FROM document_tag JOIN document USING (document_id) WHERE NOT (no % 3 = 0 AND tag_key = 'good text')"),
    "group_collections": sql(
        """SELECT name_key, collection_id, document_id, CASE WHEN document_id NOT IN (SELECT document_id FROM live) THEN 'skipped_retired'
             WHEN (collection_id, document_id) IN (SELECT (collection_id, document_id) FROM collection_member) THEN 'held' ELSE 'added' END AS outcome
           FROM (SELECT DISTINCT name_key, CASE WHEN name_key = 'texts in en' THEN 'col-en' ELSE 'col-' || left(md5(name_key), 12) END AS collection_id, document_id FROM (
             SELECT CASE WHEN status = 'proposed' THEN 'texts in en' ELSE 'set ' || candidate_id END AS name_key, unnest(members) AS document_id FROM relation_candidate WHERE level = 'group'))"""
    ),
    "proposals_naming": sql("SELECT DISTINCT document_id, candidate_id FROM (SELECT candidate_id, unnest(members) AS document_id FROM relation_candidate WHERE level = 'group') JOIN live USING (document_id)"),
    "scope_documents": sql(
        """SELECT 'all' AS scope, document_id FROM live UNION ALL SELECT 'view:inbox', document_id FROM inbox JOIN live USING (document_id)
           UNION ALL SELECT 'view:inbox', document_id FROM inbox WHERE document_id NOT IN (SELECT document_id FROM live) UNION ALL SELECT 'view:untagged', document_id FROM untagged
           UNION ALL SELECT 'collection:Texts in fr', document_id FROM collection_member JOIN live USING (document_id) WHERE collection_id = 'col-fr'
           UNION ALL SELECT 'tag:Toxic', document_id FROM document_tag JOIN live USING (document_id) WHERE tag_key = 'toxic'""",
        *ALL,
    ),
    "survivor_choice": sql(
        """SELECT a, b, arg_min(d, {'n': -n, 'no': no, 'd': d}) AS survivor FROM (
             SELECT source_id AS a, target_id AS b, unnest([source_id, target_id]) AS d FROM relation_candidate WHERE kind = 'same_document' AND target_id IN (SELECT document_id FROM document))
           JOIN (SELECT document_id AS d, no, coalesce((SELECT count(*) FROM metadata_value v WHERE v.document_id = document.document_id), 0) AS n FROM document) USING (d) GROUP BY a, b"""
    ),
    "merged_artifacts": sql(
        """SELECT coalesce(survivor, document_id) AS document_id, artifact_id, CASE WHEN survivor IS NULL THEN 'primary' ELSE 'alternate_copy' END AS role, canonical AND survivor IS NULL AS canonical
           FROM document_artifact LEFT JOIN sv USING (document_id)""",
        CHAIN,
        _SURVIVORS,
    ),
    "merged_tags": sql("SELECT DISTINCT coalesce(survivor, document_id) AS document_id, tag_key FROM document_tag LEFT JOIN sv USING (document_id)", CHAIN, _SURVIVORS),
    "merged_collections": sql("SELECT DISTINCT coalesce(survivor, document_id) AS document_id, collection_id FROM collection_member LEFT JOIN sv USING (document_id)", CHAIN, _SURVIVORS),
    "merged_values": sql(
        """SELECT d AS document_id, field, b.value AS value, b.c AS carried FROM (
             SELECT coalesce(survivor, document_id) AS d, field, arg_min({'value': value, 'c': survivor IS NOT NULL}, {'c': survivor IS NOT NULL, 'n': no, 'v': value}) AS b
             FROM metadata_value LEFT JOIN sv USING (document_id) GROUP BY 1, 2)""",
        CHAIN,
        _SURVIVORS,
    ),
    "merged_proposals": sql(
        """SELECT candidate_id, kind, source_id, target_id, array_to_string(members, '|') AS members, status FROM relation_candidate WHERE status <> 'proposed'
           UNION ALL SELECT candidate_id, kind, source_id, target_id, array_to_string(m, '|'), status FROM (
             SELECT candidate_id, list_sort(list(DISTINCT coalesce(survivor, d))) AS m FROM (SELECT candidate_id, unnest(members) AS d FROM relation_candidate WHERE status = 'proposed' AND level = 'group')
             LEFT JOIN sv ON document_id = d GROUP BY 1) JOIN relation_candidate USING (candidate_id)
           UNION ALL SELECT candidate_id, kind, CASE WHEN x = y THEN source_id ELSE x END, CASE WHEN x = y THEN target_id ELSE y END, array_to_string(members, '|'),
             CASE WHEN x = y THEN 'accepted' WHEN touched AND row_number() OVER (PARTITION BY kind, x, y ORDER BY touched, candidate_id) > 1 THEN 'stale' ELSE status END FROM (
               SELECT *, x <> source_id OR y <> target_id AS touched FROM (
                 SELECT *, CASE WHEN kind IN ('same_document', 'related_to', 'equivalent_to') THEN least(s, t) ELSE s END AS x, CASE WHEN kind IN ('same_document', 'related_to', 'equivalent_to') THEN greatest(s, t) ELSE t END AS y
                 FROM (SELECT r.*, coalesce(a.survivor, source_id) AS s, coalesce(b.survivor, target_id) AS t FROM relation_candidate r LEFT JOIN sv a ON a.document_id = source_id
                       LEFT JOIN sv b ON b.document_id = target_id WHERE status = 'proposed' AND level <> 'group')))""",
        CHAIN,
        _SURVIVORS,
    ),
    "document_splits": sql(
        """SELECT artifact_id, CASE WHEN goes AND dead THEN 'revived' WHEN goes THEN 'created' WHEN asked THEN 'refused' ELSE 'kept' END AS outcome,
             CASE WHEN goes AND dead THEN former WHEN goes THEN 'doc-' || left(artifact_id, 12) ELSE document_id END AS document_id,
             goes OR canonical OR (bool_or(goes AND canonical) OVER (PARTITION BY document_id) AND row_number() OVER (PARTITION BY document_id, goes ORDER BY canonical DESC, artifact_id) = 1) AS canonical
           FROM (SELECT *, asked AND n > 1 AND (n > k OR p > 1) AS goes, asked AND coalesce(former IN (SELECT document_id FROM document WHERE retired), false) AS dead FROM (
             SELECT *, count(*) OVER (PARTITION BY document_id) AS n, count(*) FILTER (asked) OVER (PARTITION BY document_id) AS k, row_number() OVER (PARTITION BY document_id, asked ORDER BY canonical DESC, artifact_id) AS p
             FROM (SELECT *, no % 20 = 8 AS asked, CASE WHEN no % 60 = 8 THEN 'doc-' || (no + 3) END AS former FROM document_artifact)))"""
    ),
    "canonical_choices": sql(
        """SELECT document_id, artifact_id, CASE WHEN chosen IS NULL THEN canonical ELSE artifact_id = chosen END AS canonical FROM document_artifact
           LEFT JOIN (SELECT document_id, min(artifact_id) AS chosen FROM document_artifact WHERE NOT canonical AND no % 20 = 8 GROUP BY 1) USING (document_id)"""
    ),
    "relation_retractions": sql(
        """SELECT asked, CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN gone THEN 'already' ELSE 'retracted' END AS outcome FROM (
             SELECT asked, count(id) AS n, bool_or(retracted) AS gone FROM a LEFT JOIN named ON left(id, length(asked)) = asked AND length(asked) >= 8 GROUP BY asked)""",
        "named AS (SELECT md5(relation_id) || '-' || relation_id AS id, retracted FROM document_relation)",
        "a AS (SELECT left(id, 12) AS asked FROM named UNION SELECT left(id, 10) || 'zz' FROM named UNION SELECT unnest(['', '0']))",
    ),
    "proposal_effects": sql(
        """SELECT candidate_id, CASE WHEN status IS NULL THEN 'not_found' WHEN status = 'accepted' THEN 'already_accepted' WHEN status = 'stale' THEN 'refused_stale' WHEN level = 'group' THEN 'collection'
             WHEN kind = 'same_document' THEN 'merged' ELSE 'relation' END AS effect FROM asked LEFT JOIN relation_candidate USING (candidate_id)""",
        _ASKED,
    ),
    "proposal_rejections": sql(
        """SELECT candidate_id, CASE WHEN status IS NULL THEN 'not_found' WHEN status = 'accepted' THEN 'refused' WHEN status = 'rejected' THEN 'unchanged' ELSE 'rejected' END AS outcome,
             CASE WHEN status IS NULL OR status IN ('accepted', 'rejected') THEN status ELSE 'rejected' END AS status FROM asked LEFT JOIN relation_candidate USING (candidate_id)""",
        _ASKED,
    ),
    "proposal_order": sql(
        """SELECT candidate_id, confidence, kind, (list_position(['exact', 'high', 'medium', 'low', 'ambiguous'], confidence) - 1)::INTEGER AS rank,
             row_number() OVER (PARTITION BY confidence, kind ORDER BY candidate_id) AS place FROM relation_candidate"""
    ),
}
