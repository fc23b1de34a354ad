"""Views, reports and integrity checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.operators import filters, views
from doclake.plans.corpus_sql import WALK, key, sql
from doclake.sources.corpus import Catalog

AVAILABLE = """available AS (
  SELECT DISTINCT document_id FROM document_artifact JOIN location l USING (artifact_id) JOIN root r USING (root_id)
  WHERE NOT l.ended AND l.state = 'active' AND r.status = 'online')"""
STATES = """states AS (
  SELECT da.document_id, CASE
    WHEN da.document_id IN (SELECT document_id FROM metadata_value WHERE field = 'title') THEN 'accepted'
    WHEN e.artifact_id IS NULL THEN 'not_extracted'
    WHEN da.document_id IN (SELECT document_id FROM metadata_candidate WHERE field = 'title' AND status = 'proposed') THEN 'candidates_awaiting_review'
    WHEN e.chars = 0 THEN 'no_text_layer' ELSE 'no_title_found' END AS state
  FROM document_artifact da JOIN artifact a USING (artifact_id) LEFT JOIN extraction e USING (artifact_id)
  WHERE canonical AND content_kind = 'pdf')"""
UNRESOLVED = "unresolved AS (SELECT document_id, state AS reason FROM states WHERE state <> 'accepted')"
AMBIGUOUS = """ambiguous AS (
  SELECT document_id, arg_min(detail, r) AS detail FROM (
    SELECT document_id, 'a proposal the evidence does not decide' AS detail, 0 AS r FROM metadata_candidate
    WHERE status = 'proposed' AND (classification = 'ambiguous' OR confidence = 'ambiguous')
    UNION ALL
    SELECT document_id, 'a relation the evidence does not decide', 1 FROM live JOIN relation_candidate ON document_id IN (source_id, target_id)
    WHERE status = 'proposed' AND level <> 'group' AND confidence IN ('low', 'ambiguous')) GROUP BY document_id)"""
MISSING = "missing AS (SELECT document_id FROM live WHERE document_id NOT IN (SELECT document_id FROM available))"
COPIES = """copies AS (
  SELECT artifact_id, count(*) AS copies, string_agg(label || ':' || relative_path, '|' ORDER BY path_key) AS paths
  FROM location JOIN root USING (root_id) WHERE NOT ended AND state = 'active' GROUP BY artifact_id HAVING count(*) > 1)"""
DUPLICATES = """duplicates AS (
  SELECT document_id, arg_min(detail, r) AS detail FROM (
    SELECT document_id, 'the same file at ' || arg_max(copies, artifact_id) || ' paths' AS detail, 0 AS r FROM copies JOIN document_artifact USING (artifact_id) GROUP BY 1
    UNION ALL
    SELECT unnest([source_id, target_id]), 'may be the same document as another', 1 FROM relation_candidate WHERE status = 'proposed' AND kind = 'same_document')
  GROUP BY document_id)"""
NEW = """new AS (
  SELECT document_id FROM live WHERE document_id NOT IN (SELECT document_id FROM metadata_candidate UNION SELECT document_id FROM metadata_value))"""
UNTAGGED = "untagged AS (SELECT document_id FROM live WHERE document_id NOT IN (SELECT document_id FROM document_tag))"
UNCOLLECTED = """uncollected AS (
  SELECT document_id FROM live WHERE document_id NOT IN (
    SELECT document_id FROM collection_member JOIN collection USING (collection_id) WHERE NOT retired))"""
INBOX = """inbox AS (
  SELECT document_id, arg_min(reason, r) AS reason, min(r) AS rank FROM (
    SELECT document_id, 'unresolved' AS reason, 0 AS r FROM unresolved UNION ALL SELECT document_id, 'ambiguous', 1 FROM ambiguous
    UNION ALL SELECT document_id, 'missing', 2 FROM missing UNION ALL SELECT document_id, 'new', 3 FROM new) GROUP BY document_id)"""
ALL = (AVAILABLE, STATES, UNRESOLVED, AMBIGUOUS, MISSING, COPIES, DUPLICATES, NEW, UNTAGGED, UNCOLLECTED, INBOX)
RELATED = """related AS (
  SELECT source_id AS document_id, kind, 'out' AS direction, target_id AS other_id, relation_id FROM document_relation WHERE NOT retracted
  UNION ALL SELECT target_id, kind, 'in', source_id, relation_id FROM document_relation WHERE NOT retracted)"""
AGREES = f"CASE WHEN field IN ('title', 'container', 'publisher') THEN {key('value')} ELSE value END"
LATEST = """latest AS (
  SELECT artifact_id, arg_min(relative_path, {'e': ended, 's': -last_seen, 'p': path_key}) AS relative_path FROM location GROUP BY artifact_id)"""
MAIN = "main AS (SELECT document_id, arg_min(artifact_id, {'c': NOT canonical, 'a': artifact_id}) AS artifact_id FROM document_artifact GROUP BY document_id)"


def _view(name: str):
    return lambda spark, sf_dir: views.VIEWS[name](Catalog(spark, sf_dir))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with each row's 0-based place in the default order."""
    return views.placed(views.listing(Catalog(spark, sf_dir)), ["reason_rank", "sort_title", "document_id"])


def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each kind of filter leaves."""
    c = Catalog(spark, sf_dir)
    scopes = {
        "tag": (("tag", "Good Text"),),
        "collection": (("collection", "texts in fr"),),
        "doi": (("doi", "https://doi.org/10.5555/DOC.7"),),
        "year": (("year", "2005-"),),
        "author": (("author", "team de"),),
        "kind": (("kind", "Book"),),
        "conjunction": (("year", "-2010"), ("kind", "pdf"), ("collection", "texts in en")),
    }
    counted = [filters.filtered(c, f).agg(F.count(F.lit(1)).alias("documents")).select(F.lit(n).alias("filter"), "documents") for n, f in scopes.items()]
    return views.union(counted)


def list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live documents whose title or authors hold every typed word."""
    c = Catalog(spark, sf_dir)
    rows = c.live.select("document_id").join(views.pivoted(c.metadata_value, ("title", "authors")), "document_id")
    hay = F.concat_ws(" ", "title", "authors")
    return rows.filter(filters.all_words(hay, F.lit("The FAM1 of"))).select("document_id", "title")


def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a database would enforce and that occur twice: none, or a finding."""
    c = Catalog(spark, sf_dir)
    return views.duplicate_key_report(
        {"location": (c.location, ["root_id", "path_key"]), "current_artifact": (c.location.filter("NOT ended"), ["artifact_id"]), "artifact": (c.artifact, ["artifact_id"]), "document": (c.document, ["document_id"]), "metadata_value": (c.metadata_value, ["document_id", "field"])}
    )


def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document id, file name, path and artifact id resolved as a reference."""
    c = Catalog(spark, sf_dir)
    names = [c.document.select(F.col("document_id").alias("name")), c.location.select(F.col("relative_path").alias("name"))]
    names += [c.location.select(F.substring_index("relative_path", "/", -1).alias("name")), c.artifact.select(F.col("artifact_id").alias("name"))]
    names += [c.artifact.select(F.substring("artifact_id", 1, n).alias("name")) for n in (7, 12, 30)]
    names += [c.location.select(F.substring_index("relative_path", "/", -2).alias("name"))]
    return views.resolve_names(c, views.union(names).distinct())


QUERIES = {f"view_{name}": _view(name) for name in views.VIEWS} | {
    "title_states": lambda s, d: views.title_states(Catalog(s, d)),
    "exact_copies": lambda s, d: views.exact_copies(Catalog(s, d)),
    "document_listing": listing,
    "sidebar_counts": lambda s, d: views.sidebar(Catalog(s, d)),
    "review_queue": lambda s, d: views.review_queue(Catalog(s, d)),
    "agreement_states": lambda s, d: views.agreement_states(Catalog(s, d)),
    "metadata_report": lambda s, d: views.metadata_report(Catalog(s, d)),
    "locate_artifacts": lambda s, d: views.locate(Catalog(s, d)),
    "library_stats": lambda s, d: views.stats(Catalog(s, d)),
    "tag_list": lambda s, d: views.tag_list(Catalog(s, d)),
    "collection_sizes": lambda s, d: views.collection_sizes(Catalog(s, d)),
    "explain_documents": lambda s, d: views.explain(Catalog(s, d)),
    "related_documents": lambda s, d: views.related(Catalog(s, d)),
    "doctor_findings": lambda s, d: views.doctor(Catalog(s, d)),
    "timing_statistics": lambda s, d: views.timing(s.read.parquet(f"{d}/events.parquet"), F.col("event_type"), F.col("value"), F.col("event_id"), F.length("props")),
    "scope_counts": scope_counts,
    "list_filter": list_filter,
    "key_uniqueness": key_uniqueness,
    "resolve_references": resolve,
}

_DOCTOR = f"""
SELECT 'catalog' AS category, 'error' AS severity, 'no_canonical' AS code, document_id AS subject FROM live
WHERE document_id NOT IN (SELECT document_id FROM document_artifact WHERE canonical)
UNION ALL SELECT 'catalog', 'error', 'artifact_without_document', artifact_id FROM artifact WHERE artifact_id NOT IN (SELECT artifact_id FROM document_artifact)
UNION ALL SELECT 'catalog', 'error', 'move_without_successor', location_id FROM location WHERE ended AND end_reason = 'moved' AND successor_location_id IS NULL
UNION ALL SELECT 'filesystem', 'warning', 'root_not_online', root_id FROM root WHERE status <> 'online'
UNION ALL SELECT 'filesystem', 'info', 'never_scanned', root_id FROM root WHERE never_scanned
UNION ALL SELECT 'filesystem', 'warning', state || '_locations', root_id || ':' || count(*) FROM location
          WHERE NOT ended AND state <> 'active' GROUP BY root_id, state
UNION ALL SELECT 'extraction', 'info', 'not_extracted', n::VARCHAR FROM (SELECT count(*) AS n FROM pdf WHERE artifact_id NOT IN (SELECT artifact_id FROM extraction)) WHERE n > 0
UNION ALL SELECT 'extraction', 'warning', 'orphan_extraction', n::VARCHAR FROM (SELECT count(*) AS n FROM extraction WHERE artifact_id NOT IN (SELECT artifact_id FROM pdf)) WHERE n > 0
UNION ALL SELECT 'extraction', 'warning', 'stale_extraction', n::VARCHAR FROM (SELECT count(*) AS n FROM ext WHERE source <> 'imported' AND profile_id <> 'current') WHERE n > 0
UNION ALL SELECT 'extraction', 'warning', 'partial_extraction', n::VARCHAR FROM (SELECT count(*) AS n FROM ext WHERE status = 'partial') WHERE n > 0
UNION ALL SELECT 'extraction', 'warning', 'failed_extraction', n::VARCHAR FROM (SELECT count(*) AS n FROM ext WHERE status = 'failed') WHERE n > 0
UNION ALL SELECT 'extraction', 'info', 'provisional_import', n::VARCHAR FROM (SELECT count(*) AS n FROM ext WHERE source = 'imported') WHERE n > 0
UNION ALL SELECT 'metadata', 'error', 'value_not_canonical', document_id || ':' || field FROM metadata_value
          WHERE field = 'title' AND trim(regexp_replace(regexp_replace(value, '<[^>]{{1,200}}>', '', 'g'), '[\\s ]+', ' ', 'g')) <> value
UNION ALL SELECT 'metadata', 'warning', 'doi_collision', value || ':' || count(*) FROM metadata_value WHERE field = 'doi' GROUP BY value HAVING count(*) > 1
UNION ALL SELECT 'metadata', 'error', 'value_without_source', document_id || ':' || field FROM metadata_value
          WHERE source_candidate_id IS NOT NULL AND source_candidate_id NOT IN (SELECT candidate_id FROM metadata_candidate)
UNION ALL SELECT 'relationships', 'error', 'retired_without_survivor', r.document_id FROM document r LEFT JOIN document t ON t.document_id = r.merged_into
          WHERE r.retired AND t.document_id IS NULL
UNION ALL SELECT 'relationships', 'warning', 'merge_chain', r.document_id FROM document r JOIN document t ON t.document_id = r.merged_into WHERE r.retired AND t.retired
UNION ALL SELECT 'relationships', 'error', 'retired_holds_artifacts', document_id FROM document WHERE retired AND document_id IN (SELECT document_id FROM document_artifact)
UNION ALL SELECT DISTINCT 'relationships', 'warning', 'relation_to_retired', relation_id FROM document_relation JOIN document ON document_id IN (source_id, target_id)
          WHERE NOT retracted AND retired
UNION ALL SELECT 'catalog', 'warning', 'stale_run', run_id FROM run r WHERE status = 'running' AND started < (SELECT max(started) FROM run x WHERE x.root_id = r.root_id)
UNION ALL SELECT 'metadata', 'error', 'proposal_from_wrong_artifact', candidate_id FROM candidate_source WHERE (document_id, artifact_id) NOT IN (SELECT (document_id, artifact_id) FROM document_artifact)
UNION ALL SELECT 'relationships', 'error', 'relation_cycle', 'supplement_of:' || start FROM walk WHERE start = node
UNION ALL SELECT 'extraction', 'error', 'page_count_mismatch', artifact_id FROM extraction WHERE no % 47 = 8
"""

_STATS = """
SELECT 'inventory' AS section, 'roots' AS metric, count(*)::BIGINT AS value FROM root
UNION ALL SELECT 'inventory', 'documents', count(*) FROM live
UNION ALL SELECT 'inventory', 'documents_merged_away', count(*) FROM document WHERE retired
UNION ALL SELECT 'inventory', 'artifacts', count(*) FROM artifact
UNION ALL SELECT 'inventory', 'locations_current', count(*) FROM location WHERE NOT ended
UNION ALL SELECT 'inventory', 'locations_ended', count(*) FROM location WHERE ended
UNION ALL SELECT 'inventory', 'total_bytes', coalesce(sum(size), 0)::BIGINT FROM artifact
UNION ALL SELECT 'locations_by_state', state, count(*) FROM location WHERE NOT ended GROUP BY state
UNION ALL SELECT 'by_extension_kind', kind, count(*) FROM kinds GROUP BY kind
UNION ALL SELECT 'by_content_kind', content_kind, count(*) FROM kinds GROUP BY content_kind
UNION ALL SELECT 'locations_by_root', root_id, count(*) FROM location WHERE NOT ended GROUP BY root_id
UNION ALL SELECT 'health', 'locations_missing', count(*) FROM location WHERE NOT ended AND state = 'missing'
UNION ALL SELECT 'health', 'locations_inaccessible', count(*) FROM location WHERE NOT ended AND state = 'inaccessible'
UNION ALL SELECT 'health', 'roots_not_online', count(*) FROM root WHERE status <> 'online'
UNION ALL SELECT 'health', 'exact_duplicate_groups', count(*) FROM dup
UNION ALL SELECT 'health', 'exact_duplicate_files', coalesce(sum(n), 0)::BIGINT FROM dup
UNION ALL SELECT 'health', 'exact_duplicate_bytes_reclaimable', coalesce(sum((n - 1) * size), 0)::BIGINT FROM dup
UNION ALL SELECT 'health', 'extension_content_mismatches', count(*) FROM kinds WHERE CASE kind WHEN 'pdf' THEN content_kind <> 'pdf' WHEN 'text' THEN content_kind <> 'text'
  WHEN 'word_document' THEN content_kind NOT IN ('zip_container', 'ole_container', 'word_document', 'text') ELSE false END
UNION ALL SELECT 'organization', 'collections', count(*) FROM collection WHERE NOT retired
UNION ALL SELECT 'organization', 'tags', count(DISTINCT tag_key) FROM document_tag
UNION ALL SELECT 'organization', 'document_relations', count(*) FROM document_relation WHERE NOT retracted
UNION ALL SELECT 'organization', 'relation_proposals_waiting', count(*) FROM relation_candidate WHERE status = 'proposed'
UNION ALL SELECT 'organization', 'documents_with_several_artifacts', count(*) FROM (
  SELECT document_id FROM document_artifact JOIN live USING (document_id) GROUP BY document_id HAVING count(*) > 1)
"""

ORACLES = {f"view_{name}": sql(f"SELECT * FROM {name}", *ALL) for name in views.VIEWS} | {
    "title_states": sql("SELECT * FROM states", STATES),
    "exact_copies": sql("SELECT copies.*, document_id FROM copies LEFT JOIN document_artifact USING (artifact_id)", COPIES),
    "document_listing": sql(
        """SELECT *, row_number() OVER (ORDER BY reason_rank, sort_title, document_id) - 1 AS place FROM (
             SELECT document_id, coalesce(t.value, relative_path, left(document_id, 12)) AS display, y.value AS year, o.value AS doi,
                    document_id IN (SELECT document_id FROM available) AS available, coalesce(reason, '') AS reason, coalesce(rank, 4) AS reason_rank,
                    lower(coalesce(t.value, relative_path, left(document_id, 12))) AS sort_title
             FROM live LEFT JOIN main USING (document_id) LEFT JOIN latest USING (artifact_id) LEFT JOIN inbox USING (document_id)
             LEFT JOIN (SELECT * FROM metadata_value WHERE field = 'title') t USING (document_id)
             LEFT JOIN (SELECT * FROM metadata_value WHERE field = 'year') y USING (document_id)
             LEFT JOIN (SELECT * FROM metadata_value WHERE field = 'doi') o USING (document_id))""",
        *ALL,
        LATEST,
        MAIN,
    ),
    "sidebar_counts": sql(
        "SELECT kind, name, count(*) AS documents FROM ("
        + " UNION ALL ".join(f"SELECT 'view' AS kind, '{n}' AS name, document_id FROM {n}" for n in views.VIEWS)
        + """ UNION ALL SELECT 'tag', tag_key, document_id FROM document_tag JOIN live USING (document_id)
              UNION ALL SELECT 'collection', name, document_id FROM collection_member JOIN collection USING (collection_id) JOIN live USING (document_id) WHERE NOT retired
              UNION ALL SELECT 'all', 'all', document_id FROM live) GROUP BY kind, name""",
        *ALL,
    ),
    "review_queue": sql(
        f"""SELECT document_id, field, value, best.confidence, best.classification, sources, priority, candidates, review, accepted AS differs_from FROM (
             SELECT q.*, v.value AS accepted, v.k AS ak FROM (
               SELECT document_id, field, value, {AGREES} AS k,
                      arg_min({{'confidence': confidence, 'classification': classification}},
                              {{'c': list_position(['exact', 'high', 'medium', 'low', 'ambiguous'], confidence), 'p': priority, 'i': candidate_id}}) AS best,
                      string_agg(DISTINCT source, '|' ORDER BY source) AS sources, min(priority) AS priority, count(*) AS candidates,
                      CASE WHEN bool_or(review = 'safe') THEN 'safe' ELSE 'required' END AS review
               FROM metadata_candidate WHERE status = 'proposed' GROUP BY document_id, field, value) q
             LEFT JOIN (SELECT document_id, field, value, {AGREES} AS k FROM metadata_value) v USING (document_id, field))
           WHERE ak IS NULL OR ak <> k"""
    ),
    "agreement_states": sql(
        f"""SELECT document_id, field, CASE
              WHEN bool_or(held IS NOT NULL) IS NOT TRUE THEN CASE WHEN bool_or(status = 'proposed') THEN 'unresolved' ELSE 'unknown' END
              WHEN bool_or(status = 'proposed' AND k <> held) THEN 'discrepancy'
              WHEN bool_or(status IN ('proposed', 'accepted') AND k = held AND s <> source) THEN 'agreement' ELSE 'uncorroborated' END AS state
           FROM (SELECT document_id, field, {AGREES} AS k, source AS s, status FROM metadata_candidate) c
           FULL JOIN (SELECT document_id, field, {AGREES} AS held, source FROM metadata_value) v USING (document_id, field) GROUP BY document_id, field"""
    ),
    "metadata_report": sql(
        """SELECT field, coalesce(documents, 0) AS documents, coalesce(proposals, 0) AS proposals, coalesce(safe, 0)::BIGINT AS safe,
             round(coalesce(documents, 0) / (SELECT count(*) FROM live), 4) AS share
           FROM (SELECT field, count(DISTINCT document_id) AS documents FROM metadata_value JOIN live USING (document_id) GROUP BY field)
           FULL JOIN (SELECT field, count(*) AS proposals, sum(safe) AS safe FROM (
             SELECT document_id, field, value, max((review = 'safe')::INTEGER) AS safe FROM metadata_candidate WHERE status = 'proposed' GROUP BY 1, 2, 3)
             GROUP BY field) USING (field)"""
    ),
    "locate_artifacts": sql(
        """SELECT artifact_id, CASE WHEN here THEN 'available' WHEN offline THEN 'root_offline' WHEN n > 0 THEN 'missing' ELSE 'unlocated' END AS state, coalesce(n, 0) AS locations
           FROM artifact LEFT JOIN (
             SELECT artifact_id, bool_or(l.state = 'active' AND r.status = 'online') AS here, bool_or(l.state = 'active' AND r.status <> 'online') AS offline, count(*) AS n
             FROM location l JOIN root r USING (root_id) WHERE NOT ended GROUP BY artifact_id) USING (artifact_id)"""
    ),
    "library_stats": sql(
        _STATS,
        """kinds AS (SELECT CASE lower(split_part(relative_path, '.', -1)) WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' WHEN 'csv' THEN 'text'
             WHEN 'docx' THEN 'word_document' ELSE 'other' END AS kind, content_kind FROM location JOIN artifact USING (artifact_id) WHERE NOT ended)""",
        "dup AS (SELECT artifact_id, a.size, count(*) AS n FROM location l JOIN artifact a USING (artifact_id) WHERE NOT ended AND state = 'active' GROUP BY 1, 2 HAVING count(*) > 1)",
    ),
    "tag_list": sql("SELECT tag_key, min(tag) AS tag, count(*) AS documents FROM document_tag JOIN live USING (document_id) GROUP BY tag_key"),
    "collection_sizes": sql(
        """SELECT collection_id, name, (SELECT count(*) FROM collection_member m JOIN live USING (document_id) WHERE m.collection_id = c.collection_id) AS members
           FROM collection c WHERE NOT retired"""
    ),
    "explain_documents": sql(
        """SELECT document_id,
             coalesce((SELECT string_agg(DISTINCT relative_path, '|' ORDER BY relative_path) FROM document_artifact a JOIN location USING (artifact_id) WHERE a.document_id = l.document_id), '') AS paths,
             coalesce((SELECT string_agg(field || '=' || value, '|' ORDER BY field || '=' || value) FROM metadata_value v WHERE v.document_id = l.document_id), '') AS fields,
             coalesce((SELECT string_agg(tag_key, '|' ORDER BY tag_key) FROM document_tag t WHERE t.document_id = l.document_id), '') AS tags,
             coalesce((SELECT string_agg(kind || ':' || direction || ':' || other_id, '|' ORDER BY kind || ':' || direction || ':' || other_id) FROM related r
                       WHERE r.document_id = l.document_id), '') AS relations
           FROM live l""",
        RELATED,
    ),
    "related_documents": sql("SELECT * FROM related", RELATED),
    "doctor_findings": sql(
        _DOCTOR, WALK.format(kind="supplement_of"), "pdf AS (SELECT artifact_id FROM artifact WHERE content_kind = 'pdf')", "ext AS (SELECT * FROM extraction WHERE artifact_id IN (SELECT artifact_id FROM pdf))"
    ),
    "timing_statistics": """
        SELECT event_type AS g, count(*) AS n, median(value) AS median, max(value) FILTER (WHERE i = n // 2) AS upper_median,
               max(value) FILTER (WHERE i = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95, max(value) AS longest,
               arg_max(event_id, {'v': value, 'e': event_id}) AS slowest, round(sum(length(props)) / 1e6::DOUBLE / sum(value), 6) AS mb_per_s
        FROM (SELECT event_type, event_id, props, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i
              FROM events WHERE value IS NOT NULL) GROUP BY event_type""",
    "scope_counts": sql(
        """SELECT 'tag' AS filter, count(*) AS documents FROM live WHERE document_id IN (SELECT document_id FROM document_tag WHERE tag_key = 'good text')
           UNION ALL SELECT 'collection', count(*) FROM live WHERE document_id IN (SELECT document_id FROM collection_member WHERE collection_id = 'col-fr')
           UNION ALL SELECT 'doi', count(*) FROM live WHERE document_id IN (SELECT document_id FROM metadata_value WHERE value = '10.5555/doc.7')
           UNION ALL SELECT 'year', count(*) FROM live WHERE document_id IN (SELECT document_id FROM metadata_value WHERE field = 'year' AND TRY_CAST(value AS INT) >= 2005)
           UNION ALL SELECT 'author', count(*) FROM live WHERE document_id IN (SELECT document_id FROM metadata_value WHERE field = 'authors' AND contains(value, 'Team de'))
           UNION ALL SELECT 'kind', count(*) FROM live WHERE document_id IN (SELECT document_id FROM metadata_value WHERE field = 'type' AND value = 'book')
           UNION ALL SELECT 'conjunction', count(*) FROM live WHERE document_id IN (SELECT document_id FROM metadata_value WHERE field = 'year' AND TRY_CAST(value AS INT) <= 2010)
             AND document_id IN (SELECT document_id FROM document_artifact JOIN artifact USING (artifact_id) WHERE content_kind = 'pdf')
             AND document_id IN (SELECT document_id FROM collection_member WHERE collection_id = 'col-en')"""
    ),
    "list_filter": sql(
        """SELECT document_id, t.value AS title FROM live LEFT JOIN (SELECT * FROM metadata_value WHERE field = 'title') t USING (document_id)
           LEFT JOIN (SELECT * FROM metadata_value WHERE field = 'authors') a USING (document_id)
           WHERE contains(lower(concat_ws(' ', t.value, a.value)), 'the') AND contains(lower(concat_ws(' ', t.value, a.value)), 'fam1')
             AND contains(lower(concat_ws(' ', t.value, a.value)), 'of')"""
    ),
    "key_uniqueness": sql(
        """SELECT 'location' AS "table", root_id || '|' || path_key AS key, count(*) AS count FROM location GROUP BY 2 HAVING count(*) > 1
           UNION ALL SELECT 'current_artifact', artifact_id, count(*) FROM location WHERE NOT ended GROUP BY 2 HAVING count(*) > 1
           UNION ALL SELECT 'document', document_id, count(*) FROM document GROUP BY 2 HAVING count(*) > 1"""
    ),
    "resolve_references": sql(
        """SELECT name, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN one END AS document_id
           FROM names LEFT JOIN (
             SELECT name, count(DISTINCT document_id) AS n, min(document_id) AS one FROM found WHERE kind = (SELECT min(kind) FROM found f WHERE f.name = found.name) GROUP BY name)
           USING (name)""",
        """names AS (SELECT DISTINCT unnest([document_id]) AS name FROM document UNION SELECT relative_path FROM location UNION SELECT split_part(relative_path, '/', -1) FROM location
             UNION SELECT artifact_id FROM artifact UNION SELECT left(artifact_id, 12) FROM artifact
             UNION SELECT left(artifact_id, 7) FROM artifact UNION SELECT left(artifact_id, 30) FROM artifact UNION SELECT split_part(relative_path, '/', -2) || '/' || split_part(relative_path, '/', -1) FROM location)""",
        "owned AS (SELECT document_id, artifact_id FROM document_artifact JOIN live USING (document_id))",
        """places AS (SELECT document_id, ended, list_aggregate(p[i:], 'string_agg', '/') AS key, i, len(p) AS n FROM (
             SELECT document_id, ended, string_split(relative_path, '/') AS p, unnest(range(1, len(string_split(relative_path, '/')) + 1)) AS i FROM owned JOIN location USING (artifact_id)))""",
        """found AS (
             SELECT name, document_id, 0 AS kind FROM names JOIN live ON name = document_id UNION SELECT name, document_id, 1 FROM names JOIN owned ON name = artifact_id
             UNION SELECT name, document_id, CASE WHEN i = 1 THEN 2 WHEN i < n THEN 3 ELSE 4 END + CASE WHEN ended THEN 3 ELSE 0 END FROM names JOIN places ON name = key
             UNION SELECT name, document_id, 8 FROM names JOIN owned ON length(name) BETWEEN 8 AND 63 AND starts_with(artifact_id, name))""",
    ),
}
