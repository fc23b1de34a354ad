"""Renaming plans, scans, extraction records and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.functions import naming
from doclake.operators import filters, journal, lifecycle, organizer, scans, views
from doclake.plans.catalog import _SNAP, _snapshots
from doclake.plans.corpus_sql import sql
from doclake.plans.journal import _TABLES as JOURNAL
from doclake.plans.journal import _journal
from doclake.plans.views import ORACLES as VIEW_SQL
from doclake.sources.corpus import Catalog

ROOT_KEYS = ("/lib/a", "/lib/b/c", "/data")


def _query(make):
    return lambda spark, sf_dir: make(Catalog(spark, sf_dir))


def wanted(c: Catalog) -> DataFrame:
    """Destinations by number: renamed, moved, both, as it is, onto a neighbour's path, unusable or without a title."""
    rows = c.location.filter("NOT ended AND state = 'active'").join(c.document_artifact.select("artifact_id", "document_id"), "artifact_id")
    old, i = F.col("relative_path"), F.col("seq")
    folder, name = F.regexp_replace(old, "[^/]*$", ""), F.substring_index(old, "/", -1)
    neighbour = F.concat(folder, F.lit("doc_"), (i + 6).cast("string"), F.lit("."), F.substring_index(old, ".", -1))
    new = (
        F.when(i % 7 == 0, F.concat(folder, F.lit("New "), name)).when(i % 7 == 1, F.concat(F.lit("2001/"), name)).when(i % 7 == 2, F.concat(F.lit("2002/N "), name))
        .when(i % 7 == 3, old).when(i % 7 == 4, neighbour).when(i % 7 == 5, F.concat(folder, F.lit("con."), i.cast("string")))
    )
    return rows.select("location_id", "root_id", "artifact_id", "document_id", old.alias("old_path"), new.alias("new_path"), (i % 4 == 1).alias("sure"))


def plan_items(c: Catalog) -> DataFrame:
    return organizer.plan_items(wanted(c), c.location)


def plan_staleness(c: Catalog) -> DataFrame:
    """The plan against a catalog in which some titles, paths and documents have changed since."""
    title = c.metadata_value.filter("field = 'title'").select("document_id", F.when(F.col("no") % 9 == 1, F.lit("Another")).otherwise(F.col("value")).alias("title"))
    items = plan_items(c).filter("status = 'planned'").join(title, "document_id", "left")
    items = items.withColumn("old_path", F.when(F.length("old_path") % 5 == 0, F.concat(F.lit("gone/"), "old_path")).otherwise(F.col("old_path")))
    standing = items.select("item_id", F.regexp_replace("item_id", "^i-", "").alias("location_id_after")).filter(F.substring("item_id", -1, 1).isin("1", "2", "3"))
    standing = standing.withColumn("location_id_after", F.when(F.substring("item_id", -1, 1) == "3", F.lit("loc-none")).otherwise(F.col("location_id_after")))
    return organizer.staleness(items, c.location, c.metadata_value, c.document, standing)


def registered_plans(c: Catalog) -> DataFrame:
    digest = organizer.plan_hash(plan_items(c)).select("digest")
    plans = c.spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 0), ("p4", 1)], "plan_id string, policy int").crossJoin(digest)  # one row on the right
    registry = plans.filter("plan_id <> 'p4'").select("plan_id", F.when(F.col("plan_id") == "p2", F.lit("other")).otherwise(F.col("digest")).alias("digest"))
    return organizer.registered(plans.select("plan_id", "digest", "policy"), registry)


def plan_roots(c: Catalog) -> DataFrame:
    root = c.root.withColumn("root_key", F.concat(F.lit("/lib/"), "root_id"))
    planned = root.select("root_id", F.when(F.substring("root_id", -1, 1) == "9", F.lit("/elsewhere")).otherwise(F.col("root_key")).alias("root_key"))
    planned = planned.union(c.spark.createDataFrame([("nowhere", "/lib/nowhere")], "root_id string, root_key string"))
    return organizer.root_problems(planned, root)


def relocations(c: Catalog) -> DataFrame:
    return organizer.relocated(c.location, plan_items(c).filter("status = 'planned'"), 1)


def recovery(c: Catalog) -> DataFrame:
    """Journal items by what lies at source, destination and temporary name: the file, another or nothing."""

    def seen(n):
        return F.when(n % 3 == 0, F.col("artifact_id")).when(n % 3 == 1, F.lit("other"))

    rows = c.location.select("location_id", "artifact_id", F.col("seq"))
    rows = rows.select(
        F.col("location_id").alias("item_id"), F.when(F.col("seq") % 8 == 0, "planned").otherwise("moving").alias("state"), seen(F.col("seq")).alias("source"), seen(F.floor(F.col("seq") / 3)).alias("destination"),
        F.when(F.floor(F.col("seq") / 9) % 2 == 0, F.col("artifact_id")).alias("temp"), F.col("artifact_id").alias("expected"),
    )
    return organizer.recovered(rows)


def undo(c: Catalog) -> DataFrame:
    _, items = _journal(c)
    return organizer.undo_items(items.withColumn("old_path", F.concat(F.lit("old/"), "item_id")))


def scan_gated(c: Catalog) -> DataFrame:
    probes = c.root.select("root_id", "status")
    unreadable = c.root.filter(F.substring("root_id", -1, 1) == "1").select("root_id", F.lit("d").alias("directory"))
    return scans.gated(lifecycle.reconcile(*_snapshots(c)), probes, unreadable).select("root_id", "path_key", "result")


def scan_events(c: Catalog) -> DataFrame:
    return scans.transitions(lifecycle.reconcile(*_snapshots(c)), "run-x")


def root_additions(c: Catalog) -> DataFrame:
    roots = c.spark.createDataFrame([(k,) for k in ROOT_KEYS], "root_key string")
    paths = c.root.select(F.concat(F.lit("/lib/a/"), "root_id").alias("path")).union(c.root.select(F.concat(F.lit("/other/"), "root_id").alias("path")))
    paths = paths.union(c.spark.createDataFrame([("/lib/a",), ("/lib/b",), ("/lib",), ("/lib/ab",), ("/cat",), ("/catalog",)], "path string"))
    return scans.overlapping_roots(roots, paths, "/cat/kept/catalog.db")


def record_storage(c: Catalog) -> DataFrame:
    before = c.artifact.select("artifact_id", "size", F.lit(1).alias("modified"), "no")
    after = before.select("artifact_id", "size", F.when(F.col("no") % 6 == 2, 2).otherwise(1).alias("modified"))
    return scans.stored_records(c.extraction, c.artifact, before, after.join(c.artifact.filter("no % 14 <> 3").select("artifact_id"), "artifact_id", "left_semi"))


def evidence_lines(c: Catalog) -> DataFrame:
    rows = c.metadata_candidate.filter("k = 2").select("candidate_id", F.concat(F.lit('{"zone":"front","page":'), F.col("no").cast("string"), F.lit(',"empty":"","excerpt":" a  b'), F.when(F.col("no") % 5 == 0, F.repeat(F.lit("x"), 400)).otherwise(""), F.lit('","verdict":null}')).alias("evidence"))
    return scans.evidence_lines(rows)


def relation_upsert(c: Catalog) -> DataFrame:
    """A second detector run over stored relation proposals."""
    rows = c.relation_candidate.select("kind", "source_id", "target_id", F.lit("e").alias("evidence_key"), "confidence", "status", F.regexp_replace("candidate_id", "^rc-", "").cast("long").alias("no"))
    found = rows.filter("no % 5 <> 2").withColumns({"status": F.lit("proposed"), "confidence": F.when(F.col("no") % 7 == 1, F.lit("exact")).otherwise(F.col("confidence"))})
    return lifecycle.upsert(rows.filter("no % 4 <> 1"), found, ["kind", "source_id", "target_id", "evidence_key"], ["confidence"], ("proposed",))


def parent_titles(c: Catalog) -> DataFrame:
    """Printed parents' DOIs with the title a provider's record gives them."""
    parents = c.metadata_candidate.filter("field = 'doi'").select(F.col("value").alias("doi")).distinct()
    works = c.titled.filter("no % 3 = 0 AND title <> ''").groupBy(F.concat(F.lit("10.5555/doc."), (F.col("no") % 150).cast("string")).alias("doi")).agg(F.min_by("title", "no").alias("title"))
    return parents.join(works, "doi", "left").select("doi", F.coalesce(F.concat(F.lit("Parts of "), "title"), F.concat(F.lit("Documents printing "), "doi")).alias("name"))


def _stats_revision(c: Catalog) -> DataFrame:
    return views.union([scans.revision(relation_upsert(c), 7), scans.revision(relation_upsert(c).filter("outcome IN ('unchanged', 'decided')"), 7)])


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    return scans.newest(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "place")


def relocation_events(c: Catalog) -> DataFrame:
    moves = plan_items(c).filter("status = 'planned'")
    return organizer.events(moves, moves.withColumn("location_id", F.concat("location_id", F.lit("@1"))))


QUERIES = {
    "relocation_events": _query(relocation_events),
    "plan_items": _query(plan_items),
    "plan_summary": _query(lambda c: organizer.plan_summary(plan_items(c))),
    "plan_staleness": _query(plan_staleness),
    "plan_registered": _query(registered_plans),
    "plan_roots": _query(plan_roots),
    "plan_destinations": _query(lambda c: organizer.destination_verdicts(plan_items(c), c.location)),
    "relocations": _query(relocations),
    "recovery_outcomes": _query(recovery),
    "undo_items": _query(undo),
    "scan_gated": _query(scan_gated),
    "scan_events": _query(scan_events),
    "scan_closed_runs": _query(lambda c: scans.closed_runs(c.run)),
    "scan_stale_runs": _query(lambda c: scans.stale_runs(c.run)),
    "scan_last_runs": _query(lambda c: scans.last_runs(c.run)),
    "root_additions": _query(root_additions),
    "page_spans": _query(lambda c: scans.page_spans(c.page)),
    "page_count_mismatches": _query(lambda c: scans.page_count_mismatches(c.extraction, c.page)),
    "extraction_records": _query(lambda c: scans.records(c.page)),
    "record_storage": _query(record_storage),
    "most_common_kinds": _query(lambda c: scans.most_common(c.location.select(naming.extension_kind(F.col("relative_path")).alias("kind")), "kind")),
    "newest_events": _newest,
    "search_caveats": _query(lambda c: scans.caveats(filters.coverage(c.artifact, c.extraction, c.page))),
    "health_report": _query(lambda c: scans.health_lines(views.stats(c))),
    "evidence_lines": _query(evidence_lines),
    "relation_upsert": _query(relation_upsert),
    "parent_titles": _query(parent_titles),
    "catalog_revision": _query(_stats_revision),
    "json_records": _query(lambda c: scans.envelope(c.live.select("document_id", "no"), "document")),
    "applied_moves": _query(lambda c: journal.standing_moves(*_journal(c)).groupBy("plan_id").agg(F.count(F.lit(1)).alias("standing"))),
}

_FOLDER, _NAME = "regexp_replace({}, '[^/]*$', '')", "split_part({}, '/', -1)"
_ITEMS = (
    f"""w AS (SELECT location_id, root_id, l.artifact_id, document_id, relative_path AS old_path, seq % 4 = 1 AS sure, CASE seq % 7
           WHEN 0 THEN {_FOLDER.format("relative_path")} || 'New ' || {_NAME.format("relative_path")} WHEN 1 THEN '2001/' || {_NAME.format("relative_path")} WHEN 2 THEN '2002/N ' || {_NAME.format("relative_path")}
           WHEN 3 THEN relative_path WHEN 4 THEN {_FOLDER.format("relative_path")} || 'doc_' || (seq + 6) || '.' || split_part(relative_path, '.', -1) WHEN 5 THEN {_FOLDER.format("relative_path")} || 'con.' || seq END AS new_path
         FROM location l JOIN document_artifact USING (artifact_id) WHERE NOT ended AND state = 'active')""",
    f"""o AS (SELECT *, coalesce(new_path, old_path) AS np, CASE WHEN new_path IS NULL OR new_path = old_path THEN 'unchanged' WHEN {_FOLDER.format("old_path")} = {_FOLDER.format("new_path")} THEN 'rename'
           WHEN {_NAME.format("old_path")} = {_NAME.format("new_path")} THEN 'move' ELSE 'rename+move' END AS operation FROM w)""",
    """b AS (SELECT *, CASE WHEN operation = 'unchanged' THEN NULL WHEN regexp_matches(np, '(^|/)con\\.[0-9]+$') THEN 'name:reserved_name'
           WHEN (root_id, lower(np)) IN (SELECT (root_id, path_key) FROM location WHERE NOT ended) AND (root_id, lower(np)) NOT IN (SELECT (root_id, lower(old_path)) FROM o WHERE operation <> 'unchanged')
             AND lower(np) <> lower(old_path) THEN 'occupied' END AS blocked FROM o)""",
    """items AS (SELECT 'i-' || location_id AS item_id, root_id, location_id, artifact_id, document_id, old_path, np AS new_path, operation,
           CASE WHEN operation = 'unchanged' THEN 'unchanged' WHEN blocked IS NOT NULL THEN 'blocked' ELSE 'planned' END AS status,
           CASE operation WHEN 'unchanged' THEN 'low' WHEN 'rename' THEN CASE WHEN sure THEN 'low' ELSE 'medium' END ELSE CASE WHEN sure THEN 'medium' ELSE 'high' END END AS risk, blocked FROM b)""",
)
_UPSERT = """rc AS (SELECT kind, source_id, target_id, 'e' AS evidence_key, confidence, status, substr(candidate_id, 4)::BIGINT AS no FROM relation_candidate),
up AS (SELECT kind, source_id, target_id, evidence_key, CASE WHEN had IS NULL THEN 'new' WHEN has IS NULL THEN CASE WHEN os = 'proposed' THEN 'stale' ELSE 'kept' END WHEN os IN ('accepted', 'rejected') THEN 'decided'
    WHEN os = 'proposed' AND oc = nc THEN 'unchanged' WHEN os = 'stale' THEN 'revived' ELSE 'updated' END AS outcome,
    CASE WHEN had IS NULL THEN 'proposed' WHEN has IS NULL THEN CASE WHEN os = 'proposed' THEN 'stale' ELSE os END WHEN os IN ('accepted', 'rejected') THEN os ELSE 'proposed' END AS status
  FROM (SELECT kind, source_id, target_id, evidence_key, confidence AS oc, status AS os, true AS had FROM rc WHERE no % 4 <> 1)
  FULL JOIN (SELECT kind, source_id, target_id, evidence_key, CASE WHEN no % 7 = 1 THEN 'exact' ELSE confidence END AS nc, true AS has FROM rc WHERE no % 5 <> 2) USING (kind, source_id, target_id, evidence_key))"""
ORACLES = {
    "relocation_events": sql(
        """SELECT location_id, 'moved_to' AS event, new_path AS detail FROM items WHERE status = 'planned' UNION ALL SELECT location_id || '@1', 'moved_from', old_path FROM items WHERE status = 'planned'""", *_ITEMS
    ),
    "plan_items": sql("SELECT * FROM items", *_ITEMS),
    "plan_summary": sql(
        """SELECT 'operation' AS aspect, operation AS name, count(*) AS items FROM items GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM items GROUP BY 2
           UNION ALL SELECT 'risk', risk, count(*) FROM items GROUP BY 2""",
        *_ITEMS,
    ),
    "plan_staleness": sql(
        """SELECT item_id, CASE WHEN here AND title IS DISTINCT FROM title_now THEN 'stale_values' WHEN here AND retired THEN 'stale_merged' WHEN here THEN 'pending'
             WHEN right(item_id, 1) IN ('1', '2') AND stands THEN 'already_applied' WHEN right(item_id, 1) IN ('1', '2', '3') THEN 'stale_moved_again' ELSE 'stale_file' END AS state
           FROM (SELECT i.item_id, i.location_id IN (SELECT location_id FROM location WHERE NOT ended AND state = 'active') AS stands, v.value AS title_now, CASE WHEN v.value IS NULL THEN NULL WHEN v.no % 9 = 1 THEN 'Another' ELSE v.value END AS title,
                   d.retired, coalesce(l.artifact_id = i.artifact_id AND l.state = 'active', false) AS here
                 FROM items i LEFT JOIN (SELECT * FROM metadata_value WHERE field = 'title') v USING (document_id) JOIN document d USING (document_id)
                 LEFT JOIN (SELECT * FROM location WHERE NOT ended) l ON l.root_id = i.root_id AND l.relative_path = CASE WHEN length(old_path) % 5 = 0 THEN 'gone/' ELSE '' END || old_path WHERE i.status = 'planned')""",
        *_ITEMS,
    ),
    "plan_registered": "SELECT * FROM (VALUES ('p1', 'ok'), ('p2', 'altered'), ('p3', 'stale_policy'), ('p4', 'unknown')) t(plan_id, state)",
    "plan_roots": sql(
        """SELECT root_id, CASE WHEN root_id LIKE '%9' THEN 'another_folder' WHEN NOT allow_organize THEN 'not_allowed' WHEN status <> 'online' THEN 'offline' END AS problem FROM root
           UNION ALL SELECT 'nowhere', 'gone'"""
    ),
    "plan_destinations": sql(
        """SELECT item_id, NOT EXISTS (SELECT 1 FROM location l WHERE NOT l.ended AND l.root_id = i.root_id AND l.path_key = lower(i.new_path) AND l.location_id <> i.location_id) AS free FROM items i""", *_ITEMS
    ),
    "relocations": sql(
        """SELECT location_id, root_id, relative_path, artifact_id, ended OR m AS ended, CASE WHEN m THEN 'moved' ELSE end_reason END AS end_reason, CASE WHEN m THEN location_id || '@1' ELSE successor_location_id END AS successor_location_id
           FROM (SELECT *, location_id IN (SELECT location_id FROM items WHERE status = 'planned') AS m FROM location)
           UNION ALL SELECT location_id || '@1', root_id, new_path, artifact_id, false, NULL, NULL FROM items WHERE status = 'planned'""",
        *_ITEMS,
    ),
    "recovery_outcomes": sql(
        """SELECT location_id AS item_id, CASE WHEN seq % 8 = 0 THEN 'not_started' WHEN d = 0 AND s = 2 AND NOT t THEN 'succeeded' WHEN s = 0 AND NOT t AND d <> 0 THEN 'never_moved'
             WHEN t AND s = 2 AND d <> 0 THEN 'restore' ELSE 'uncertain' END AS outcome
           FROM (SELECT location_id, seq, seq % 3 AS s, (seq // 3) % 3 AS d, (seq // 9) % 2 = 0 AS t FROM location)"""
    ),
    "undo_items": sql("SELECT operation_id, row_id, root_id, new_path AS from_path, 'old/' || item_id AS to_path, -row_id AS \"order\" FROM items WHERE state = 'succeeded'", *JOURNAL),
    "scan_gated": sql(
        """SELECT rec.root_id, path_key, CASE WHEN status <> 'online' THEN 'root_unavailable' WHEN result = 'missing' AND rec.root_id LIKE '%1' AND starts_with(path_key, 'd/') THEN 'inaccessible' ELSE result END AS result
           FROM rec JOIN root USING (root_id)""",
        _SNAP,
    ),
    "scan_events": sql(
        """SELECT 'run-x' AS run_id, root_id, path_key, result AS event, coalesce(artifact_id, old_artifact) AS artifact_id FROM rec
           WHERE result IN ('new_location', 'new_artifact', 'replaced', 'reappeared', 'missing', 'inaccessible', 'touched')""",
        _SNAP,
    ),
    "scan_closed_runs": sql("SELECT run_id, root_id, started, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status FROM run"),
    "scan_stale_runs": sql("SELECT run_id, root_id, started FROM run r WHERE status = 'running' AND started < (SELECT max(started) FROM run x WHERE x.root_id = r.root_id)"),
    "scan_last_runs": sql(
        """SELECT root_id, r.i AS run_id, r.s AS status, r.t AS started FROM (
             SELECT root_id, arg_max({'i': run_id, 's': status, 't': started}, {'t': started, 'i': run_id}) AS r FROM run GROUP BY root_id
             UNION ALL SELECT NULL, arg_max({'i': run_id, 's': status, 't': started}, {'t': started, 'i': run_id}) FROM run)"""
    ),
    "root_additions": sql(
        """SELECT path, CASE WHEN path = '/cat' THEN 'contains_catalog' WHEN path IN ('/lib/a', '/lib/b/c', '/data') THEN 'exists'
             WHEN list_bool_or(list_transform(['/lib/a', '/lib/b/c', '/data'], lambda h: starts_with(path, h || '/') OR starts_with(h, path || '/'))) THEN 'overlaps' ELSE 'added' END AS outcome
           FROM (SELECT '/lib/a/' || root_id AS path FROM root UNION SELECT '/other/' || root_id FROM root UNION SELECT unnest(['/lib/a', '/lib/b', '/lib', '/lib/ab', '/cat', '/catalog']))"""
    ),
    "page_spans": sql("SELECT artifact_id, min(pdf_page)::INTEGER AS first_page, max(pdf_page)::INTEGER AS last_page, count(*) AS pages FROM page GROUP BY artifact_id"),
    "page_count_mismatches": sql("SELECT artifact_id, page_count, page_count - 1 AS pages FROM extraction WHERE no % 47 = 8"),
    "extraction_records": sql(
        r"""SELECT artifact_id, sum(length(text))::BIGINT AS chars, count(*) AS page_count, sum(length(text)) < 100 * count(*) AS scanned,
              nullif(rtrim(regexp_extract(string_agg(text, chr(10) ORDER BY pdf_page) FILTER (pdf_page <= 2), '(?i)\b(10\.[0-9]{4,9}/[^\s"<>]+)', 1), '.,;:)]}''”’'), '') AS first_doi,
              nullif(left(max(text) FILTER (pdf_page = 1), 600), '') AS first_text FROM page GROUP BY artifact_id"""
    ),
    "record_storage": sql(
        """SELECT artifact_id, CASE WHEN no % 6 = 2 OR no % 14 = 3 THEN 'changed' WHEN artifact_id IN (SELECT artifact_id FROM extraction) THEN 'replaced' ELSE 'added' END AS outcome FROM artifact"""
    ),
    "most_common_kinds": sql(
        """SELECT value, n, row_number() OVER (ORDER BY n DESC, value)::INTEGER AS place FROM (SELECT CASE lower(split_part(relative_path, '.', -1)) WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' WHEN 'csv' THEN 'text'
             WHEN 'docx' THEN 'word_document' ELSE 'other' END AS value, count(*) AS n FROM location GROUP BY 1)"""
    ),
    "newest_events": "SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS place FROM events) WHERE place <= 25",
    "search_caveats": sql(
        """SELECT caveat, n::BIGINT AS n FROM (SELECT count(*) FILTER (p AND status <> 'failed') AS s, unnest(['not_yet_extracted', 'no_text_layer', 'partially_indexed', 'extraction_failed']) AS caveat,
             unnest([count(*) FILTER (p AND status IS NULL), count(*) FILTER (p AND status <> 'failed' AND artifact_id NOT IN (SELECT artifact_id FROM page WHERE chars > 0)),
                     count(*) FILTER (p AND status = 'partial'), count(*) FILTER (p AND status = 'failed')]) AS n
           FROM (SELECT artifact_id, content_kind = 'pdf' AS p, status FROM artifact LEFT JOIN extraction USING (artifact_id))) WHERE n > 0 AND s > 0"""
    ),
    "health_report": "SELECT (list_position(['locations_missing', 'locations_inaccessible', 'roots_not_online', 'extension_content_mismatches', 'exact_duplicate_groups'], metric) - 1)::INTEGER AS place, value || ' ' || "
    "CASE metric WHEN 'locations_missing' THEN 'paths whose file is missing' WHEN 'locations_inaccessible' THEN 'paths that cannot be read' WHEN 'roots_not_online' THEN 'roots out of reach' "
    "WHEN 'extension_content_mismatches' THEN 'files whose name and contents disagree' ELSE 'files at more than one path' END AS line FROM ("
    + VIEW_SQL["library_stats"]
    + ") WHERE section = 'health' AND value > 0 AND metric IN ('locations_missing', 'locations_inaccessible', 'roots_not_online', 'extension_content_mismatches', 'exact_duplicate_groups')",
    "evidence_lines": sql(
        """SELECT candidate_id, 1 AS place, 'excerpt' AS name, CASE WHEN no % 5 = 0 THEN 'a b' || repeat('x', 296) || '…' ELSE 'a b' END AS value FROM metadata_candidate WHERE k = 2
           UNION ALL SELECT candidate_id, 2, 'page', no::VARCHAR FROM metadata_candidate WHERE k = 2 UNION ALL SELECT candidate_id, 3, 'zone', 'front' FROM metadata_candidate WHERE k = 2"""
    ),
    "relation_upsert": sql("SELECT * FROM up", _UPSERT),
    "parent_titles": sql(
        """SELECT doi, coalesce('Parts of ' || title, 'Documents printing ' || doi) AS name FROM (SELECT DISTINCT value AS doi FROM metadata_candidate WHERE field = 'doi')
           LEFT JOIN (SELECT '10.5555/doc.' || no % 150 AS doi, arg_min(title, no) AS title FROM titled WHERE no % 3 = 0 AND title <> '' GROUP BY 1) USING (doi)"""
    ),
    "catalog_revision": "SELECT unnest([8, 7])::BIGINT AS revision",
    "json_records": sql("""SELECT '{"type":"document","document_id":"' || document_id || '","no":' || no || '}' AS record FROM live"""),
    "applied_moves": sql(
        """SELECT plan_id, count(*) AS standing FROM (SELECT DISTINCT plan_id, item_id FROM items JOIN operations USING (operation_id) WHERE kind = 'apply' AND state = 'succeeded') GROUP BY 1""", *JOURNAL
    ),
}
