"""What callers read: pages, excerpts, cards, caches, lookups and lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions import labels
from doclake.functions.text import excerpt
from doclake.operators import lifecycle, match, organizer, search, specs, views
from doclake.plans.catalog import _SNAP, _snapshots
from doclake.plans.corpus_sql import key, sql
from doclake.plans.views import LATEST, MAIN, RELATED
from doclake.plans.views import ORACLES as VIEW_SQL
from doclake.sources import works
from doclake.sources.corpus import Catalog


def _query(make):
    return lambda spark, sf_dir: make(Catalog(spark, sf_dir))


def _no() -> Column:
    return F.col("no")


def pages_asked(c: Catalog) -> DataFrame:
    """Pages by position, by a printed label that two pages share, by both and by neither."""
    labelled = c.page.withColumn("printed_label", F.concat(F.lit("p"), (F.col("pdf_page") % 4).cast("string")))
    n = _no()
    wanted = c.artifact.select(
        "artifact_id", F.when(n % 4 < 2, (n % 5 + 1).cast("int")).alias("page"), F.when((n % 4 == 0) | (n % 4 == 2), F.concat(F.lit("p"), (n % 3).cast("string"))).alias("label")
    )
    return search.get_pages(labelled, wanted).withColumn("text", F.md5(F.col("text").cast("binary")))


def excerpts(c: Catalog) -> DataFrame:
    return c.page.filter("pdf_page = 1").select("page_id", excerpt(F.col("text"), F.lit("er"), 12).alias("excerpt")).filter("excerpt IS NOT NULL")


def _cache(c: Catalog) -> DataFrame:
    n = _no()
    return c.document.select(F.concat(F.lit("doi:"), (n % 50).cast("string")).alias("key"), n.alias("stored"), F.timestamp_seconds(n * 60).alias("expires_at"), F.concat(F.lit("answer "), n.cast("string")).alias("body"))


def _titles(c: Catalog) -> DataFrame:
    n = _no()
    source = F.when(n % 3 == 0, "pdf_info_title").when(n % 3 == 1, "layout_title").otherwise("pdf_xmp_title")
    return c.titled.filter("title <> ''").select(F.concat(F.lit("doc-"), F.floor(n / 4).cast("string")).alias("document_id"), "title", source.alias("source"))


def _works(c: Catalog) -> DataFrame:
    return c.titled.filter("no % 2 = 0 AND title <> ''").select(F.concat(F.lit("10.5555/w."), _no().cast("string")).alias("doi"), "title")


def lookups(c: Catalog) -> DataFrame:
    wanted = c.document.select("document_id", F.concat(F.lit("10.5555/w."), _no().cast("string")).alias("doi"))
    by_doi = works.lookup_dois(wanted, _works(c)).select("document_id", F.lit("doi").alias("by"), F.when(F.col("title").isNotNull(), F.col("doi")).alias("doi"))
    by_title = works.lookup_titles(c.titled.filter("title <> ''").select("document_id", F.upper("title").alias("title")), _works(c)).select("document_id", F.lit("title").alias("by"), "doi")
    return by_doi.unionByName(by_title)


def review_items(c: Catalog) -> DataFrame:
    """The review queue with the title and the path that a person knows a document by."""
    names = views.pivoted(c.metadata_value, ("title",)).join(views.main_artifact(c.document_artifact), "document_id", "right")
    names = names.join(views.latest_location(c.location), "artifact_id", "left")
    return views.review_queue(c).join(names, "document_id", "left").select("document_id", "field", "value", "confidence", "review", "title", F.col("relative_path").alias("path"))


def document_cards(c: Catalog) -> DataFrame:
    """One row a live document: where it is, how many fields, open proposals and relations it has."""
    here = views.locate(c).join(c.document_artifact.select("artifact_id", "document_id"), "artifact_id")
    here = here.groupBy("document_id").agg(F.bool_or(F.col("state") == "available").alias("available"), F.sum("locations").alias("locations"))
    fields = c.metadata_value.groupBy("document_id").agg(F.count(F.lit(1)).alias("fields"))
    open_ = c.metadata_candidate.filter("status = 'proposed'").groupBy("document_id").agg(F.count(F.lit(1)).alias("proposals"))
    related = views.related(c).groupBy("document_id").agg(F.count(F.lit(1)).alias("relations"))
    rows = c.live.select("document_id").join(here, "document_id", "left")
    for side in (fields, open_, related):
        rows = rows.join(side, "document_id", "left")
    return rows.select("document_id", F.coalesce("available", F.lit(False)).alias("available"), *[F.coalesce(n, F.lit(0)).alias(n) for n in ("locations", "fields", "proposals", "relations")])


def accepted_facts(c: Catalog) -> DataFrame:
    """Accepted values with the sentence that says how each came to be, beside how many open proposals differ."""
    sentence = labels.provenance_sentence(F.col("accepted_by"), F.col("source"), F.lit("observed"), F.col("locked"))
    held = c.metadata_value.select("document_id", "field", "value", labels.label(labels.FIELDS, F.col("field")).alias("label"), sentence.alias("sentence"))
    open_ = c.metadata_candidate.filter("status = 'proposed'").select("document_id", "field", F.col("value").alias("other"))
    rows = held.join(open_, ["document_id", "field"], "left")
    return rows.groupBy("document_id", "field", "label", "value", "sentence").agg(F.count_if(F.col("other").isNotNull() & (F.col("other") != F.col("value"))).alias("differing"))


def duplicate_items(c: Catalog, most: int = 100) -> DataFrame:
    """The first items of each level of the duplicates report; ``most`` of a level leave a map task."""
    copies = views.exact_copies(c).select(F.lit("exact_copies").alias("level"), F.col("artifact_id").alias("item"))
    pairs = c.relation_candidate.filter("kind = 'same_document' AND status = 'proposed'").select(F.lit("same_document").alias("level"), F.col("candidate_id").alias("item"))
    merged = c.document.filter("retired").select(F.lit("merged").alias("level"), F.col("document_id").alias("item"))
    rows = views.union([copies, pairs, merged]).withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy("item")))
    return rows.filter(F.col("place") <= most)


def mass_missing(c: Catalog) -> DataFrame:
    return lifecycle.mass_missing(lifecycle.reconcile(*_snapshots(c)), 3, 0.12)


def value_states(c: Catalog) -> DataFrame:
    """Four events a document: set, lock, a rule's set or a person's, unlock or clear."""
    n = _no()
    steps = F.array(*[F.struct(F.lit(i).alias("i"), a.alias("action"), w.alias("actor")) for i, a, w in (
        (0, F.lit("set"), F.when(n % 2 == 0, "user").otherwise("rule:safe")), (1, F.when(n % 3 == 0, "lock").otherwise("unlock"), F.lit("user")),
        (2, F.lit("set"), F.when(n % 5 == 0, "user").otherwise("rule:safe")), (3, F.when(n % 7 == 0, "clear").otherwise("lock"), F.lit("user")),
    )])
    rows = c.document.select("document_id", "no", F.explode(steps).alias("s"))
    return lifecycle.value_states(rows.select("document_id", F.lit("title").alias("field"), (n * 10 + F.col("s.i")).alias("seq"), "s.action", F.concat(F.lit("v"), F.col("s.i").cast("string")).alias("value"), "s.actor"))


def item_decisions(c: Catalog) -> DataFrame:
    items = c.metadata_candidate.filter("status = 'proposed' AND no % 4 < 2").select("document_id", "field", "value", (_no() % 4 == 0).alias("accept")).distinct()
    return lifecycle.item_decisions(c.metadata_candidate, items)


def front_actions(c: Catalog) -> DataFrame:
    n = _no()
    wanted = c.artifact.select("artifact_id", F.when(n % 5 != 3, F.lit("x")).alias("path"))
    cache = c.artifact.filter("no % 3 = 0").select("artifact_id", F.when(n % 2 == 0, "2").otherwise("1").alias("version"), (n % 4 != 0).alias("ok"))
    return specs.front_facts(wanted, cache, "2")


def root_permissions(c: Catalog) -> DataFrame:
    return organizer.organizable(c.root, c.root.filter("never_scanned").select("root_id", F.lit(True).alias("allow")))


QUERIES = {
    "value_states": _query(value_states),
    "item_decisions": _query(item_decisions),
    "resolver_targets": _query(specs.targets),
    "front_actions": _query(front_actions),
    "root_permissions": _query(root_permissions),
    "pages_asked": _query(pages_asked),
    "excerpts": _query(excerpts),
    "cache_latest": _query(lambda c: lifecycle.latest(_cache(c), "key", "stored")),
    "cache_unexpired": _query(lambda c: lifecycle.unexpired(_cache(c), "1970-01-01 05:00:00").select("key", "stored")),
    "cache_inserted": _query(lambda c: lifecycle.insert_ignore(_cache(c).filter("stored < 30").select("key"), _cache(c).filter("stored >= 30").select("key"), ["key"])),
    "best_titles": _query(lambda c: match.best_title(_titles(c), {"layout_title": 0, "pdf_xmp_title": 1, "pdf_info_title": 2})),
    "provider_lookups": _query(lookups),
    "review_items": _query(review_items),
    "document_cards": _query(document_cards),
    "accepted_facts": _query(accepted_facts),
    "duplicate_items": _query(duplicate_items),
    "scan_mass_missing": _query(mass_missing),
}

_QUEUE = "q AS (SELECT * FROM (" + VIEW_SQL["review_queue"] + "))"
_CACHE = "cache AS (SELECT 'doi:' || no % 50 AS key, no AS stored, make_timestamp(no * 60000000) AS expires_at, 'answer ' || no AS body FROM document)"
_WORKS = "works AS (SELECT '10.5555/w.' || no AS doi, title FROM titled WHERE no % 2 = 0 AND title <> '')"
ORACLES = {
    "value_states": sql(
        """SELECT document_id, 'title' AS field, CASE WHEN r2 AND no % 3 = 0 THEN 'v0' ELSE 'v2' END AS value, true AS locked, CASE WHEN r2 AND no % 3 = 0 THEN CASE WHEN no % 2 = 0 THEN 'user' ELSE 'rule:safe' END
             WHEN r2 THEN 'rule:safe' ELSE 'user' END AS accepted_by FROM (SELECT *, no % 5 <> 0 AS r2 FROM document) WHERE no % 7 <> 0"""
    ),
    "item_decisions": sql(
        """SELECT candidate_id, CASE WHEN no % 4 = 0 THEN 'accept' ELSE 'reject' END AS decision FROM (
             SELECT *, row_number() OVER (PARTITION BY document_id, field, value ORDER BY priority, candidate_id) AS place FROM metadata_candidate WHERE status = 'proposed' AND no % 4 < 2) WHERE place = 1 OR no % 4 = 1"""
    ),
    "resolver_targets": sql(
        """SELECT document_id, artifact_id, p.r AS root_id, p.l AS relative_path FROM document_artifact JOIN artifact USING (artifact_id) LEFT JOIN (
             SELECT artifact_id, arg_min({'r': root_id, 'l': relative_path}, {'s': -last_seen, 'p': path_key}) AS p FROM location JOIN root USING (root_id)
             WHERE NOT ended AND state = 'active' AND status = 'online' GROUP BY 1) USING (artifact_id) WHERE canonical AND content_kind = 'pdf'"""
    ),
    "front_actions": sql(
        """SELECT artifact_id, CASE WHEN no % 6 = 0 AND no % 4 <> 0 THEN 'cached' WHEN no % 6 = 0 THEN 'failed_before' WHEN no % 5 = 3 THEN 'unavailable' ELSE 'read' END AS action FROM artifact"""
    ),
    "root_permissions": sql("SELECT root_id, allow_organize OR never_scanned AS allow_organize, never_scanned AND NOT allow_organize AS changed, (allow_organize OR never_scanned) AND status = 'online' AS usable FROM root"),
    "pages_asked": sql(
        """SELECT artifact_id, page, label, CASE WHEN (page IS NULL) = (label IS NULL) THEN 'refused' WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS outcome, pdf_page::INTEGER AS pdf_page, md5(left(text, 20000)) AS text,
             coalesce(length(text) > 20000, false) AS is_cut
           FROM (SELECT w.*, p.pdf_page, p.text, count(p.pdf_page) OVER (PARTITION BY w.artifact_id) AS n FROM w
                 LEFT JOIN page p ON p.artifact_id = w.artifact_id AND (page IS NULL) <> (label IS NULL) AND (p.pdf_page = page OR 'p' || p.pdf_page % 4 = label))""",
        "w AS (SELECT artifact_id, CASE WHEN no % 4 < 2 THEN (no % 5 + 1)::INTEGER END AS page, CASE WHEN no % 4 IN (0, 2) THEN 'p' || no % 3 END AS label FROM artifact)",
    ),
    "excerpts": sql(
        r"""SELECT page_id, trim(regexp_replace(substr(text, lo, hit + 2 + 12 - lo), '\s+', ' ', 'g')) AS excerpt
            FROM (SELECT page_id, text, strpos(text, 'er') AS hit, greatest(1, strpos(text, 'er') - 12) AS lo FROM page WHERE pdf_page = 1) WHERE hit > 0"""
    ),
    "cache_latest": sql("SELECT key, arg_max(stored, stored) AS stored, arg_max(expires_at, stored) AS expires_at, arg_max(body, stored) AS body FROM cache GROUP BY key", _CACHE),
    "cache_unexpired": sql("SELECT key, stored FROM cache WHERE expires_at > TIMESTAMP '1970-01-01 05:00:00'", _CACHE),
    "cache_inserted": sql("SELECT key FROM cache WHERE stored < 30 UNION ALL SELECT DISTINCT key FROM cache WHERE stored >= 30 AND key NOT IN (SELECT key FROM cache WHERE stored < 30)", _CACHE),
    "best_titles": sql(
        """SELECT 'doc-' || no // 4 AS document_id, arg_min({'t': title, 's': s}, {'r': CASE s WHEN 'layout_title' THEN 0 WHEN 'pdf_xmp_title' THEN 1 ELSE 2 END, 't': title}).t AS title,
             arg_min(s, {'r': CASE s WHEN 'layout_title' THEN 0 WHEN 'pdf_xmp_title' THEN 1 ELSE 2 END, 't': title}) AS source
           FROM (SELECT *, CASE no % 3 WHEN 0 THEN 'pdf_info_title' WHEN 1 THEN 'layout_title' ELSE 'pdf_xmp_title' END AS s FROM titled WHERE title <> '') GROUP BY 1"""
    ),
    "provider_lookups": sql(
        f"""SELECT document_id, 'doi' AS "by", CASE WHEN '10.5555/w.' || no IN (SELECT doi FROM works) THEN '10.5555/w.' || no END AS doi FROM document
            UNION ALL SELECT document_id, 'title', doi FROM (SELECT document_id, {key("upper(title)")} AS k FROM titled WHERE title <> '') JOIN (SELECT doi, {key("title")} AS k FROM works) USING (k)""",
        _WORKS,
    ),
    "review_items": sql(
        "SELECT q.document_id, field, q.value, confidence, review, t.value AS title, relative_path AS path FROM q LEFT JOIN main USING (document_id) LEFT JOIN latest USING (artifact_id) "
        "LEFT JOIN (SELECT document_id, value FROM metadata_value WHERE field = 'title') t USING (document_id)",
        LATEST,
        MAIN,
        _QUEUE,
    ),
    "document_cards": sql(
        """SELECT document_id, coalesce((SELECT bool_or(l.state = 'active' AND r.status = 'online') FROM document_artifact a JOIN location l USING (artifact_id) JOIN root r USING (root_id) WHERE a.document_id = live.document_id AND NOT ended), false) AS available,
             (SELECT count(*) FROM document_artifact a JOIN location l USING (artifact_id) WHERE a.document_id = live.document_id AND NOT ended)::BIGINT AS locations,
             (SELECT count(*) FROM metadata_value v WHERE v.document_id = live.document_id) AS fields, (SELECT count(*) FROM metadata_candidate v WHERE v.document_id = live.document_id AND status = 'proposed') AS proposals,
             (SELECT count(*) FROM related v WHERE v.document_id = live.document_id) AS relations FROM live""",
        RELATED,
    ),
    "accepted_facts": sql(
        """SELECT document_id, field, CASE field WHEN 'title' THEN 'Title' WHEN 'year' THEN 'Year' WHEN 'doi' THEN 'DOI' WHEN 'type' THEN 'Type' WHEN 'container' THEN 'Journal / book' ELSE 'Authors' END AS label, value,
             'Accepted by ' || CASE WHEN accepted_by = 'user' THEN 'you' ELSE 'a batch rule' END || ', from ' || source || ' (read from the file).' || CASE WHEN locked THEN ' Locked: no resolver may change it.' ELSE '' END AS sentence,
             (SELECT count(*) FROM metadata_candidate c WHERE c.document_id = v.document_id AND c.field = v.field AND c.status = 'proposed' AND c.value <> v.value) AS differing FROM metadata_value v"""
    ),
    "duplicate_items": sql(
        """SELECT level, item, place FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY item)::INTEGER AS place FROM (
             SELECT 'exact_copies' AS level, artifact_id AS item FROM location JOIN root USING (root_id) WHERE NOT ended AND state = 'active' GROUP BY artifact_id HAVING count(*) > 1
             UNION ALL SELECT 'same_document', candidate_id FROM relation_candidate WHERE kind = 'same_document' AND status = 'proposed' UNION ALL SELECT 'merged', document_id FROM document WHERE retired)) WHERE place <= 100"""
    ),
    "scan_mass_missing": sql(
        """SELECT root_id, count(*) FILTER (result = 'missing') AS missing, count(*) AS known FROM rec WHERE old_artifact IS NOT NULL GROUP BY root_id
           HAVING count(*) FILTER (result = 'missing') >= 3 AND count(*) FILTER (result = 'missing') >= 0.12 * count(*)""",
        _SNAP,
    ),
}
