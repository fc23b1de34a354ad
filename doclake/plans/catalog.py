"""Evidence, lifecycle, reconciliation, naming and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.functions import identifiers, naming, text
from doclake.operators import evidence, lifecycle, relate, views
from doclake.plans.corpus_sql import CHAIN, WALK, key, sql
from doclake.plans.views import AGREES, MAIN
from doclake.sources.corpus import Catalog


def front_pages(c) -> DataFrame:
    """Three pages a document with printed DOIs: the data hold none."""
    n, no = F.col("no"), F.col("no").cast("string")
    one = F.concat(
        F.when(n % 2 == 0, "Received 1 May 2020\n").otherwise("Some title\n"), F.lit("https://doi.org/10.5555/own."), F.when(n % 11 == 0, "shared").otherwise(no),
        F.lit(".\nplain words\n"), F.when(n % 3 == 0, F.concat(F.lit("Correction to 10.5555/other."), (n % 7).cast("string"))).otherwise("more words"),
    )
    two = F.when(n % 5 == 0, F.concat(F.lit("as 10.5555/own."), no, F.lit(" says, and 10.5555/ref.1;"))).otherwise("nothing here")
    listed = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("10.5555/bib."), ((n + i) % 50).cast("string"))), "\n")
    three = F.concat(F.when(n % 4 == 0, "References\n").otherwise("A list\n"), listed)
    pages = F.array(F.struct(F.lit(1).alias("pdf_page"), one.alias("text")), F.struct(F.lit(2).alias("pdf_page"), two.alias("text")), F.struct(F.lit(3).alias("pdf_page"), three.alias("text")))
    return c.document.select("document_id", "no", F.explode(pages).alias("p")).select("document_id", "no", "p.pdf_page", "p.text")


def doi_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    claimed = c.document.filter("no % 6 = 1").select("document_id", F.concat(F.lit("doi:10.5555/META."), F.col("no").cast("string")).alias("doi"))
    return evidence.classify_dois(front_pages(c), claimed)


def doi_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.demote_shared(evidence.classify_dois(front_pages(Catalog(spark, sf_dir)))).filter("documents IS NOT NULL").select("document_id", "doi", "classification", "documents")


_PAGES = r"""fp AS (
  SELECT document_id, no, 1 AS pdf_page, CASE WHEN no % 2 = 0 THEN 'Received 1 May 2020' ELSE 'Some title' END || chr(10) || 'https://doi.org/10.5555/own.'
         || CASE WHEN no % 11 = 0 THEN 'shared' ELSE no::VARCHAR END || '.' || chr(10) || 'plain words' || chr(10)
         || CASE WHEN no % 3 = 0 THEN 'Correction to 10.5555/other.' || (no % 7) ELSE 'more words' END AS text FROM document
  UNION ALL SELECT document_id, no, 2, CASE WHEN no % 5 = 0 THEN 'as 10.5555/own.' || no || ' says, and 10.5555/ref.1;' ELSE 'nothing here' END FROM document
  UNION ALL SELECT document_id, no, 3, CASE WHEN no % 4 = 0 THEN 'References' ELSE 'A list' END || chr(10)
         || list_aggregate(list_transform(range(1, 8), lambda i: '10.5555/bib.' || ((no + i) % 50)), 'string_agg', chr(10)) FROM document)"""
_CLASSES = r"""ln AS (SELECT document_id, pdf_page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM fp),
lc AS (SELECT *, contains(text, 'Received') AS line_own, contains(text, 'Correction to') AS other FROM ln),
ln2 AS (SELECT *, line_own OR coalesce(lag(line_own) OVER w, false) OR coalesce(lead(line_own) OVER w, false) AS own FROM lc WINDOW w AS (PARTITION BY document_id, pdf_page ORDER BY line)),
pl AS (SELECT document_id, pdf_page, line, own, line_own, other, unnest(l) AS doi, generate_subscripts(l, 1) AS spot FROM (
  SELECT *, list_transform(regexp_extract_all(text, '10\.5555/[^\s]+'), lambda x: rtrim(x, '.,;')) AS l FROM ln2)),
bib AS (SELECT document_id FROM ln WHERE text = 'References'),
outs AS (SELECT pl.*, pl.doi NOT IN (SELECT unnest([]::VARCHAR[])) AS keep FROM pl WHERE own OR pdf_page < 3 OR document_id NOT IN (SELECT document_id FROM bib)),
dense AS (SELECT document_id, pdf_page FROM pl GROUP BY 1, 2 HAVING count(DISTINCT doi) >= 6),
ro AS (SELECT o.*, d.document_id IS NULL OR line_own AS real FROM outs o LEFT JOIN dense d USING (document_id, pdf_page)),
top AS (SELECT document_id, arg_min(doi, line * 1000 + spot) AS top, count(DISTINCT doi) AS front FROM ro WHERE pdf_page = 1 GROUP BY 1),
gr AS (SELECT document_id, doi, min(pdf_page) AS first_page, min(pdf_page) FILTER (WHERE real) AS first_real, count(DISTINCT pdf_page) FILTER (WHERE real) AS real_pages,
       bool_or(pdf_page <= 2 AND own) AS cue, bool_or(pdf_page <= 2 AND other) AS names_other FROM ro GROUP BY 1, 2),
sc AS (SELECT document_id, doi, first_page, CASE first_real WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END + CASE WHEN cue THEN 2 ELSE 0 END + CASE WHEN names_other THEN -3 ELSE 0 END
       + CASE WHEN real_pages >= 3 THEN 1 ELSE 0 END + CASE WHEN doi = top AND first_real = 1 THEN 1 ELSE 0 END
       + CASE WHEN first_page = 1 AND front >= 4 AND NOT cue THEN -2 ELSE 0 END + CASE WHEN first_real IS NULL THEN -3 ELSE 0 END AS score FROM gr LEFT JOIN top USING (document_id))"""


def _classified(scores: str) -> str:
    return f"""cl AS (SELECT document_id, doi, score::INTEGER AS score, CASE WHEN sure AND r = 1 THEN 'own' WHEN sure AND score < 4 THEN 'foreign' WHEN score >= 1 THEN 'ambiguous' ELSE 'foreign' END AS classification,
           CASE WHEN sure AND r > 1 AND score < 4 THEN bd END AS outranked_by FROM (
  SELECT *, b >= 4 AND (s2 IS NULL OR b - s2 >= 2) AS sure FROM (
    SELECT *, row_number() OVER w AS r, first_value(score) OVER a AS b, first_value(doi) OVER a AS bd, nth_value(score, 2) OVER a AS s2 FROM {scores}
    WINDOW w AS (PARTITION BY document_id ORDER BY score DESC, CASE WHEN first_page = 0 THEN 1000000000 ELSE first_page END, doi),
           a AS (PARTITION BY document_id ORDER BY score DESC, CASE WHEN first_page = 0 THEN 1000000000 ELSE first_page END, doi ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))))"""


_CLAIMED = """sm AS (SELECT document_id, doi, coalesce(first_page, 0) AS first_page, coalesce(score, 0) + coalesce(claim, 0) AS score FROM sc
  FULL JOIN (SELECT document_id, '10.5555/meta.' || no AS doi, 2 AS claim FROM document WHERE no % 6 = 1) USING (document_id, doi))"""


def title_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title rules over every document's first line and text."""
    c = Catalog(spark, sf_dir)
    rows = c.titled.join(c.text.select(F.col("doc_id").alias("no"), "text"), "no")
    t, body = F.col("title"), F.col("text")
    return rows.select(
        "document_id", text.clean(t).alias("cleaned"), text.alnum_key(t).alias("key"), F.array_join(F.array_sort(text.tokens(t)), " ").alias("tokens"),
        text.is_printed(t, body).alias("printed"), F.round(text.containment(t, body), 6).alias("contained"), text.looks_garbled(t).alias("garbled"),
        text.is_correction(t, body).alias("correction"), text.evidence_key(F.lit("title"), t).alias("evidence_key"),
        text.page_state(F.length(t).cast("long"), F.lit(0), F.length(t) == 7).alias("state"), text.is_scanned(F.length(body), F.lit(3)).alias("scanned"),
    )


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML titles read by pattern and cleaned of tags and entities."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("raw"))
    return rows.select("page_id", text.clean(F.col("raw")).alias("title"), text.alnum_key(text.clean(F.col("raw"))).alias("key"))


def identifier_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOI and ISBN rules over strings built from each row."""
    n = F.col("doc_id")
    raw = F.concat(F.lit("https://doi.org/10.5555/Ab("), n.cast("string"), F.when(n % 2 == 0, ")x).").otherwise("))."))
    nine = F.lpad((n * 7919 % 1_000_000_000).cast("string"), 9, "0")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return rows.select(
        "doc_id", identifiers.normalise_doi(raw).alias("doi"), identifiers.find_doi(F.concat(F.lit("see "), raw)).alias("found"), identifiers.doi_url(F.lit("10.5555/x")).alias("url"),
        identifiers.isbn_ok(F.concat(nine, (n % 10).cast("string"))).alias("isbn"),
        identifiers.normalise(F.lit("year"), F.concat(F.lit(" "), (1300 + n).cast("string"))).alias("year"),
        identifiers.reference_uri("doc", F.lit("artifact"), F.md5(n.cast("string").cast("binary")), F.when(n % 2 == 0, n), F.when(n % 3 == 0, F.lit("S 1"))).alias("uri"),
    )


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy names for every document with a title, made unique."""
    c = Catalog(spark, sf_dir)
    values = views.pivoted(c.metadata_value, ("title", "authors", "year"))
    rows = c.live.select("document_id", "no").join(values, "document_id").join(views.main_artifact(c.document_artifact), "document_id")
    people = F.from_json("authors", identifiers.AUTHORS)
    name = naming.name_for(F.col("title"), people, F.col("year"), F.lit(".PDF"))
    rows = rows.select(F.col("document_id").alias("item"), "artifact_id", F.concat(naming.year_directory(F.coalesce("year", F.lit(""))), F.lit("/"), name).alias("wanted")).filter("wanted IS NOT NULL")
    return lifecycle.disambiguate(rows)


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    path = F.col("relative_path")
    kinds = c.location.join(c.artifact.select("artifact_id", "content_kind"), "artifact_id")
    return kinds.select(
        "location_id", naming.extension_of(path).alias("extension"), naming.stem_of(path).alias("stem"), naming.extension_kind(path).alias("kind"),
        naming.kinds_disagree(path, F.col("content_kind")).alias("disagrees"), naming.within(path, F.lit("en/src1")).alias("inside"),
        F.array_join(naming.component_problems(F.concat(path, F.when(F.col("seq") % 5 == 0, ".").otherwise(""))), ",").alias("problems"),
    )


def _snapshots(c) -> tuple[DataFrame, DataFrame]:
    """Two states of the same roots: gone, replaced, moved, touched and new paths."""
    base = c.rows.select(
        F.col("source").alias("root_id"), F.col("doc_id").alias("i"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path_key"),
        F.concat("artifact_id", F.col("doc_id").cast("string")).alias("artifact_id"), F.col("n_chars").alias("size"),
    )
    i = F.col("i")
    known = base.filter(i % 7 != 5).withColumn("state", F.when(i % 11 == 0, "missing").otherwise("active"))
    seen = base.filter(i % 7 != 0).select(
        "root_id", F.when(i % 7 == 2, F.concat(F.lit("moved/"), "path_key")).otherwise(F.col("path_key")).alias("path_key"),
        F.when(i % 7 == 1, F.concat(F.lit("x"), "artifact_id")).otherwise(F.col("artifact_id")).alias("artifact_id"),
        (F.col("size") + F.when(i % 7 == 3, 1).otherwise(0)).alias("size"), F.when(i % 17 == 4, "unreadable").when(i % 17 == 9, "changing").otherwise("ok").alias("outcome"),
    )
    return known.drop("i"), seen


def scan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.reconcile(*_snapshots(Catalog(spark, sf_dir))).select("root_id", "path_key", "result")


def scan_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.pair_moves(lifecycle.reconcile(*_snapshots(Catalog(spark, sf_dir)))).select("root_id", "old_path", "new_path")


def proposal_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run over stored proposals: some gone, some changed, some new."""
    c = Catalog(spark, sf_dir)
    stored = c.metadata_candidate.filter("no % 5 <> 1")
    found = c.metadata_candidate.filter("no % 5 <> 2").withColumns({"status": F.lit("proposed"), "priority": F.col("priority") + F.when(F.col("no") % 9 == 4, 1).otherwise(0)})
    return lifecycle.upsert(stored, found, ["document_id", "field", "evidence_key", "source"], ["value", "confidence", "priority"])


def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.fold_events(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], "event_type")


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.history(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.select("user_id", "event_id", "old_value", "new_value")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON path predicate over the event log."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.filter("k IS NOT NULL").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("total"), F.max_by("event_id", F.struct("k", "event_id")).alias("largest"))


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    survivors = relate.merged_survivors(c.document).select("document_id", "survivor")
    return lifecycle.merge_documents(c.document_relation.filter("NOT retracted"), survivors)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepting and rejecting proposals, agreeing siblings included."""
    c = Catalog(spark, sf_dir)
    chosen = c.metadata_candidate.filter("no % 6 < 2 AND k = 0").select("candidate_id", F.when(F.col("no") % 6 == 0, "accept").otherwise("reject").alias("decision"))
    return lifecycle.decide(c.metadata_candidate, chosen)


def verified_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    i = F.col("seq")
    read = c.location.filter(i % 9 != 4).select(
        "location_id", F.when(i % 8 == 3, F.reverse("artifact_id")).otherwise(F.col("artifact_id")).alias("artifact_id"), F.when(i % 10 == 6, "unreadable").when(i % 10 == 7, "changing").otherwise("ok").alias("outcome")
    )
    return lifecycle.verify_hashes(c.location, read)


def identifier_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    n = F.col("no")
    words = F.concat(F.lit("ISBN 0-306-40615-"), (n % 10).cast("string"), F.lit(" and arXiv:2101.0000"), (n % 10).cast("string"), F.when(n % 3 == 0, " or arXiv:1901.12345").otherwise(""))
    return evidence.identifier_specs(c.document.select("document_id", F.lit(1).alias("pdf_page"), words.alias("text")))


def relation_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stating part_of between each document and the one of a quarter of its number, and the way back."""
    c = Catalog(spark, sf_dir)
    n = F.col("no")
    ends = c.document.select("document_id", F.concat(F.lit("doc-"), F.when(n % 3 == 0, F.floor(n / 2)).when(n % 3 == 1, F.floor(n / 4)).otherwise(n).cast("string")).alias("other"), n)
    wanted = ends.select(F.lit("part_of").alias("kind"), F.when(n % 2 == 0, F.col("other")).otherwise(F.col("document_id")).alias("source_id"), F.when(n % 2 == 0, F.col("document_id")).otherwise(F.col("other")).alias("target_id"))
    return relate.additions(c.document_relation, wanted.distinct(), c.document)


QUERIES = {
    "decisions": decided,
    "verify_hashes": verified_hashes,
    "identifier_specs": identifier_proposals,
    "relation_additions": relation_additions,
    "doi_classes": doi_classes,
    "doi_shared": doi_shared,
    "title_functions": title_functions,
    "page_titles": page_titles,
    "identifier_functions": identifier_functions,
    "file_names": file_names,
    "path_functions": path_functions,
    "scan_outcomes": scan_outcomes,
    "scan_moves": scan_moves,
    "proposal_upsert": proposal_upsert,
    "safe_batch": lambda s, d: (lambda c: lifecycle.safe_batch(c.metadata_candidate, c.metadata_value))(Catalog(s, d)),
    "event_fold": event_fold,
    "event_history": event_history,
    "event_props": event_props,
    "extraction_actions": lambda s, d: (lambda c: lifecycle.extraction_action(c.artifact, c.extraction, "current"))(Catalog(s, d)),
    "merged_edges": merged_edges,
}
_STOP = "['" + "', '".join(text.STOP_WORDS) + "']"
_TOK = rf"list_distinct(list_filter(regexp_extract_all(replace(strip_accents(lower({{0}})), 'ß', 'ss'), '\p{{{{L}}}}{{{{3,}}}}|[0-9]{{{{2,}}}}'), lambda w: NOT list_contains({_STOP}, w)))"
_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]{{1,200}}>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
_SNAP = """base AS (SELECT source AS root_id, doc_id AS i, 'd/' || doc_id || '.txt' AS path_key, artifact_id || doc_id AS artifact_id, n_chars AS size FROM d),
known AS (SELECT *, CASE WHEN i % 11 = 0 THEN 'missing' ELSE 'active' END AS state FROM base WHERE i % 7 <> 5),
seen AS (SELECT root_id, CASE WHEN i % 7 = 2 THEN 'moved/' || path_key ELSE path_key END AS path_key, CASE WHEN i % 7 = 1 THEN 'x' || artifact_id ELSE artifact_id END AS artifact_id,
  size + CASE WHEN i % 7 = 3 THEN 1 ELSE 0 END AS size, CASE WHEN i % 17 = 4 THEN 'unreadable' WHEN i % 17 = 9 THEN 'changing' ELSE 'ok' END AS outcome FROM base WHERE i % 7 <> 0),
rec AS (SELECT root_id, path_key, k.artifact_id AS old_artifact, s.artifact_id, CASE
    WHEN s.root_id IS NULL THEN CASE WHEN state = 'missing' THEN 'still_missing' ELSE 'missing' END WHEN outcome = 'changing' THEN 'changing' WHEN outcome = 'unreadable' THEN 'inaccessible'
    WHEN k.root_id IS NULL THEN CASE WHEN s.artifact_id IN (SELECT artifact_id FROM known) THEN 'new_location' ELSE 'new_artifact' END
    WHEN k.artifact_id <> s.artifact_id THEN 'replaced' WHEN state <> 'active' THEN 'reappeared' WHEN k.size <> s.size THEN 'touched' ELSE 'unchanged' END AS result
  FROM known k FULL JOIN seen s USING (root_id, path_key))"""
_CLEAN_NAME = r"""trim(regexp_replace(regexp_replace(regexp_replace(translate(replace(replace(replace(replace({}, ':', ' - '), '/', ' - '), chr(92), ' - '), '|', ' - '), '"<>?*', chr(39)), '[\s\p{Z}]', ' ', 'g'), '\p{C}', '', 'g'), '\s+', ' ', 'g'), ' .')"""
_SHORT = "CASE WHEN length({0}) <= 120 THEN {0} ELSE rtrim(left({0}, 111), ' .') || '~' || left(sha256({0}), 8) END"
ORACLES = {
    "file_names": sql(
        f"""SELECT item, artifact_id, wanted, CASE WHEN members = 1 THEN wanted ELSE folder || {_SHORT.format("tagged")} || '.pdf' END AS final FROM (
              SELECT *, substr(stem, length(folder) + 1) || ' [' || left(artifact_id, 8) || ']' || CASE WHEN copy > 1 THEN ' -' || copy ELSE '' END AS tagged FROM (
                SELECT *, folder || name AS stem, count(*) OVER (PARTITION BY lower(wanted)) AS members, row_number() OVER (PARTITION BY lower(wanted), artifact_id ORDER BY item) AS copy
                FROM (SELECT *, folder || name || '.pdf' AS wanted FROM named)))""",
        MAIN,
        "fields AS (SELECT document_id, max(value) FILTER (field = 'title') AS title, max(value) FILTER (field = 'year') AS year, max(value) FILTER (field = 'authors') AS authors FROM metadata_value GROUP BY 1)",
        f"""raw AS (SELECT document_id AS item, artifact_id, coalesce(year, 'unknown-year') || '/' AS folder, {_CLEAN_NAME.replace('{}', 'title')} AS part,
              array_to_string(list_filter([CASE WHEN authors IS NOT NULL THEN json_extract_string(authors, '$[0].family') || ' et al.' END, '(' || year || ')'], lambda x: x IS NOT NULL), ' ') AS head
            FROM live JOIN fields USING (document_id) JOIN main USING (document_id) WHERE title IS NOT NULL)""",
        "whole AS (SELECT *, trim(CASE WHEN head <> '' THEN head || ' - ' || part ELSE part END, ' .') AS full_stem FROM raw WHERE part <> '')",
        f"named AS (SELECT item, artifact_id, folder, {_SHORT.format('full_stem')} AS name FROM whole)",
    ),
    "decisions": sql(
        f"""SELECT candidate_id, document_id, field, status AS old_status, CASE WHEN dec = 'accept' THEN 'accepted' WHEN dec = 'reject' AND status <> 'accepted' THEN 'rejected'
              WHEN status IN ('proposed', 'stale', 'set_aside') AND (document_id, field, ak) IN (SELECT (document_id, field, ak) FROM x WHERE dec = 'accept') THEN 'accepted' ELSE status END AS status FROM x""",
        f"x AS (SELECT *, {AGREES} AS ak, CASE WHEN k = 0 AND no % 6 = 0 THEN 'accept' WHEN k = 0 AND no % 6 = 1 THEN 'reject' END AS dec FROM metadata_candidate)",
    ),
    "verify_hashes": sql(
        """SELECT location_id, CASE WHEN seq % 9 = 4 THEN 'missing' WHEN seq % 10 = 6 THEN 'unreadable' WHEN seq % 10 = 7 THEN 'changing'
             WHEN seq % 8 = 3 AND reverse(artifact_id) <> artifact_id THEN 'mismatch' ELSE 'ok' END AS result FROM location"""
    ),
    "identifier_specs": sql(
        """SELECT document_id, 'isbn' AS field, '030640615' || (no % 10) AS value, 'medium' AS confidence, 'required' AS review FROM document WHERE no % 10 = 2
           UNION ALL SELECT document_id, 'arxiv', '2101.0000' || (no % 10), CASE WHEN no % 3 = 0 THEN 'ambiguous' ELSE 'high' END, CASE WHEN no % 3 = 0 THEN 'required' ELSE 'safe' END FROM document
           UNION ALL SELECT document_id, 'arxiv', '1901.12345', 'ambiguous', 'required' FROM document WHERE no % 3 = 0"""
    ),
    "relation_additions": sql(
        """SELECT DISTINCT kind, w.source_id, w.target_id, CASE WHEN w.source_id = w.target_id THEN 'itself'
             WHEN w.source_id NOT IN (SELECT document_id FROM document) OR w.target_id NOT IN (SELECT document_id FROM document) THEN 'unknown'
             WHEN (w.source_id, w.target_id) IN (SELECT (source_id, target_id) FROM document_relation r WHERE r.kind = 'part_of' AND NOT retracted) THEN 'exists'
             WHEN (w.target_id, w.source_id) IN (SELECT (start, node) FROM walk) THEN 'cycle' ELSE 'added' END AS outcome FROM w""",
        WALK.format(kind="part_of"),
        """w AS (SELECT 'part_of' AS kind, CASE WHEN no % 2 = 0 THEN other ELSE document_id END AS source_id, CASE WHEN no % 2 = 0 THEN document_id ELSE other END AS target_id
             FROM (SELECT *, 'doc-' || CASE no % 3 WHEN 0 THEN no // 2 WHEN 1 THEN no // 4 ELSE no END AS other FROM document))""",
    ),
    "doi_classes": sql("SELECT * FROM cl", _PAGES, _CLASSES, _CLAIMED, _classified("sm")),
    "doi_shared": sql(
        """SELECT document_id, doi, CASE WHEN classification = 'own' THEN 'ambiguous' ELSE classification END AS classification, documents FROM cl
           JOIN (SELECT doi, count(DISTINCT document_id) AS documents FROM cl WHERE classification = 'own' GROUP BY doi HAVING count(DISTINCT document_id) >= 3) USING (doi)""",
        _PAGES,
        _CLASSES,
        _classified("sc"),
    ),
    "title_functions": sql(
        rf"""SELECT document_id, {_CLEAN.format("title")} AS cleaned, {key("title")} AS key, array_to_string(list_sort(t), ' ') AS tokens,
               length({key("title")}) >= 20 AND contains({key("text")}, {key("title")}) AS printed,
               CASE WHEN len(t) > 0 THEN round(len(list_intersect(t, b)) / len(t), 6) ELSE 0.0 END AS contained,
               regexp_matches(title, '(?:^|\s)(?:[\p{{L}}\p{{N}}]\s+){{3}}[\p{{L}}\p{{N}}](?:\s|$)') AS garbled,
               regexp_matches(title, '(?i)^[^\p{{L}}\p{{N}}_]*(?:correction|corrigendum|corrigenda|erratum|errata|addendum|retraction|comment|reply|response)\b')
                 OR regexp_matches(left(text, 200), '(?i)^[^\p{{L}}\p{{N}}_]*(?:correction|corrigendum|corrigenda|erratum|errata|addendum|retraction|comment|reply|response)\b') AS correction,
               left(sha256('title' || chr(31) || title), 20) AS evidence_key,
               CASE WHEN length(title) = 7 THEN 'failed' WHEN length(title) >= 50 THEN 'text_native' WHEN length(title) > 0 THEN 'text_sparse' ELSE 'blank' END AS state,
               length(text) < 300 AS scanned
             FROM (SELECT *, {_TOK.format("title")} AS t, {_TOK.format("text")} AS b FROM titled JOIN (SELECT doc_id AS no, text FROM d) USING (no))"""
    ),
    "page_titles": rf"""SELECT page_id, c AS title, {key("c")} AS key FROM (
        SELECT page_id, {_CLEAN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS c FROM pages)""",
    "identifier_functions": """
        SELECT doc_id, '10.5555/ab(' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ')x' ELSE ')' END AS doi,
               '10.5555/Ab(' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ')x' ELSE '' END AS found, 'https://doi.org/10.5555/x' AS url,
               (list_sum(list_transform(range(1, 10), lambda i: (11 - i) * substr(lpad((doc_id * 7919 % 1000000000)::VARCHAR, 9, '0'), i, 1)::INT)) + doc_id % 10) % 11 = 0 AS isbn,
               CASE WHEN 1300 + doc_id BETWEEN 1400 AND 2100 THEN (1300 + doc_id)::VARCHAR END AS year,
               'doc://artifact/' || md5(doc_id::VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '/page/' || doc_id WHEN doc_id % 3 = 0 THEN '/label/S%201' ELSE '' END AS uri
        FROM documents""",
    "scan_outcomes": sql("SELECT root_id, path_key, result FROM rec", _SNAP),
    "scan_moves": sql(
        """SELECT g.root_id, g.path_key AS old_path, n.path_key AS new_path FROM rec g JOIN rec n ON g.root_id = n.root_id AND g.old_artifact = n.artifact_id
           WHERE g.result IN ('missing', 'still_missing') AND n.result = 'new_location'""",
        _SNAP,
    ),
    "proposal_upsert": sql(
        """SELECT document_id, field, evidence_key, source, CASE WHEN had IS NULL THEN 'new' WHEN has IS NULL THEN CASE WHEN os IN ('proposed', 'set_aside') THEN 'stale' ELSE 'kept' END
             WHEN os IN ('accepted', 'rejected') THEN 'decided' WHEN os = 'proposed' AND op = np THEN 'unchanged' WHEN os = 'stale' THEN 'revived' ELSE 'updated' END AS outcome,
             CASE WHEN had IS NULL THEN 'proposed' WHEN has IS NULL THEN CASE WHEN os IN ('proposed', 'set_aside') THEN 'stale' ELSE os END
             WHEN os IN ('accepted', 'rejected') THEN os ELSE 'proposed' END AS status
           FROM (SELECT document_id, field, evidence_key, source, status AS os, priority AS op, true AS had FROM metadata_candidate WHERE no % 5 <> 1)
           FULL JOIN (SELECT document_id, field, evidence_key, source, priority + CASE WHEN no % 9 = 4 THEN 1 ELSE 0 END AS np, true AS has FROM metadata_candidate WHERE no % 5 <> 2)
           USING (document_id, field, evidence_key, source)"""
    ),
    "safe_batch": sql(
        f"""SELECT document_id, field, CASE WHEN keys = 1 THEN best.value END AS value, CASE WHEN keys > 1 THEN 'disagree' WHEN held IS NULL OR held = best.value THEN 'accept'
              WHEN hk = best.ak THEN CASE WHEN NOT locked AND accepted_by LIKE 'rule:%' AND field IN ('title', 'container', 'publisher') AND best.r > hr THEN 'upgrade' ELSE 'same_words' END
              ELSE 'differs' END AS action
            FROM (SELECT document_id, field, count(DISTINCT ak) AS keys, arg_max({{'value': value, 'ak': ak, 'r': r}}, {{'r': r, 'p': -priority, 'v': value}}) AS best FROM (
                SELECT *, {AGREES} AS ak, CASE source WHEN 'provider' THEN 50 WHEN 'pdf_layout' THEN 30 WHEN 'pdf_info' THEN 20 WHEN 'pdf_text_doi' THEN 10 ELSE 0 END AS r
                FROM metadata_candidate WHERE status = 'proposed' AND review = 'safe' AND (field <> 'doi' OR classification = 'own')) GROUP BY 1, 2)
            LEFT JOIN (SELECT document_id, field, value AS held, {AGREES} AS hk, CASE source WHEN 'provider' THEN 50 ELSE 20 END AS hr, locked, accepted_by FROM metadata_value)
            USING (document_id, field)"""
    ),
    "event_fold": "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS value, count(*) AS events FROM events GROUP BY user_id",
    "event_history": """SELECT user_id, event_id, old_value, event_type AS new_value FROM (
        SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value FROM events) WHERE old_value IS DISTINCT FROM event_type""",
    "event_props": """SELECT event_type, count(*) AS events, sum(k)::BIGINT AS total, arg_max(event_id, {'k': k, 'e': event_id}) AS largest
        FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) WHERE k IS NOT NULL GROUP BY event_type""",
    "extraction_actions": sql(
        """SELECT artifact_id, CASE WHEN status IS NULL THEN 'extract' WHEN source = 'imported' THEN 'keep_imported' WHEN profile_id <> 'current' THEN 're_extract'
             WHEN status = 'failed' THEN 'failed_before' ELSE 'current' END AS action FROM artifact LEFT JOIN extraction USING (artifact_id)"""
    ),
    "merged_edges": sql(
        """SELECT kind, CASE WHEN kind = 'related_to' THEN least(s, t) ELSE s END AS source_id, CASE WHEN kind = 'related_to' THEN greatest(s, t) ELSE t END AS target_id,
             min(relation_id) AS relation_id, count(*) AS folded
           FROM (SELECT relation_id, kind, coalesce(a.survivor, source_id) AS s, coalesce(b.survivor, target_id) AS t FROM document_relation
                 LEFT JOIN sv a ON a.document_id = source_id LEFT JOIN sv b ON b.document_id = target_id WHERE NOT retracted) WHERE s <> t GROUP BY 1, 2, 3""",
        CHAIN,
        "sv AS (SELECT document_id, arg_max(survivor, depth) AS survivor FROM chain GROUP BY document_id)",
    ),
    "path_functions": sql(
        """SELECT location_id, lower(split_part(relative_path, '.', -1)) AS extension, regexp_replace(split_part(relative_path, '/', -1), '\\.[^.]+$', '') AS stem, kind,
             CASE kind WHEN 'pdf' THEN content_kind <> 'pdf' WHEN 'text' THEN content_kind <> 'text' WHEN 'word_document' THEN content_kind <> 'text' ELSE false END AS disagrees,
             relative_path LIKE 'en/src1/%' AS inside, CASE WHEN seq % 5 = 0 THEN 'dot_or_space_at_end' ELSE '' END AS problems
           FROM (SELECT *, CASE lower(split_part(relative_path, '.', -1)) WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' WHEN 'csv' THEN 'text' WHEN 'docx' THEN 'word_document' ELSE 'other' END AS kind
                 FROM location) JOIN artifact USING (artifact_id)"""
    ),
}
