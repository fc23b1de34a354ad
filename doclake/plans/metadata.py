"""Proposals and provider stages with their SQL; what the tables lack (file titles, records, verdicts) follows from each number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.operators import specs, views
from doclake.plans.corpus_sql import key, sql
from doclake.sources.corpus import Catalog, pick

LEVELS = ("exact", "strong", "weak", "contradicted", "no_match", "unverifiable")


def _named(c: Catalog) -> DataFrame:
    """(document_id, no, title) of documents with a title, written once a session: several stages read them side by side."""
    return c.derived("named", lambda: c.titled.filter("title <> ''").select("document_id", "no", "title"))


def _front(c: Catalog) -> DataFrame:
    """A front page that prints the title and, for some, the first author's surname."""
    text = F.concat(F.when(F.col("no") % 5 != 2, F.col("title")).otherwise(F.lit("no title here")), F.lit("\nby Ann Fam"), (F.col("no") % 7).cast("string"), F.lit(" and others"))
    return _named(c).select("document_id", "no", text.alias("text"))


def _titles(c: Catalog) -> DataFrame:
    n, title = F.col("no"), F.col("title")
    other = F.concat(F.lit("Quite another heading "), n.cast("string"))

    def told(held, source, value):
        return F.when(held, F.struct(F.lit(source).alias("source"), value.alias("value")))

    found = F.array(
        told(n % 4 != 3, "layout_title", title),
        told(n % 3 != 1, "pdf_xmp_title", F.when(n % 6 == 0, other).otherwise(F.lower("title"))),
        told(n % 2 == 0, "pdf_info_title", title),
        told(n % 7 == 0, "filename_hint", title),
    )
    return _named(c).select("document_id", F.explode(F.array_compact(found)).alias("t")).select("document_id", "t.*")


def _authors(c: Catalog) -> DataFrame:
    name = F.concat(F.lit("Ann Fam"), (F.col("no") % 9).cast("string"))
    return _named(c).filter("no % 5 <> 4").select("document_id", F.lit("pdf_xmp_authors").alias("source"), F.array(name, F.concat(F.lit("Zz"), F.col("no").cast("string"), F.lit(", Bo"))).alias("names"))


def _dois(c: Catalog) -> DataFrame:
    return c.document.select(
        "document_id", F.concat(F.lit("10.5555/doc."), (F.col("no") % 300).cast("string")).alias("doi"), (F.col("no") % 9).cast("int").alias("score"), pick(("own", "ambiguous", "foreign"), F.col("no")).alias("classification"),
        (F.col("no") % 4).cast("int").alias("first_page"), (F.col("no") % 11 == 0).alias("wrapped"), (F.col("no") % 13 == 0).alias("listed"),
    )


def _checks(c: Catalog) -> DataFrame:
    return c.document.filter("no % 3 = 0").select("document_id", F.concat(F.lit("10.5555/doc."), (F.col("no") % 300).cast("string")).alias("doi"), pick(LEVELS, F.floor(F.col("no") / 3)).alias("verdict"))


def _shared(c: Catalog) -> DataFrame:
    return _dois(c).filter("classification = 'own'").groupBy("doi").agg(F.countDistinct("document_id").alias("documents")).filter("documents >= 3")


def _identifiers(c: Catalog) -> DataFrame:
    return c.document.filter("no % 8 = 5").select("document_id", F.lit("arxiv").alias("field"), F.concat(F.lit("2101.0"), F.lpad((F.col("no") % 10_000).cast("string"), 4, "0")).alias("value"), F.lit("high").alias("confidence"), F.lit("safe").alias("review"))


def _works(c: Catalog) -> DataFrame:
    """A record for each accepted DOI; some fields are missing or no values."""
    rows = c.titled.join(c.metadata_value.filter("field = 'doi'").select("document_id"), "document_id", "left_semi")
    people = F.concat(F.lit('[{"family":"Fam'), (F.col("no") % 50).cast("string"), F.lit('","given":"G"}]'))
    return rows.select(
        "document_id", "no", pick(("exact", "strong", "weak"), F.col("no")).alias("verdict"), F.concat(F.lit("<i>"), "title", F.lit("</i>")).alias("title"), F.when(F.col("no") % 4 != 1, people).alias("authors"),
        F.when(F.col("no") % 6 == 2, F.lit("20x1")).otherwise((1990 + F.col("no") % 35).cast("string")).alias("year"), F.concat(F.lit("Journal  of "), "source").alias("container"), F.lit(None).cast("string").alias("publisher"),
        F.lit("journal-article").alias("type"), (F.col("no") % 40).cast("string").alias("volume"), F.lit("").alias("issue"), F.concat(F.col("no").cast("string"), F.lit("-"), (F.col("no") + 9).cast("string")).alias("pages"),
    )


def _answers(c: Catalog) -> DataFrame:
    rows = c.metadata_value.filter("field = 'doi' AND no % 10 <> 4")
    return rows.select("document_id", F.col("value").alias("doi"), pick(LEVELS, F.col("no")).alias("verdict"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    cached = c.document.select(F.concat(F.lit("doi:10.5555/doc."), (F.col("no") % 40).cast("string")).alias("key"))
    return specs.planned_requests(c.metadata_candidate, c.metadata_value, specs.local_titles(c.metadata_candidate.filter("k = 0"), ("pdf_layout",)), cached)


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    front = _front(c)
    return specs.local_specs(specs.doi_specs(_dois(c), _checks(c), _shared(c)), _identifiers(c), specs.title_specs(_titles(c), front), specs.author_specs(_authors(c), front))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    pages = c.document.select("document_id", F.when(F.col("no") % 9 == 0, "  ").otherwise("words").alias("text"))
    return specs.notes(pages, c.document.filter("no % 4 <> 0"))


def _reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts stored as proposals, read back as checks, change the local DOI specs of the next round."""
    c = Catalog(spark, sf_dir)
    stored = specs.check_specs(_checks(c)).withColumn("evidence", F.lit("{}"))
    verdict = c.document.select("document_id", F.when(F.col("no") % 3 == 0, pick(LEVELS, F.floor(F.col("no") / 3))).alias("verdict"))
    evidence = F.when(F.col("verdict") == "no_match", F.lit('{"state":"no_match"}')).otherwise(F.concat(F.lit('{"state":"success","verdict":"'), "verdict", F.lit('"}')))
    stored = stored.drop("evidence").join(verdict, "document_id").withColumn("evidence", evidence)
    return specs.doi_specs(_dois(c), specs.provider_checks(stored), _shared(c)).select("document_id", "value", "classification", "review", "status")


QUERIES = {
    "doi_specs": lambda s, d: (lambda c: specs.doi_specs(_dois(c), _checks(c), _shared(c)))(Catalog(s, d)),
    "title_specs": lambda s, d: (lambda c: specs.title_specs(_titles(c), _front(c)))(Catalog(s, d)),
    "author_specs": lambda s, d: (lambda c: specs.author_specs(_authors(c), _front(c)))(Catalog(s, d)),
    "local_specs": _local,
    "local_notes": _notes,
    "check_specs": lambda s, d: specs.check_specs(_checks(Catalog(s, d))),
    "work_specs": lambda s, d: specs.work_specs(_works(Catalog(s, d))),
    "accepted_doi_stage": lambda s, d: (lambda c: specs.accepted_stage(c.metadata_value, _answers(c)))(Catalog(s, d)),
    "planned_requests": _requests,
    "specs_after_verdicts": _reread,
}

_LEVEL = "['exact', 'strong', 'weak', 'contradicted', 'no_match', 'unverifiable']"
_TABLES = (
    f"""dois AS (SELECT document_id, '10.5555/doc.' || no % 300 AS doi, no % 9 AS score, ['own', 'ambiguous', 'foreign'][no % 3 + 1] AS classification, no % 4 AS first_page,
         no % 11 = 0 AS wrapped, no % 13 = 0 AS listed, CASE WHEN no % 3 = 0 THEN {_LEVEL}[(no // 3) % 6 + 1] END AS verdict FROM document)""",
    "shared AS (SELECT doi FROM dois WHERE classification = 'own' GROUP BY doi HAVING count(DISTINCT document_id) >= 3)",
    """kinds AS (SELECT *, CASE WHEN verdict = 'contradicted' THEN 'foreign' WHEN classification = 'own' AND doi IN (SELECT doi FROM shared) THEN 'ambiguous' ELSE classification END AS kind FROM dois)""",
    """doi_specs AS (SELECT document_id, 'doi' AS field, doi AS value, CASE WHEN first_page > 0 THEN 'pdf_text_doi' ELSE 'pdf_metadata_doi' END AS source, kind AS classification,
         CASE kind WHEN 'own' THEN CASE WHEN score >= 6 THEN 'high' ELSE 'medium' END WHEN 'ambiguous' THEN 'ambiguous' ELSE 'low' END AS confidence,
         CASE WHEN kind = 'own' AND score >= 6 AND NOT wrapped AND coalesce(verdict NOT IN ('no_match', 'weak', 'unverifiable'), true) THEN 'safe' ELSE 'required' END AS review,
         CASE WHEN kind = 'own' THEN 10 ELSE 30 END AS priority, CASE WHEN kind = 'foreign' THEN 'set_aside' ELSE 'proposed' END AS status
       FROM kinds WHERE NOT (kind = 'foreign' AND (listed OR first_page > 2)))""",
    """front AS (SELECT document_id, no, CASE WHEN no % 5 <> 2 THEN title ELSE 'no title here' END || chr(10) || 'by Ann Fam' || no % 7 || ' and others' AS text FROM titled WHERE title <> '')""",
    f"""named AS (SELECT *, {key("value")} AS k FROM (
         SELECT document_id, no, 'layout_title' AS source, title AS value FROM titled WHERE title <> '' AND no % 4 <> 3
         UNION ALL SELECT document_id, no, 'pdf_xmp_title', CASE WHEN no % 6 = 0 THEN 'Quite another heading ' || no ELSE lower(title) END FROM titled WHERE title <> '' AND no % 3 <> 1
         UNION ALL SELECT document_id, no, 'pdf_info_title', title FROM titled WHERE title <> '' AND no % 2 = 0
         UNION ALL SELECT document_id, no, 'filename_hint', title FROM titled WHERE title <> '' AND no % 7 = 0))""",
    f"""weighed AS (SELECT a.document_id, a.source, a.value, count(*) FILTER (b.source <> 'filename_hint') AS witnesses, coalesce(bool_or(b.source = 'layout_title'), false) AS laid_out,
         any_value(length(a.k) >= 20 AND contains({key("f.text")}, a.k)) AS printed,
         regexp_matches(a.value, '(?:^|\\s)(?:[\\p{{L}}\\p{{N}}]\\s+){{3}}[\\p{{L}}\\p{{N}}](?:\\s|$)') AS garbled
       FROM named a JOIN named b ON a.document_id = b.document_id AND (a.source = b.source OR (a.k <> '' AND a.k = b.k)) JOIN front f ON f.document_id = a.document_id GROUP BY 1, 2, 3)""",
    """title_specs AS (SELECT document_id, 'title' AS field, value, source, NULL::VARCHAR AS classification,
         CASE WHEN source = 'filename_hint' OR garbled THEN 'low' WHEN printed AND witnesses >= 2 THEN 'high' WHEN printed THEN 'medium' ELSE 'low' END AS confidence,
         CASE WHEN printed AND witnesses >= 2 AND laid_out AND NOT garbled THEN 'safe' ELSE 'required' END AS review, 20 AS priority, 'proposed' AS status FROM weighed)""",
    """author_specs AS (SELECT document_id, 'authors' AS field, '[{"name":"Ann Fam' || no % 9 || '"},{"name":"Zz' || no || ', Bo"}]' AS value, 'pdf_xmp_authors' AS source, NULL::VARCHAR AS classification,
         CASE WHEN no % 9 = no % 7 OR contains(k, 'fam' || no % 9) OR contains(k, 'zz' || no) THEN 'medium' ELSE 'low' END AS confidence, 'required' AS review, 40 AS priority, 'proposed' AS status
       FROM (SELECT document_id, no, {} AS k FROM front) WHERE no % 5 <> 4)""".replace("{}", key("text")),
    f"""check_specs AS (SELECT document_id, 'doi' AS field, doi AS value, 'crossref' AS source,
         CASE verdict WHEN 'exact' THEN 'own' WHEN 'strong' THEN 'own' WHEN 'contradicted' THEN 'foreign' WHEN 'no_match' THEN NULL ELSE 'ambiguous' END AS classification,
         CASE verdict WHEN 'exact' THEN 'exact' WHEN 'strong' THEN 'high' WHEN 'contradicted' THEN 'low' WHEN 'no_match' THEN 'low' ELSE 'ambiguous' END AS confidence,
         CASE verdict WHEN 'exact' THEN 'safe' ELSE 'required' END AS review, CASE verdict WHEN 'exact' THEN 5 WHEN 'strong' THEN 10 WHEN 'weak' THEN 20 WHEN 'unverifiable' THEN 20 ELSE 35 END AS priority,
         CASE WHEN verdict IN ('contradicted', 'no_match') THEN 'set_aside' ELSE 'proposed' END AS status FROM dois WHERE verdict IS NOT NULL AND verdict IN (SELECT unnest({_LEVEL})))""",
    """works AS (SELECT document_id, no, ['exact', 'strong', 'weak'][no % 3 + 1] AS verdict, title, source FROM titled WHERE document_id IN (SELECT document_id FROM metadata_value WHERE field = 'doi'))""",
    """fields AS (SELECT document_id, verdict, 'title' AS field, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace('<i>' || title || '</i>', '<[^>]{1,200}>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS value FROM works
         UNION ALL SELECT document_id, verdict, 'authors', '[{"family":"Fam' || no % 50 || '","given":"G"}]' FROM works WHERE no % 4 <> 1
         UNION ALL SELECT document_id, verdict, 'year', (1990 + no % 35)::VARCHAR FROM works WHERE no % 6 <> 2
         UNION ALL SELECT document_id, verdict, 'container', 'Journal of ' || source FROM works UNION ALL SELECT document_id, verdict, 'type', 'journal-article' FROM works
         UNION ALL SELECT document_id, verdict, 'volume', (no % 40)::VARCHAR FROM works UNION ALL SELECT document_id, verdict, 'pages', no || '-' || (no + 9) FROM works)""",
)

ORACLES = {
    "doi_specs": sql("SELECT * FROM doi_specs", *_TABLES[:4]),
    "title_specs": sql("SELECT * FROM title_specs", *_TABLES[4:8]),
    "author_specs": sql("SELECT * FROM author_specs", _TABLES[4], _TABLES[8]),
    "local_specs": sql(
        """SELECT * FROM doi_specs UNION ALL SELECT * FROM title_specs UNION ALL SELECT * FROM author_specs
           UNION ALL SELECT document_id, 'arxiv', '2101.0' || lpad((no % 10000)::VARCHAR, 4, '0'), 'arxiv_text', NULL, 'high', 'safe', 30, 'proposed' FROM document WHERE no % 8 = 5""",
        *_TABLES[:9],
    ),
    "local_notes": sql("SELECT document_id, 'front_matter_not_read' AS note FROM document WHERE no % 4 = 0 UNION ALL SELECT document_id, 'no_text_layer' FROM document WHERE no % 9 = 0"),
    "check_specs": sql("SELECT * FROM check_specs", _TABLES[0], _TABLES[9]),
    "work_specs": sql(
        """SELECT document_id, field, value, 'crossref' AS source, NULL::VARCHAR AS classification, CASE verdict WHEN 'exact' THEN 'exact' WHEN 'strong' THEN 'high' ELSE 'medium' END AS confidence,
             CASE verdict WHEN 'exact' THEN 'safe' ELSE 'required' END AS review, 25 AS priority, 'proposed' AS status FROM fields WHERE value <> ''""",
        *_TABLES[10:],
    ),
    "accepted_doi_stage": sql(
        f"""SELECT document_id, value AS doi, CASE WHEN verdict IS NULL THEN 'no_answer' WHEN verdict = 'no_match' THEN 'unknown_to_provider' WHEN verdict = 'contradicted' THEN 'contradicted'
              WHEN verdict = 'weak' AND accepted_by LIKE 'rule:%' THEN 'weak' ELSE 'proposed' END AS outcome
            FROM (SELECT *, CASE WHEN no % 10 <> 4 THEN {_LEVEL}[no % 6 + 1] END AS verdict FROM metadata_value WHERE field = 'doi')"""
    ),
    "planned_requests": sql(
        f"""SELECT document_id, 'doi' AS sends, value, value IN (SELECT '10.5555/doc.' || no % 40 FROM document) AS cached FROM accepted
            UNION ALL SELECT document_id, 'doi', value, value IN (SELECT '10.5555/doc.' || no % 40 FROM document) FROM printed WHERE r <= 3
            UNION ALL SELECT document_id, 'title', v, false FROM (SELECT document_id, {{}} AS v, {key("value")} AS k FROM (
              SELECT DISTINCT document_id, value FROM metadata_candidate WHERE k = 0 AND status IN ('proposed', 'accepted', 'stale')))
            WHERE length(k) >= 20 AND document_id NOT IN (SELECT document_id FROM accepted) AND document_id NOT IN (SELECT document_id FROM printed)""".replace(
            "{}", "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(value, '<[^>]{1,200}>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"
        ),
        "accepted AS (SELECT document_id, value FROM metadata_value WHERE field = 'doi' AND document_id IN (SELECT document_id FROM metadata_candidate))",
        """printed AS (SELECT document_id, value, row_number() OVER (PARTITION BY document_id ORDER BY priority, confidence, value) AS r FROM metadata_candidate
             WHERE field = 'doi' AND status = 'proposed' AND classification IN ('own', 'ambiguous') AND document_id NOT IN (SELECT document_id FROM accepted))""",
    ),
    "specs_after_verdicts": sql("SELECT document_id, value, classification, review, status FROM doi_specs", *_TABLES[:4]),
}
