"""Metadata evidence: DOI scoring, shared identifiers and proposal specs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions.identifiers import ARXIV_IN_TEXT, DOI, ISBN_IN_TEXT, find_dois, isbn_digits, isbn_ok, normalise_doi

# Score parts, thresholds and cue words.
OWN_SCORE, OWN_MARGIN, AMBIGUOUS_FLOOR, DENSE_PAGE_DOIS, CROWDED_FRONT_DOIS, FRONT_PAGES, PAGES_EACH_END = 4, 2, 1, 6, 4, 2, 100
SHARED_DOI_DOCUMENTS = 3
BIBLIOGRAPHY = (
    r"(?i)^[ \t]*[^\p{L}\p{N}_\n]{0,3}[ \t]*(?:[0-9]{1,2}[.)]?[ \t]+)?(?:references?(?:[ \t]+and[ \t]+notes|[ \t]+cited)?|notes[ \t]+and[ \t]+references"
    r"|bibliography|literature[ \t]+cited|works[ \t]+cited|cited[ \t]+references|reference[ \t]+list)[ \t]*:?[ \t]*$"
)
OWN_CUES = (
    r"(?i)\b(received|accepted|published|cite\s+this|cite\s+as|to\s+cite|copyright|downloaded|available\s+online|article\s+history|revised|journal\s+homepage"
    r"|online\s+version|citation|all\s+rights\s+reserved|front\s+matter)\b|©|pubs\.acs\.org|sciencedirect\.com|onlinelibrary\.wiley\.com|link\.springer\.com"
    r"|iopscience\.iop\.org|pubs\.rsc\.org|aip\.org|nature\.com|tandfonline\.com|mdpi\.com|scitation\.org"
)
FOREIGN_CUES = (
    r"(?i)\b(original\s+(?:article|paper|letter|work|publication|study)|corrigendum\s+to|erratum\s+to|correction\s+to|comment\s+on|reply\s+to|addendum\s+to"
    r"|related\s+article|see\s+also)\b"
)


def scanned_pages(pages: DataFrame, each_end: int = PAGES_EACH_END) -> DataFrame:
    """The first and last stretch of long documents."""
    window = Window.partitionBy("document_id")
    rows = pages.withColumn("__i", F.row_number().over(window.orderBy("pdf_page"))).withColumn("__n", F.count(F.lit(1)).over(window))
    return rows.filter((F.col("__n") <= 2 * each_end) | (F.col("__i") <= each_end) | (F.col("__i") > F.col("__n") - each_end)).drop("__i", "__n")


def doi_places(pages: DataFrame) -> DataFrame:
    """(document_id, pdf_page, line, at, doi, own, line_own, foreign): each DOI with the cue words of its line and its neighbours."""
    lines = pages.select("document_id", "pdf_page", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    order = Window.partitionBy("document_id", "pdf_page").orderBy("line")
    cue = F.col("text").rlike(OWN_CUES)
    lines = lines.withColumn("line_own", cue).withColumn("own", cue | F.coalesce(F.lag(cue).over(order), F.lit(False)) | F.coalesce(F.lead(cue).over(order), F.lit(False)))
    lines = lines.filter(F.col("text").rlike(DOI)).withColumn("foreign", F.col("text").rlike(FOREIGN_CUES))
    return lines.select("document_id", "pdf_page", "line", "own", "line_own", "foreign", F.posexplode(find_dois(F.col("text"))).alias("at", "doi"))


def bibliography_start(pages: DataFrame) -> DataFrame:
    """(document_id, bib): the first references heading, never on page one of a longer document."""
    count = F.count(F.lit(1)).over(Window.partitionBy("document_id"))
    lines = pages.withColumn("n", count).filter("pdf_page > 1 OR n = 1").select("document_id", "pdf_page", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return lines.filter(F.col("text").rlike(BIBLIOGRAPHY)).groupBy("document_id").agg(F.min(F.struct("pdf_page", "line")).alias("bib"))


def classify_dois(pages: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """(document_id, doi, score, classification, outranked_by) for each DOI printed outside the bibliography or claimed by the file.

    ``claimed``: (document_id, doi) named by the file's own metadata.
    """
    pages = scanned_pages(pages)
    places = doi_places(pages).join(bibliography_start(pages), "document_id", "left")
    outside = places.filter(F.col("bib").isNull() | (F.struct("pdf_page", "line") <= F.col("bib")) | F.col("own"))
    dense = places.groupBy("document_id", "pdf_page").agg(F.countDistinct("doi").alias("k")).filter(F.col("k") >= DENSE_PAGE_DOIS).select("document_id", "pdf_page", F.lit(True).alias("dense"))
    outside = outside.join(dense, ["document_id", "pdf_page"], "left").withColumn("real", F.col("dense").isNull() | F.col("line_own"))
    first = outside.filter("pdf_page = 1").groupBy("document_id").agg(F.min_by("doi", F.struct("line", "at")).alias("top"), F.countDistinct("doi").alias("front"))
    early = F.col("pdf_page") <= FRONT_PAGES
    groups = outside.groupBy("document_id", "doi").agg(
        F.min("pdf_page").alias("first_page"),
        F.min(F.when(F.col("real"), F.col("pdf_page"))).alias("first_real"),
        F.countDistinct(F.when(F.col("real"), F.col("pdf_page"))).alias("real_pages"),
        F.bool_or(early & F.col("own")).alias("cue"),
        F.bool_or(early & F.col("foreign")).alias("names_other"),
    )
    groups = groups.join(first, "document_id", "left")
    on_first = F.col("first_page") == 1
    parts = [
        F.when(F.col("first_real") == 1, 3).when(F.col("first_real") == 2, 1).otherwise(0),
        F.when(F.col("cue"), 2).otherwise(0),
        F.when(F.col("names_other"), -3).otherwise(0),
        F.when(F.col("real_pages") >= 3, 1).otherwise(0),
        F.when((F.col("doi") == F.col("top")) & (F.col("first_real") == 1), 1).otherwise(0),
        F.when(on_first & (F.col("front") >= CROWDED_FRONT_DOIS) & ~F.col("cue"), -2).otherwise(0),
        F.when(F.col("first_real").isNull(), -3).otherwise(0),
    ]
    score = parts[0]
    for part in parts[1:]:
        score = score + part
    rows = groups.select("document_id", "doi", "first_page", score.alias("score"))
    if claimed is not None:
        named = claimed.select("document_id", normalise_doi(F.col("doi")).alias("doi")).filter("doi IS NOT NULL").distinct().withColumn("claim", F.lit(2))
        rows = rows.join(named, ["document_id", "doi"], "full_outer")
        rows = rows.select("document_id", "doi", F.coalesce("first_page", F.lit(0)).alias("first_page"), (F.coalesce("score", F.lit(0)) + F.coalesce("claim", F.lit(0))).alias("score"))
    order = Window.partitionBy("document_id").orderBy(F.desc("score"), F.when(F.col("first_page") == 0, 10**9).otherwise(F.col("first_page")), "doi")
    rows = rows.withColumn("rank", F.row_number().over(order))
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("best", F.first("score").over(everyone)).withColumn("best_doi", F.first("doi").over(everyone)).withColumn("second", F.nth_value("score", 2).over(everyone))
    sure = (F.col("best") >= OWN_SCORE) & (F.col("second").isNull() | (F.col("best") - F.col("second") >= OWN_MARGIN))
    label = (
        F.when(sure & (F.col("rank") == 1), "own")
        .when(sure & (F.col("score") < OWN_SCORE), "foreign")
        .when(F.col("score") >= AMBIGUOUS_FLOOR, "ambiguous")
        .otherwise("foreign")
    )
    return rows.select("document_id", "doi", "score", label.alias("classification"), F.when(sure & (F.col("rank") > 1) & (F.col("score") < OWN_SCORE), F.col("best_doi")).alias("outranked_by"))


def shared_dois(classified: DataFrame) -> DataFrame:
    """DOIs that several documents print as their own name a work they share."""
    counts = classified.filter("classification = 'own'").groupBy("doi").agg(F.countDistinct("document_id").alias("documents"))
    return counts.filter(F.col("documents") >= SHARED_DOI_DOCUMENTS)


def demote_shared(classified: DataFrame) -> DataFrame:
    rows = classified.join(shared_dois(classified), "doi", "left")
    shared = F.col("documents").isNotNull() & (F.col("classification") == "own")
    return rows.select("document_id", "doi", "score", F.when(shared, "ambiguous").otherwise(F.col("classification")).alias("classification"), "documents")


def identifier_specs(pages: DataFrame, isbn_pages: int = 10) -> DataFrame:
    """ISBN proposals from the first pages and arXiv proposals from page one: field, value, confidence, review."""
    found = pages.filter(F.col("pdf_page") <= isbn_pages).select("document_id", F.explode(F.regexp_extract_all("text", F.lit(ISBN_IN_TEXT), 1)).alias("raw"))
    isbn = found.select("document_id", isbn_digits(F.col("raw")).alias("value")).filter(isbn_ok(F.col("value"))).distinct()
    isbn = isbn.select("document_id", F.lit("isbn").alias("field"), "value", F.lit("medium").alias("confidence"), F.lit("required").alias("review"))
    one = pages.filter("pdf_page = 1").select("document_id", F.explode(F.regexp_extract_all("text", F.lit(ARXIV_IN_TEXT), 1)).alias("value")).distinct()
    several = one.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    arxiv = one.join(several, "document_id").select(
        "document_id", F.lit("arxiv").alias("field"), "value", F.when(F.col("n") == 1, "high").otherwise("ambiguous").alias("confidence"), F.when(F.col("n") == 1, "safe").otherwise("required").alias("review")
    )
    return isbn.unionByName(arxiv)
