"""Proposals from what a document and a provider say: one table of specs (document_id, field, value, source, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions import exact
from doclake.functions.identifiers import AUTHORS, normalise
from doclake.functions.text import alnum_key, clean, column_key, key_is_printed, looks_garbled
from doclake.operators.views import union

# Thresholds, ranks and field names that decide answers.
SAFE_DOI_SCORE, TITLE_AGREEMENT, MIN_SURNAME, LOOKUPS, MIN_SEARCHABLE = 6, 0.9, 3, 3, 20
DOI_CONFIDENCE = {"ambiguous": "ambiguous", "foreign": "low"}
WORK_FIELDS = ("title", "authors", "year", "container", "publisher", "type", "volume", "issue", "pages")
VERDICTS = {  # level: classification, confidence, review, priority, status
    "exact": ("own", "exact", "safe", 5, "proposed"),
    "strong": ("own", "high", "required", 10, "proposed"),
    "contradicted": ("foreign", "low", "required", 35, "set_aside"),
    "no_match": (None, "low", "required", 35, "set_aside"),
    "weak": ("ambiguous", "ambiguous", "required", 20, "proposed"),
    "unverifiable": ("ambiguous", "ambiguous", "required", 20, "proposed"),
}
SHAPE = ("document_id", "field", "value", "source", "classification", "confidence", "review", "priority", "status")


def _spec(rows: DataFrame, **columns) -> DataFrame:
    held = {"classification": F.lit(None).cast("string"), "review": "required", "status": "proposed"} | columns
    named = {k: v if isinstance(v, Column) else F.lit(v) for k, v in held.items()}
    return rows.select("document_id", *[named.get(c, F.col(c)).alias(c) for c in SHAPE[1:]])


def doi_specs(classified: DataFrame, checks: DataFrame, shared: DataFrame) -> DataFrame:
    """Specs of classified DOIs (document_id, doi, score, classification, first_page, wrapped, listed).

    ``checks``: (document_id, doi, verdict) of a provider; ``shared``: (doi, documents)
    that several documents print as their own. What is set aside and stands on a
    page of lists, or deep in the body, gives no row.
    """
    rows = classified.join(checks.select("document_id", "doi", "verdict"), ["document_id", "doi"], "left").join(shared.select("doi", "documents"), "doi", "left")
    kind = F.when(F.col("verdict") == "contradicted", "foreign").when((F.col("classification") == "own") & F.col("documents").isNotNull(), "ambiguous").otherwise(F.col("classification"))
    rows = rows.withColumn("kind", kind).withColumn("aside", ~F.col("kind").isin("own", "ambiguous"))
    rows = rows.filter(~(F.col("aside") & (F.col("listed") | (F.col("first_page") > 2))))
    doubted = F.coalesce(F.col("verdict").isin("no_match", "weak", "unverifiable"), F.lit(False))
    strong = F.col("score") >= SAFE_DOI_SCORE
    confidence = F.when(F.col("kind") == "own", F.when(strong, "high").otherwise("medium"))
    for name, word in DOI_CONFIDENCE.items():
        confidence = confidence.when(F.col("kind") == name, word)
    return _spec(
        rows, field="doi", value=F.col("doi"), source=F.when(F.col("first_page") > 0, "pdf_text_doi").otherwise("pdf_metadata_doi"), classification=F.col("kind"), confidence=confidence,
        review=F.when((F.col("kind") == "own") & strong & ~F.col("wrapped") & ~doubted, "safe").otherwise("required"),
        priority=F.when(F.col("kind") == "own", 10).otherwise(30), status=F.when(F.col("aside"), "set_aside").otherwise("proposed"),
    )


def title_specs(found: DataFrame, front: DataFrame) -> DataFrame:
    """Specs of the titles that a document's sources give (document_id, source, value) against its front text (document_id, text).

    A document's titles come together once and are compared there; no pair of titles is a row.
    """
    rows = found.filter("value IS NOT NULL AND value <> ''").groupBy("document_id").agg(F.collect_list(F.struct("source", "value")).alias("told"))
    several = F.size("told") > 1
    sources = exact.agreeing(TITLE_AGREEMENT)(F.when(several, F.col("told.source")), F.when(several, F.col("told.value")))
    rows = rows.withColumn("sources", F.coalesce(sources, F.array(F.col("told.source")))).join(front.select("document_id", column_key("text").alias("front_key")), "document_id", "left")
    rows = rows.select("document_id", "front_key", F.explode(F.arrays_zip("told", "sources")).alias("t")).filter("t.sources IS NOT NULL")
    rows = rows.select("document_id", "front_key", "t.told.*", F.array_remove("t.sources", "filename_hint").alias("witnesses"))
    rows = rows.withColumns({"printed": F.coalesce(key_is_printed(column_key("value"), F.col("front_key")), F.lit(False)), "garbled": looks_garbled(F.col("value"))})
    printed, garbled, several, laid_out = F.col("printed"), F.col("garbled"), F.size("witnesses") >= 2, F.array_contains("witnesses", "layout_title")
    confidence = F.when((F.col("source") == "filename_hint") | garbled, "low").when(printed & several, "high").when(printed, "medium").otherwise("low")
    return _spec(rows, field="title", confidence=confidence, review=F.when(printed & several & laid_out & ~garbled, "safe").otherwise("required"), priority=20)


def author_specs(found: DataFrame, front: DataFrame) -> DataFrame:
    """Specs of author lists (document_id, source, names) by how many surnames the front text prints."""
    rows = found.filter(F.size("names") > 0).join(front.select("document_id", column_key("text").alias("front_key")), "document_id", "left")

    def surname(name: Column) -> Column:
        name = F.btrim(name)
        return alnum_key(F.when(F.contains(name, F.lit(",")), F.regexp_extract(name, "^[^ ,]*", 0)).otherwise(F.regexp_extract(name, r"\S+$", 0)))

    printed = F.size(F.filter(F.transform("names", surname), lambda s: (F.length(s) >= MIN_SURNAME) & F.contains(F.coalesce("front_key", F.lit("")), s)))
    people = F.transform("names", lambda n: F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), F.btrim(n).alias("name")))
    return _spec(rows, field="authors", value=F.to_json(people), confidence=F.when(printed * 2 >= F.size("names"), "medium").otherwise("low"), priority=40)


def identifier_rows(identifiers: DataFrame) -> DataFrame:
    """ISBN and arXiv proposals (``evidence.identifier_specs``) in the common shape."""
    return _spec(
        identifiers, source=F.when(F.col("field") == "isbn", "isbn_text").otherwise("arxiv_text"), confidence=F.col("confidence"), review=F.col("review"), priority=30
    )


def local_specs(dois: DataFrame, identifiers: DataFrame, titles: DataFrame, authors: DataFrame) -> DataFrame:
    """All that the document itself supports, in one table."""
    return union([dois, identifier_rows(identifiers), titles, authors])


def notes(pages: DataFrame, fronts: DataFrame) -> DataFrame:
    """(document_id, note): what was missing while proposals were made. ``fronts``: documents whose front matter was read."""
    text = pages.groupBy("document_id").agg(F.max(F.length(F.btrim("text"))).alias("most"))
    rows = text.join(fronts.select("document_id").distinct().withColumn("read", F.lit(True)), "document_id", "left")
    said = F.array(F.when(F.col("read").isNull(), "front_matter_not_read"), F.when(F.col("most") == 0, "no_text_layer"))
    return rows.select("document_id", F.explode(F.array_compact(said)).alias("note"))


# ------------------------------------------------------------------- provider


def check_specs(checked: DataFrame) -> DataFrame:
    """The provider's verdict on a printed DOI (document_id, doi, verdict) as a proposal of its own."""
    names = ("classification", "confidence", "review", "priority", "status")
    held = F.create_map(*[x for level, v in VERDICTS.items() for x in (F.lit(level), F.struct(*[F.lit(a).cast("int" if n == "priority" else "string").alias(n) for n, a in zip(names, v, strict=True)]))])
    rows = checked.filter(F.col("verdict").isin(*VERDICTS)).withColumn("v", F.element_at(held, F.col("verdict")))
    return _spec(rows, field="doi", value=F.col("doi"), source="crossref", **{n: F.col("v")[n] for n in names})


def search_is_safe(level: Column, found: Column, checked: Column) -> Column:
    """A title search is safe where the record's authors are printed too."""
    return (level == "exact") & (checked >= 1) & (found >= F.least(F.lit(2), checked))


def work_specs(works: DataFrame) -> DataFrame:
    """Field proposals from a provider's record (document_id, verdict, WORK_FIELDS); values that do not normalise are dropped."""
    values = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("raw")) for n in WORK_FIELDS])
    rows = works.select("document_id", "verdict", F.explode(values).alias("f")).select("document_id", "verdict", "f.*").filter("raw IS NOT NULL AND raw <> ''")
    people = F.from_json("raw", AUTHORS)
    value = F.when(F.col("field") == "authors", F.when(F.size(people) > 0, F.to_json(people))).otherwise(normalise(F.col("field"), F.col("raw")))
    rows = rows.withColumn("value", value).filter("value IS NOT NULL")
    confidence = F.when(F.col("verdict") == "exact", "exact").when(F.col("verdict") == "strong", "high").otherwise("medium")
    return _spec(rows, source="crossref", confidence=confidence, review=F.when(F.col("verdict") == "exact", "safe").otherwise("required"), priority=25)


def accepted_stage(values: DataFrame, answers: DataFrame) -> DataFrame:
    """(document_id, doi, outcome) of asking a provider for each accepted DOI.

    ``answers``: (doi, document_id, verdict), the verdict null without an answer and
    ``no_match`` for an unknown DOI. Metadata is proposed for ``proposed`` and ``weak``.
    """
    rows = values.filter("field = 'doi'").select("document_id", F.col("value").alias("doi"), "accepted_by").join(answers, ["document_id", "doi"], "left")
    by_rule = F.startswith("accepted_by", F.lit("rule:"))
    outcome = (
        F.when(F.col("verdict").isNull(), "no_answer")
        .when(F.col("verdict") == "no_match", "unknown_to_provider")
        .when(F.col("verdict") == "contradicted", "contradicted")
        .when((F.col("verdict") == "weak") & by_rule, "weak")
        .otherwise("proposed")
    )
    return rows.select("document_id", "doi", outcome.alias("outcome"))


def provider_checks(candidates: DataFrame) -> DataFrame:
    """(document_id, doi, verdict) that earlier runs stored as evidence."""
    rows = candidates.filter("field = 'doi' AND source = 'crossref'")
    state = F.get_json_object("evidence", "$.state")
    return rows.select("document_id", F.col("value").alias("doi"), F.when(state == "no_match", "no_match").otherwise(F.coalesce(F.get_json_object("evidence", "$.verdict"), F.lit(""))).alias("verdict"))


def local_titles(candidates: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Distinct titles the file itself gives, decided or not."""
    rows = candidates.filter((F.col("field") == "title") & F.col("source").isin(*sources) & F.col("status").isin("proposed", "accepted", "stale"))
    return rows.select("document_id", "value").distinct()


def planned_requests(candidates: DataFrame, values: DataFrame, titles: DataFrame, cached: DataFrame) -> DataFrame:
    """(document_id, sends, value, cached): what an online run would ask, and whether the cache (key) has the answer.

    An accepted DOI, else the best printed DOIs, else the best title (``titles``: document_id, value) if it is long enough.
    """
    everyone = candidates.select("document_id").distinct()
    accepted = values.filter("field = 'doi'").select("document_id", "value").join(everyone, "document_id", "left_semi")
    open_ = candidates.filter("field = 'doi' AND status = 'proposed' AND classification IN ('own', 'ambiguous')").join(accepted, "document_id", "left_anti")
    order = Window.partitionBy("document_id").orderBy("priority", "confidence", "value")
    printed = open_.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= LOOKUPS).select("document_id", "value")
    named = titles.join(accepted, "document_id", "left_anti").join(printed, "document_id", "left_anti").filter(F.length(alnum_key(F.col("value"))) >= MIN_SEARCHABLE)
    rows = union([t.select("document_id", F.lit(sends).alias("sends"), v.alias("value")) for t, sends, v in ((accepted, "doi", F.col("value")), (printed, "doi", F.col("value")), (named, "title", clean(F.col("value"))))])
    key = F.concat_ws(":", "sends", F.when(F.col("sends") == "title", alnum_key(F.col("value"))).otherwise(F.col("value")))
    rows = rows.withColumn("key", key).join(cached.select("key").distinct().withColumn("held", F.lit(True)), "key", "left")
    return rows.select("document_id", "sends", "value", F.coalesce("held", F.lit(False)).alias("cached"))


# ------------------------------------------------------------------- selection


def targets(c) -> DataFrame:
    """Documents a resolver looks at: those whose canonical artifact is a PDF, with the path to read it at, or none where no root that holds it is online."""
    pdf = c.artifact.filter("content_kind = 'pdf'").select("artifact_id")
    rows = c.document_artifact.filter("canonical").join(pdf, "artifact_id", "left_semi").select("document_id", "artifact_id")
    online = c.root.filter("status = 'online'").select("root_id")
    places = c.location.filter("NOT ended AND state = 'active'").join(online, "root_id", "left_semi")
    paths = places.groupBy("artifact_id").agg(F.min_by(F.struct("root_id", "relative_path"), F.struct((-F.col("last_seen")).alias("seen"), "path_key")).alias("p"))
    return rows.join(paths, "artifact_id", "left").select("document_id", "artifact_id", "p.root_id", "p.relative_path")


def front_facts(wanted: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """(artifact_id, action) of reading front matter (artifact_id, path): cached, failed_before, read or unavailable, by what this reader's version has stored."""
    held = cache.filter(F.col("version") == version).select("artifact_id", "ok")
    rows = wanted.join(held, "artifact_id", "left")
    action = F.when(F.col("ok"), "cached").when(~F.col("ok"), "failed_before").when(F.col("path").isNull(), "unavailable").otherwise("read")
    return rows.select("artifact_id", action.alias("action"))
