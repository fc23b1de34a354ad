"""Document filters, scopes and search coverage over the catalog's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.identifiers import AUTHORS, normalise_doi
from doclake.functions.text import alnum_key, name_key
from doclake.operators.search import QueryError, year_bounds


def available(document_artifact: DataFrame, location: DataFrame, root: DataFrame) -> DataFrame:
    """Documents with a current, active location under an online root."""
    online = location.filter("NOT ended AND state = 'active'").join(root.filter("status = 'online'").select("root_id"), "root_id", "left_semi")
    return document_artifact.join(online.select("artifact_id"), "artifact_id", "left_semi").select("document_id").distinct()


def filtered(catalog, filters: tuple[tuple[str, str], ...]) -> DataFrame:
    """Live documents that satisfy every filter: a chain of semi-joins."""
    docs = catalog.live.select("document_id")
    for name, value in filters:
        docs = docs.join(_matching(catalog, name, value), "document_id", "left_semi")
    return docs


def _matching(catalog, name: str, value: str) -> DataFrame:
    values = catalog.metadata_value
    if name == "tag":
        return catalog.document_tag.filter(F.col("tag_key") == name_key(F.lit(value))).select("document_id")
    if name == "collection":
        wanted = catalog.collection.filter(~F.col("retired") & ((name_key(F.col("name")) == name_key(F.lit(value))) | F.startswith("collection_id", F.lit(value))))
        return catalog.collection_member.join(wanted, "collection_id", "left_semi").select("document_id")
    if name == "doi":
        return values.filter((F.col("field") == "doi") & (F.col("value") == normalise_doi(F.lit(value)))).select("document_id")
    if name == "year":
        low, high = year_bounds(value)
        return values.filter((F.col("field") == "year") & F.col("value").try_cast("int").between(low, high)).select("document_id")
    if name == "author":
        return values.filter((F.col("field") == "authors") & has_author(F.col("value"), F.lit(value))).select("document_id")
    if name == "kind":
        kind = value.strip().lower()
        by_bytes = catalog.document_artifact.join(catalog.artifact.filter(F.lower("content_kind") == kind), "artifact_id", "left_semi")
        by_type = values.filter((F.col("field") == "type") & (F.lower("value") == kind))
        return by_bytes.select("document_id").union(by_type.select("document_id")).distinct()
    raise QueryError(f"unknown filter {name!r}")


def has_author(authors: Column, wanted: Column) -> Column:
    """Substring of any person's family, given and full name, by letters and digits."""
    people = F.from_json(authors, AUTHORS)
    key = alnum_key(wanted)
    name = lambda p: alnum_key(F.concat_ws(" ", p["family"], p["given"], p["name"]))
    return F.coalesce((key != "") & F.exists(people, lambda p: F.contains(name(p), key)), F.lit(False))


def path_scope(location: DataFrame, needle: str) -> DataFrame:
    """Artifacts with any location, ended ones too, whose path contains the text."""
    wanted = needle.lower().replace("\\", "/")
    return location.filter(F.contains(F.lower("relative_path"), F.lit(wanted))).select("artifact_id").distinct()


def all_words(haystack: Column, typed: Column) -> Column:
    """Every typed word occurs somewhere in the row."""
    return F.forall(F.filter(F.split(F.lower(typed), r"\s+"), lambda w: w != ""), lambda w: F.contains(F.lower(haystack), w))


def coverage(artifact: DataFrame, extraction: DataFrame, page: DataFrame, matching: DataFrame | None = None) -> DataFrame:
    """One row: what a search over this library can and cannot see; with the documents that a query's filters left (``matching``), how many those are."""
    text = page.groupBy("artifact_id").agg(F.max("chars").alias("most"))
    rows = artifact.select("artifact_id", "content_kind").join(extraction.select("artifact_id", "status", F.col("source").alias("origin")), "artifact_id", "left")
    rows = rows.join(text, "artifact_id", "left")
    pdf = F.col("content_kind") == "pdf"
    done = pdf & F.col("status").isNotNull()
    seen = done & (F.col("status") != "failed")
    counted = rows.agg(
        F.count_if(pdf).alias("pdf_documents"),
        F.count_if(seen).alias("searchable"),
        F.count_if(seen & (F.col("status") == "partial")).alias("partially_indexed"),
        F.count_if(seen & (F.col("origin") == "imported")).alias("provisional_imported"),
        F.count_if(done & (F.col("status") == "failed")).alias("extraction_failed"),
        (F.count_if(pdf) - F.count_if(done)).alias("not_yet_extracted"),
        F.count_if(seen & (F.coalesce("most", F.lit(0)) == 0)).alias("no_text_layer"),
        F.count_if(~pdf).alias("other_files_not_searchable"),
    )
    return counted if matching is None else counted.crossJoin(matching.agg(F.count(F.lit(1)).alias("documents_matching")))  # one row on the right
