"""How stored names read in an answer, and one sentence on an accepted value's history."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names read as; unknown names show as themselves.
SOURCES = {
    "pdf_text_doi": "a DOI printed in the document's text",
    "pdf_metadata_doi": "a DOI in the file's own metadata",
    "layout_title": "the title as laid out on page one",
    "pdf_xmp_title": "the file's XMP title",
    "pdf_info_title": "the file's Info title",
    "pdf_xmp_authors": "the file's XMP authors",
    "pdf_info_authors": "the file's Info authors",
    "isbn_text": "an ISBN printed in the text",
    "arxiv_text": "an arXiv identifier printed on page one",
    "filename_hint": "the file name",
    "crossref": "Crossref (a record for the DOI)",
    "crossref_title_search": "Crossref (a search by title)",
    "manual": "stated by a person",
}
ORIGINS = {"observed": "read from the file", "resolved": "returned by a provider", "inferred": "deduced from other values", "assigned": "stated by a person"}
BADGES = {"observed": "O", "resolved": "R", "inferred": "I", "assigned": "A"}
FIELDS = {
    "doi": "DOI", "title": "Title", "authors": "Authors", "year": "Year", "container": "Journal / book", "publisher": "Publisher",
    "type": "Type", "volume": "Volume", "issue": "Issue", "pages": "Pages", "isbn": "ISBN", "arxiv": "arXiv",
}


def label(names: dict[str, str], name: Column) -> Column:
    """The word for a name, or the name; null counts as empty."""
    name = F.coalesce(name, F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, chain(*names.items()))), name), name)


def provenance_sentence(accepted_by: Column, source: Column, origin: Column, locked: Column) -> Column:
    by = F.coalesce(F.nullif(accepted_by, F.lit("")), F.lit("unknown"))
    who = F.when(by == "user", "you").when(F.startswith(by, F.lit("rule:")), "a batch rule").otherwise(by)
    end = F.when(F.coalesce(locked, F.lit(False)), " Locked: no resolver may change it.").otherwise("")
    return F.concat(F.lit("Accepted by "), who, F.lit(", from "), label(SOURCES, source), F.lit(" ("), label(ORIGINS, origin), F.lit(")."), end)
