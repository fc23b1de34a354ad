"""DOIs, ISBNs, arXiv ids, field values and references as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.text import alnum_key, clean

# Identifier patterns and field rules.
DOI = r"(?i)\b(10\.[0-9]{4,9}/[^\s\"<>\x00-\x1f\x7f­​-‍⁠﻿]+)"
DOI_PREFIX = r"(?i)^\s*(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)"
DOI_VALID = r"^10\.[0-9]{4,9}/\S+$"
TRAILING = ".,;:'\"”’‚„“‘…»"
MAX_DOI = 200
FIRST_DOI_TRAILING = ".,;:)]}'”’"
ARXIV = r"(?i)^(?:arxiv:)?([0-9]{4}\.[0-9]{4,5}|[a-z\-]+(?:\.[a-z]{2})?/[0-9]{7})(?:v[0-9]+)?$"
ISBN_IN_TEXT = r"(?i)isbn(?:-1[03])?:?\s*([0-9][0-9\- ]{8,16}[0-9Xx])"
ARXIV_IN_TEXT = r"(?i)arxiv:\s*([0-9]{4}\.[0-9]{4,5})"
MIN_YEAR, MAX_YEAR = 1400, 2100
FIELDS = ("doi", "title", "authors", "year", "container", "publisher", "type", "volume", "issue", "pages", "isbn", "arxiv")
TEXT_FIELDS = ("title", "container", "publisher")
AUTHORS = "array<struct<family:string,given:string,name:string>>"
BRACKETS = ((")", "("), ("]", "["), ("}", "{"))
#: What trimming can take off an end; each round takes a layer of punctuation and one unbalanced bracket at most.
CLOSERS = r"[)\]}>.,;:'\"”’‚„“‘…»]*$"


def find_doi(text: Column) -> Column:
    """First DOI with the sentence's punctuation trimmed; '' without one."""
    hit = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(10\.[0-9]{4,9}/[^\s\"<>]+)", 1)
    return F.rtrim(hit, F.lit(FIRST_DOI_TRAILING))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def normalise_doi(raw: Column) -> Column:
    """Canonical lower-case DOI, or null."""
    text = F.regexp_replace(F.btrim(F.coalesce(raw, F.lit(""))), DOI_PREFIX, "")

    def trim(acc: Column, _: Column) -> Column:
        drop = F.endswith(acc, F.lit(">"))
        for close, open_ in BRACKETS:
            drop = drop | (F.endswith(acc, F.lit(close)) & (_count(acc, open_) < _count(acc, close)))
        return F.rtrim(F.when(drop, F.substr(acc, F.lit(1), F.length(acc) - 1)).otherwise(acc), F.lit(TRAILING))

    # a fold with as many rounds as there are characters to take off, so it ends at the fixpoint
    rounds = F.sequence(F.lit(0), F.length(F.regexp_extract(text, CLOSERS, 0)))
    trimmed = F.aggregate(rounds, F.rtrim(text, F.lit(TRAILING)), trim, F.lower)
    return F.transform(F.array(trimmed), lambda t: F.when((F.length(t) <= MAX_DOI) & t.rlike(DOI_VALID), t))[0]


def find_dois(text: Column) -> Column:
    """All distinct canonical DOIs printed in a text, in order; a clear wrap at a line end is joined first."""
    joined = F.regexp_replace(
        F.coalesce(text, F.lit("")), r"(?i)(\b10\.[0-9]{4,9}/[^\s\"<>]*[.\-/_])\r?\n[ \t]*(?=[A-Za-z0-9._\-;:()/]*[0-9])(?=[A-Za-z0-9])", "$1"
    )
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(joined, F.lit(DOI), 1), normalise_doi), lambda d: d.isNotNull()))


def doi_url(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), doi)


def isbn_digits(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, r"[\s-]", ""))


def isbn_ok(digits: Column) -> Column:
    """Check digit of ISBN-10 or ISBN-13."""

    def weighted(n: int, weight) -> Column:
        total = F.lit(0)
        for i in range(n):
            char = F.substring(digits, i + 1, 1)
            value = F.when(char.isin("X", "x"), 10).otherwise(F.expr("0") + F.coalesce(char.try_cast("int"), F.lit(0)))
            total = total + value * weight(i)
        return total

    thirteen = digits.rlike("^[0-9]{13}$") & (weighted(13, lambda i: 1 if i % 2 == 0 else 3) % 10 == 0)
    ten = digits.rlike("^[0-9]{9}[0-9Xx]$") & (weighted(10, lambda i: 10 - i) % 11 == 0)
    return F.coalesce(thirteen | ten, F.lit(False))


def normalise(field: Column, raw: Column) -> Column:
    """The canonical stored text of a field's value, or null where it is none."""
    plain = F.btrim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    year = F.when(plain.rlike("^[0-9]{4}$") & plain.try_cast("int").between(MIN_YEAR, MAX_YEAR), plain)
    digits = isbn_digits(plain)
    arxiv = F.when(plain.rlike(ARXIV), F.lower(F.regexp_extract(plain, ARXIV, 1)))
    free = clean(raw)
    return (
        F.when(field == "doi", normalise_doi(plain))
        .when(field == "year", year)
        .when(field == "isbn", F.when(isbn_ok(digits), digits))
        .when(field == "arxiv", arxiv)
        .when(field.isin(*FIELDS), F.when(free != "", free))
    )


def parse_authors(raw: Column) -> Column:
    """``A; B`` as an array of people with a name only."""
    names = F.filter(F.transform(F.split(raw, ";"), lambda n: F.btrim(F.regexp_replace(n, r"\s+", " "))), lambda n: n != "")
    return F.transform(names, lambda n: F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), n.alias("name")))


def authors_display(people: Column) -> Column:
    """``Family, Given; Name``."""

    def one(p: Column) -> Column:
        full = F.when(p["given"].isNotNull() & (p["given"] != ""), F.concat(p["family"], F.lit(", "), p["given"])).otherwise(p["family"])
        return F.when(p["family"].isNotNull() & (p["family"] != ""), full).otherwise(F.coalesce(p["name"], F.lit("?")))

    return F.array_join(F.transform(people, one), "; ")


def agreement_key(field: Column, value: Column) -> Column:
    """What two proposals must share to agree."""
    return F.when(field.isin(*TEXT_FIELDS), alnum_key(value)).otherwise(value)


def split_authors(raw: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), r"\s*(?:;|&|\band\b)\s*"), lambda n: F.btrim(n))
    return F.filter(parts, plausible_author)


def plausible_author(name: Column) -> Column:
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]+", ""))
    return (letters >= 3) & (letters >= 0.6 * F.length(name))


def sha256_ok(text: Column) -> Column:
    return F.coalesce(F.lower(F.btrim(text)).rlike("^[0-9a-f]{64}$"), F.lit(False))


def uuid_hex_ok(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{32}$"), F.lit(False))


def reference_uri(scheme: str, kind: Column, ident: Column, page: Column, label: Column) -> Column:
    """``scheme://document|artifact/<id>[/page/N | /label/L]``."""
    encoded = F.replace(F.url_encode(label), F.lit("+"), F.lit("%20"))
    tail = F.when(page.isNotNull(), F.concat(F.lit("/page/"), page.cast("string"))).when(label.isNotNull(), F.concat(F.lit("/label/"), encoded)).otherwise("")
    return F.concat(F.lit(f"{scheme}://"), kind, F.lit("/"), ident, tail)


def parse_reference(scheme: str, uri: Column) -> Column:
    """struct(kind, id, page, label); null where the grammar is broken."""
    grammar = rf"^{scheme}://(?:(document)/([0-9a-f]{{32}})|(artifact)/([0-9a-f]{{64}}))(?:/page/([1-9][0-9]{{0,8}})|/label/([^/]+))?$"
    part = [F.regexp_extract(uri, grammar, i) for i in range(7)]
    label = F.when(part[6] != "", F.try_url_decode(part[6]))
    return F.when(
        uri.rlike(grammar),
        F.struct(
            F.concat(part[1], part[3]).alias("kind"),
            F.concat(part[2], part[4]).alias("id"),
            F.nullif(part[5], F.lit("")).cast("int").alias("page"),
            label.alias("label"),
        ),
    )
