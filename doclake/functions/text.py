"""Folding, keys and title rules as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, word lists and patterns that decide answers.
MIN_DECISIVE_LENGTH = 20
GARBLED_RUN = 4
SCANNED_CHARS_PER_PAGE = 100
NATIVE_TEXT_MIN_CHARS = 50
STOP_WORDS = (
    "the and for with from that this are was were into onto over under between among about via their its our "
    "using use used based study studies analysis new one two"
).split()
JUNK_FRAGMENTS = (
    "microsoft word", "microsoft powerpoint", "microsoft excel", "untitled", "document1", "adobe acrobat",
    "pdf document", "powerpoint presentation", "scanned by", "camscanner", "acrobat distiller", "tex output",
    "latex with hyperref", "title goes here", "paper title", "no title", "default title", "unknown",
)
JUNK_EXTENSION = r"(?i)\.(?:docx?|pdf|tex|dvi|ps|indd|qxd|rtf|txt|pmd|odt)\s*$"
LOOKS_LIKE_ID = r"(?i)^(?:[a-z]{0,6}[0-9][\p{L}\p{N}_.\-]*|[0-9.\-_/ ]+|10\.[0-9]{4,9}/\S+|[0-9a-f]{16,})$"
IDENTIFIER_PREFIX = r"(?i)^\s*(?:(?:doi|pii|isbn|issn|arxiv|url)\b\s*:?\s*\S*[0-9]|https?://|www\.)"
IDENTIFIER_INSIDE = r"\b10\.[0-9]{4,9}/\S|\bS[0-9]{4}-[0-9]{3}[0-9X]"
CORRECTION = r"(?i)^[^\p{L}\p{N}_]*(?:correction|corrigendum|corrigenda|erratum|errata|addendum|retraction|comment|reply|response)\b"
SUPPLEMENT_TEXT = (
    r"(?i)\b(supporting\s+information|supplementary\s+(?:material|information|data|file|materials)"
    r"|supplemental\s+(?:material|information|data)|electronic\s+supplementary\s+material|online\s+supplement)\b"
)
SUPPLEMENT_NAME = r"(?i)(?:^|[\s_\-.])(?:si|supp|suppl|supplement|supplementary|supporting|esi|moesm[0-9]*)(?:$|[\s_\-.0-9])"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _latin_folds() -> tuple[str, str]:
    """Accented Latin letters and the single letters they decompose to, by rule."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _latin_folds()


def search_fold(text: Column) -> Column:
    """Case folded, Latin accents stripped; the sharp s and ligatures stay, as the index keeps them."""
    return F.translate(F.lower(text), _FROM, _TO)


def key_fold(text: Column) -> Column:
    """As ``search_fold``, with the sharp s written out, for keys that compare titles."""
    return F.replace(search_fold(text), F.lit("ß"), F.lit("ss"))


def alnum_key(text: Column) -> Column:
    """Letters and digits only, folded."""
    return F.regexp_replace(key_fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def column_key(name: str) -> Column:
    """``alnum_key`` of a column; what is all ASCII needs no folds but case."""
    text = F.coalesce(name, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")).otherwise(alnum_key(F.col(name)))


def terms(text: Column) -> Column:
    """The index's tokens: runs of letters and digits, folded, in order."""
    return F.regexp_extract_all(search_fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def tokens(text: Column) -> Column:
    """Distinct title words in first-seen order: three letters or two digits at least, no stop words."""
    words = F.regexp_extract_all(key_fold(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}{3,}|[0-9]{2,}"), 0)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)))


def clean(text: Column) -> Column:
    """Tags out, entities decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]{1,200}>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(out, r"[\s ]+", " "))


def is_printed(title: Column, text: Column) -> Column:
    return key_is_printed(alnum_key(title), alnum_key(text))


def key_is_printed(key: Column, text_key: Column) -> Column:
    """As ``is_printed``, of keys made already."""
    return (F.length(key) >= MIN_DECISIVE_LENGTH) & F.contains(text_key, key)


def containment(title: Column, text: Column) -> Column:
    """Share of the title's words found in the text; 0.0 without usable words."""
    wanted = tokens(title)
    found = F.size(F.array_intersect(wanted, tokens(text)))
    return F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(0.0)


def is_junk_title(title: Column, stem: Column | None = None) -> Column:
    text = clean(title)
    lowered = F.lower(text)
    fragment = F.lit(False)
    for junk in JUNK_FRAGMENTS:
        fragment = fragment | F.contains(lowered, F.lit(junk))
    out = (
        (F.length(alnum_key(text)) < 6)
        | fragment
        | text.rlike(JUNK_EXTENSION)
        | (text.rlike(LOOKS_LIKE_ID) & ~F.contains(text, F.lit(" ")))
        | text.rlike(IDENTIFIER_PREFIX)
        | text.rlike(IDENTIFIER_INSIDE)
    )
    if stem is not None:
        out = out | F.coalesce((stem != "") & (alnum_key(stem) == alnum_key(text)), F.lit(False))
    return out


def looks_garbled(text: Column) -> Column:
    """A run of four one-character words: letter-spaced print."""
    run = r"(?:^|\s)(?:[\p{L}\p{N}]\s+){" + str(GARBLED_RUN - 1) + r"}[\p{L}\p{N}](?:\s|$)"
    return F.coalesce(text, F.lit("")).rlike(run)


def filename_title_hint(stem: Column) -> Column:
    """The spaced name when it reads like a title, else null."""
    spaced = F.btrim(F.regexp_replace(F.regexp_replace(stem, r"[_\-+.]+", " "), r"\s+", " "))
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    alphabetic = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}{2,}$")))
    return F.when((alphabetic >= 3) & (alphabetic >= 0.7 * F.size(words)), spaced)


AUTHOR_YEAR = r"^(\p{L}{3,}?)[ _\-]*((?:19|20)[0-9]{2})[A-Za-z]?(?:[ _\-].*)?$"


def filename_author_year(stem: Column) -> tuple[Column, Column]:
    """(author, year) of names such as ``kaya2022``; nulls without a match."""
    name = F.btrim(stem)
    hit = name.rlike(AUTHOR_YEAR)
    return (
        F.when(hit, F.lower(F.regexp_extract(name, AUTHOR_YEAR, 1))),
        F.when(hit, F.regexp_extract(name, AUTHOR_YEAR, 2).cast("int")),
    )


def is_correction(title: Column, first_text: Column) -> Column:
    start = F.substring(F.coalesce(first_text, F.lit("")), 1, 200)
    return F.coalesce(title, F.lit("")).rlike(CORRECTION) | start.rlike(CORRECTION)


def supplement_says_so(first_text: Column) -> Column:
    return F.substring(F.coalesce(first_text, F.lit("")), 1, 1500).rlike(SUPPLEMENT_TEXT)


def supplement_name_hint(stem: Column) -> Column:
    return F.coalesce(stem, F.lit("")).rlike(SUPPLEMENT_NAME)


def is_scanned(chars: Column, pages: Column) -> Column:
    return (pages > 0) & (chars < SCANNED_CHARS_PER_PAGE * pages)


def page_state(chars: Column, images: Column, error: Column) -> Column:
    return (
        F.when(error, "failed")
        .when(chars >= NATIVE_TEXT_MIN_CHARS, "text_native")
        .when(chars > 0, "text_sparse")
        .when(images > 0, "image_only")
        .otherwise("blank")
    )


def imported_page_state(chars: Column) -> Column:
    return F.when(chars >= NATIVE_TEXT_MIN_CHARS, "text_native").when(chars > 0, "text_sparse").otherwise("unknown")


def evidence_key(*parts: Column) -> Column:
    """First 20 hex digits of SHA-256 over the parts joined by U+001F."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 256), 1, 20)


def fingerprint_text(text: Column) -> Column:
    """Case folded (accents stay), letters and digits only: what a text fingerprint hashes."""
    folded = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]+", "")


def name_key(text: Column) -> Column:
    """Key of a tag or collection name: folded case, single spaces, punctuation kept; null outside 1..200."""
    key = F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(F.length(key).between(1, 200), key)


def excerpt(text: Column, needle: Column, around: int = 80) -> Column:
    """The needle's first place with its surroundings, white space collapsed; null if absent."""
    at = F.locate_col(needle, text) if hasattr(F, "locate_col") else F.position(needle, text)
    low = F.greatest(F.lit(1), at - around)
    part = F.substr(text, low, at + F.length(needle) + around - low)
    return F.when(at > 0, F.btrim(F.regexp_replace(part, r"\s+", " ")))


def join_lines(lines: Column) -> Column:
    """Lines of one title: a hyphen before a small letter joins the word, else a space does."""

    def join(acc: Column, part: Column) -> Column:
        word = F.endswith(acc, F.lit("-")) & part.rlike(r"^\p{Ll}")
        return F.when(acc == "", part).when(word, F.concat(acc.substr(F.lit(1), F.length(acc) - 1), part)).otherwise(F.concat(acc, F.lit(" "), part))

    return F.btrim(F.aggregate(lines, F.lit(""), join))
