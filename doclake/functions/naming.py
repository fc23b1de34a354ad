"""File-name policy and path keys as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name limits, device names, characters and extension tables.
MAX_STEM, MAX_COMPONENT = 120, 200
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{n}" for n in range(1, 10)), *(f"LPT{n}" for n in range(1, 10)), "COM¹", "COM²", "COM³", "LPT¹", "LPT²", "LPT³"]
UNKNOWN_YEAR = "unknown-year"
EXTENSIONS = {
    "pdf": "pdf", "epub": "epub", "docx": "word_document", "doc": "word_document", "rtf": "word_document", "odt": "word_document", "txt": "text",
    "md": "text", "csv": "text", "tsv": "text", "json": "text", "xml": "text", "html": "text", "htm": "text", "log": "text", "ini": "text",
    "toml": "text", "yaml": "text", "yml": "text", "xls": "spreadsheet", "xlsx": "spreadsheet", "ods": "spreadsheet", "xyz": "chemistry_data",
    "mol": "chemistry_data", "sdf": "chemistry_data", "cif": "chemistry_data", "pdb": "chemistry_data", "mol2": "chemistry_data",
    "smi": "chemistry_data", "zip": "archive", "rar": "archive", "7z": "archive", "tar": "archive", "gz": "archive", "png": "image", "jpg": "image",
    "jpeg": "image", "gif": "image", "bmp": "image", "tif": "image", "tiff": "image", "py": "code", "ipynb": "code", "js": "code", "mdb": "database",
    "accdb": "database", "sqlite": "database",
}
COMPATIBLE = {
    "pdf": ["pdf"],
    "epub": ["zip_container"],
    "word_document": ["zip_container", "ole_container", "word_document", "text"],
    "spreadsheet": ["zip_container", "ole_container", "text"],
    "text": ["text"],
    "chemistry_data": ["text"],
    "archive": ["archive", "zip_container"],
    "image": ["image"],
    "code": ["text"],
    "database": ["database", "ole_container"],
}
MAGIC = (
    (b"%PDF-", "pdf"),
    (b"PK\x03\x04", "zip_container"),
    (b"\x89PNG\r\n\x1a\n", "image"),
    (b"\xff\xd8\xff", "image"),
    (b"GIF8", "image"),
    (b"Rar!", "archive"),
    (b"7z\xbc\xaf\x27\x1c", "archive"),
    (b"SQLite format 3\x00", "database"),
    (b"{\\rtf", "word_document"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole_container"),
)
ACCESS_DB = b"\x00\x01\x00\x00Standard"
PDF_WINDOW = 1024


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]), key)


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension_of(path: Column) -> Column:
    name = F.regexp_replace(base_name(path), r"^\.+", "")
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def stem_of(path: Column) -> Column:
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def extension_kind(path: Column) -> Column:
    return F.coalesce(_lookup(EXTENSIONS, extension_of(path)), F.lit("other"))


def kinds_disagree(path: Column, content: Column) -> Column:
    """The extension's claim against the observed kind, normal pairs aside."""
    allowed = _lookup({k: F.array(*[F.lit(x) for x in v]) for k, v in COMPATIBLE.items()}, extension_kind(path))
    return F.coalesce((content != "empty") & ~F.array_contains(allowed, content), F.lit(False))


def content_kind(head: Column, size: Column) -> Column:
    """Kind by magic bytes, then by a text test: valid UTF-8 without NUL bytes."""
    out = F.when(size == 0, "empty")
    for magic, kind in MAGIC:
        out = out.when(F.startswith(head, F.lit(magic)), kind)
    out = out.when(F.contains(F.substring(head, 1, PDF_WINDOW), F.lit(b"%PDF-")), "pdf")
    out = out.when(F.substring(head, 1, len(ACCESS_DB)) == F.lit(ACCESS_DB), "database")
    text = ~F.contains(head, F.lit(b"\x00")) & F.is_valid_utf8(head.cast("string"))
    return out.when(text, "text").otherwise("binary")


def clean_component(text: Column) -> Column:
    """One path component's worth of text, valid on every platform."""
    out = F.coalesce(text, F.lit(""))
    for char in ":/\\|":
        out = F.replace(out, F.lit(char), F.lit(" - "))
    out = F.translate(out, '"<>?*', "'")
    out = F.regexp_replace(F.regexp_replace(out, r"[\s\p{Z}]", " "), r"\p{C}", "")
    return F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" ."))


def avoid_reserved(stem: Column) -> Column:
    head = F.substring_index(stem, ".", 1)
    rest = F.substr(stem, F.length(head) + 1)
    return F.when(F.upper(head).isin(*RESERVED), F.concat(head, F.lit("_"), rest)).otherwise(stem)


def shorten(stem: Column, limit: int = MAX_STEM) -> Column:
    tag = F.substring(F.sha2(stem.cast("binary"), 256), 1, 8)
    return F.when(F.length(stem) <= limit, stem).otherwise(F.concat(F.rtrim(F.substring(stem, 1, limit - 9), F.lit(" .")), F.lit("~"), tag))


def lead_author(people: Column) -> Column:
    """First family name, with `et al.` if there are more; '' without one."""

    def family(p: Column) -> Column:
        return F.coalesce(F.nullif(p["family"], F.lit("")), F.substring_index(F.nullif(p["name"], F.lit("")), ",", 1))

    names = F.filter(F.transform(F.coalesce(people, F.array()), family), lambda n: n.isNotNull())
    first = clean_component(F.get(names, F.lit(0)))
    return F.when((first != "") & (F.size(names) > 1), F.concat(first, F.lit(" et al."))).otherwise(first)


def stem_for(title: Column, people: Column, year: Column) -> Column:
    """``Lead (year) - Title``; null without a title."""
    part = clean_component(title)
    year_part = F.when(year.rlike("^[0-9]{4}$"), F.concat(F.lit("("), year, F.lit(")"))).otherwise("")
    head = F.array_join(F.filter(F.array(lead_author(people), year_part), lambda x: x != ""), " ")
    stem = F.when(head != "", F.concat(head, F.lit(" - "), part)).otherwise(part)
    return F.when(part != "", avoid_reserved(shorten(F.btrim(stem, F.lit(" .")))))


def name_for(title: Column, people: Column, year: Column, extension: Column) -> Column:
    ext = F.when(extension.rlike(r"^\.[A-Za-z0-9]{1,10}$"), F.lower(extension)).otherwise("")
    return F.concat(stem_for(title, people, year), ext)


def year_directory(year: Column) -> Column:
    return F.when(year.rlike("^[0-9]{4}$"), year).otherwise(UNKNOWN_YEAR)


def collision_key(path: Column) -> Column:
    return F.lower(path)


def component_problems(path: Column) -> Column:
    """Codes of what forbids a relative path as a destination; empty if it is fine."""

    def problem(part: Column) -> Column:
        return (
            F.when(part.isin("", ".", ".."), "not_allowed")
            .when(F.contains(part, F.lit(":")), "colon")
            .when(part.rlike(r"^ |[ .]$"), "dot_or_space_at_end")
            .when(part.rlike(r"\p{C}"), "control_character")
            .when(part.rlike(r'[<>"|?*]'), "forbidden_character")
            .when(F.upper(F.substring_index(part, ".", 1)).isin(*RESERVED), "reserved_name")
            .when(F.length(part) > MAX_COMPONENT, "too_long")
        )

    whole = F.when((path == "") | F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\\")), "not_relative")
    parts = F.transform(F.split(path, "/"), problem)
    return F.filter(F.concat(F.array(whole), parts), lambda p: p.isNotNull())


def path_key(path: Column, case_sensitive: bool) -> Column:
    return path if case_sensitive else F.lower(path)


def within(path: Column, directory: Column) -> Column:
    """The directory itself or below it; '' holds everything."""
    return (directory == "") | (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))
