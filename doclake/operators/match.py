"""Checking a provider's record against a document's first pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.functions import exact
from doclake.functions.text import alnum_key, containment, is_printed
from doclake.operators.views import first_reason

# Thresholds of the verdict.
SAME_SIMILARITY, STRONG, WEAK, MAX_AUTHORS, MIN_FAMILY, YEAR_SLACK, EMBEDDED_EXTRA = 0.9, 0.85, 0.6, 6, 3, 1, 6


def verify(rows: DataFrame) -> DataFrame:
    """Rows (title, subtitle, authors, year, preprint, text, layout_title, ...) with ``level``.

    exact, strong, weak, contradicted or unverifiable; the layout title may be null.
    """
    key = alnum_key(F.col("text"))
    families = F.filter(F.transform(F.slice("authors", 1, MAX_AUTHORS), lambda a: alnum_key(a["family"])), lambda f: F.length(f) >= MIN_FAMILY)
    years = F.transform(F.regexp_extract_all("text", F.lit(r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?![0-9])"), 1), lambda y: y.cast("int"))
    rows = rows.withColumns({"found": F.size(F.filter(families, lambda f: F.contains(key, f))), "named": F.size(families)})
    rows = rows.withColumn("printed", F.coalesce(is_printed(F.col("title"), F.col("text")), F.lit(False)))
    rows = rows.withColumn("contained", F.coalesce(containment(F.col("title"), F.col("text")), F.lit(0.0)))
    conflict = (F.size(years) > 0) & F.col("year").isNotNull() & ~F.exists(years, lambda y: F.abs(y - F.col("year")) <= YEAR_SLACK)
    rows = rows.withColumn("conflict", F.coalesce(conflict, F.lit(False)))
    shown = alnum_key(F.col("layout_title"))
    same = F.lit(False)
    for candidate in (F.col("title"), F.concat_ws(" ", "title", "subtitle")):
        own = alnum_key(candidate)
        embedded = F.contains(shown, own) & (F.length(shown) - F.length(own) >= EMBEDDED_EXTRA)
        same = same | ((own != "") & ((own == shown) | (~embedded & (exact.similarity(candidate, F.col("layout_title")) >= SAME_SIMILARITY))))
    rows = rows.withColumn("same", F.when(F.col("layout_title").isNotNull() & F.col("title").isNotNull(), same))
    equal = F.col("printed") & F.coalesce("same", F.lit(True))
    backed = (F.col("found") >= 1) | ((F.col("named") == 0) & F.coalesce("same", F.lit(False)))
    level = (
        F.when(F.col("title").isNull() & (F.col("named") == 0), "unverifiable")
        .when(equal & backed & ~F.col("conflict"), "exact")
        .when((F.col("printed") | (F.col("contained") >= STRONG)) & (F.col("found") >= 1), "strong")
        .when((F.col("contained") >= WEAK) | (F.col("found") >= 2) | F.col("printed"), "weak")
        .otherwise("contradicted")
    )
    return rows.withColumn("level", level)


def choose(verified: DataFrame, by: str = "document_id") -> DataFrame:
    """The one exact match of a title search; published beats preprint, several are ambiguous."""
    exact_ = verified.filter("level = 'exact'").withColumn("rank", F.coalesce("preprint", F.lit(False)).cast("int"))
    best = exact_.groupBy(by).agg(F.min("rank").alias("rank"))
    pool = exact_.join(best, [by, "rank"]).groupBy(by).agg(F.countDistinct("doi").alias("n"), F.min("doi").alias("doi"))
    return pool.select(by, F.when(F.col("n") == 1, F.col("doi")).alias("doi"), (F.col("n") > 1).alias("ambiguous"))


def best_title(titles: DataFrame, priority: dict[str, int]) -> DataFrame:
    """(document_id, title) from the best source."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i in priority.items() for x in i]), F.col("source"))
    return first_reason(titles.select("document_id", "title", "source"), "document_id", F.coalesce(rank, F.lit(99)))
