"""Front matter: the title as laid out on page one, and what an XMP packet claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions.text import alnum_key, clean, join_lines

# Sizes, zones and patterns that decide what is a title.
SIZE_RATIO, SIZE_MARGIN, GROUP_GAP, SAME_SIZE = 1.2, 1.5, 2.2, 0.75
TITLE_ZONE, HEADER_BAND, FOOTER_BAND, MIN_TITLE_KEY, PAGE_HEIGHT = 0.7, 0.2, 0.9, 12, 842.0
BANNER = (
    r"(?i)^(?:research\s+article|review\s+article|article|review|letter|letters|communication|communications|note|perspective|paper|open\s+access"
    r"|short\s+communication|original\s+article|original\s+paper|full\s+paper|special\s+issue|editorial|regular\s+article|feature\s+article"
    r"|critical\s+review|mini[- ]review|accounts?|case\s+reports?|brief\s+reports?|short\s+reports?|technical\s+notes?|original\s+research"
    r"|original\s+contribution|original\s+investigation|research\s+paper|data\s+paper|software)$"
)
NOT_A_TITLE = r"(?i)https?://|www\.|@|doi\.org|©|\ball\s+rights\s+reserved\b"
CONTENTS_ENTRY = r"\.{4,}|(?:\s\.){4,}|^\s*[0-9]+(?:\.[0-9]+)+\s"


def body_size(lines: DataFrame) -> DataFrame:
    """(artifact_id, body): the font size below which half of the characters lie."""
    weight = F.greatest(F.lit(1), F.length("t"))
    sizes = lines.groupBy("artifact_id", "s").agg(F.sum(weight).alias("w"))
    group = Window.partitionBy("artifact_id")
    sizes = sizes.withColumn("run", F.sum("w").over(group.orderBy("s"))).withColumn("all", F.sum("w").over(group))
    return sizes.filter(F.col("run") >= F.col("all") / 2).groupBy("artifact_id").agg(F.min("s").alias("body"))


def layout_titles(lines: DataFrame) -> DataFrame:
    """(artifact_id, title, size, body, lines) of the largest title-sized group on page one.

    ``lines``: artifact_id, i (order), p (page), t (text), s (font size), y,
    height (of the page; null: A4). Mastheads that page two repeats in its
    bands, banners and contents entries are no titles. Partitions are the few
    lines of one artifact's first two pages.
    """
    rows = lines.withColumn("height", F.coalesce("height", F.lit(PAGE_HEIGHT)))
    first = rows.filter((F.col("p") == 1) & (F.btrim("t") != ""))
    band = (F.col("p") == 2) & ((F.col("y") < HEADER_BAND * F.col("height")) | (F.col("y") > FOOTER_BAND * F.col("height")))
    ordered = F.array_sort(F.collect_list(F.struct("i", "t")))
    repeated = rows.filter(band).groupBy("artifact_id").agg(alnum_key(F.array_join(ordered["t"], " ")).alias("repeated"))

    big = F.col("s") >= F.greatest(F.col("body") * SIZE_RATIO, F.col("body") + SIZE_MARGIN)
    sized = first.join(body_size(first), "artifact_id")
    sized = sized.filter(big & (F.col("y") < TITLE_ZONE * F.col("height")) & ~F.col("t").rlike(NOT_A_TITLE) & (F.length(alnum_key(F.col("t"))) >= 3))
    order = Window.partitionBy("artifact_id").orderBy("y", "i")
    far = (F.abs(F.col("s") - F.lag("s").over(order)) > SAME_SIZE) | (F.col("y") - F.lag("y").over(order) > GROUP_GAP * F.lag("s").over(order))
    sized = sized.withColumn("far", F.coalesce(far, F.lit(True)).cast("int"))
    sized = sized.withColumn("group", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    text = F.struct("y", "i", F.btrim("t").alias("t"))
    groups = sized.filter(~F.btrim("t").rlike(BANNER)).groupBy("artifact_id", "group").agg(
        F.array_sort(F.collect_list(text)).alias("parts"), F.max("s").alias("size"), F.min("y").alias("top"), F.first("body").alias("body")
    )
    groups = groups.withColumn("title", F.regexp_replace(join_lines(F.col("parts")["t"]), r"\s+", " ")).join(repeated, "artifact_id", "left")
    key = alnum_key(F.col("title"))
    masthead = F.coalesce((F.col("repeated") != "") & F.contains("repeated", key), F.lit(False))
    groups = groups.filter((F.length(key) >= MIN_TITLE_KEY) & ~F.col("title").rlike(BANNER) & ~F.col("title").rlike(CONTENTS_ENTRY) & ~masthead)
    rank = F.struct((F.bround(F.col("size") * 2) / 2).alias("r"), (-F.col("top")).alias("y"), (-F.col("group")).alias("g"))
    best = groups.groupBy("artifact_id").agg(F.max_by(F.struct("title", "size", "body", F.size("parts").alias("lines")), rank).alias("m"))
    return best.select("artifact_id", "m.*")


def _plain(block: Column) -> Column:
    return clean(F.regexp_replace(block, "<[^>]{1,200}>", " "))


def xmp_fields(xmp: Column) -> Column:
    """struct(title, authors, dois) by pattern; the packet is untrusted and never parsed as XML."""
    packet, item = F.coalesce(xmp, F.lit("")), r"(?is)<rdf:li\b[^>]*>(.*?)</rdf:li>"

    def block(name: str) -> str:
        return rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"

    held = F.regexp_extract(packet, block("dc:title"), 1)
    title = _plain(F.when(held.rlike(item), F.regexp_extract(held, item, 1)).otherwise(held))
    names = F.transform(F.regexp_extract_all(F.regexp_extract(packet, block("dc:creator"), 1), F.lit(item), 1), _plain)
    stated = F.regexp_extract_all(packet, F.lit(r"(?is)<(?:prism|pdfx):doi\b[^>]*>(.*?)</(?:prism|pdfx):doi>"), 1)
    named = F.filter(F.regexp_extract_all(packet, F.lit(block("dc:identifier")), 1), lambda d: F.contains(d, F.lit("10.")))
    return F.struct(F.nullif(title, F.lit("")).alias("title"), F.filter(names, lambda n: n != "").alias("authors"), F.concat(stated, named).alias("dois"))
