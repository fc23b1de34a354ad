"""Line dedup by site-relative frequency.

Pages are grouped by host. A line is boilerplate of a host when the pages of
that host that contain it, divided by all pages of the host, exceed ``ratio``.
The ratio alone decides, on hosts of any size; only a line that one page holds
is no repetition (``REPEATED``). Boilerplate lines are dropped from every page
of that host; all other lines keep their order.

Lines are compared without white space at their ends, by MD5; blank lines are
never counted and never dropped.

Shapes at scale: each page contributes a line once, counts are combined per
map task before the shuffle, and what moves is 16-byte digests, not texts. A
host has at most (mean lines a page / ratio) boilerplate lines, so the list
that a page is filtered with stays small however many pages the host has. The
lists are written first, so the planner knows their size: it broadcasts them
only under its own threshold and otherwise joins on the host, where AQE may
split a hot host. Texts are read twice and not grouped.

Edge cases: a null text stays null, an empty one empty, with 0 lines; null
hosts form a host of their own; pages that repeat (id and all) count as pages
of their own; a page of which every line goes keeps its row with an empty text;
an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.session import cut

RATIO = 0.2
#: A line has to occur on this many pages to be repeated at all.
REPEATED = 2
BLANKS = " \t\r\x0b\x0c"


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO) -> DataFrame:
    """(host, digests): the lines that each host repeats."""
    pages = pages.select(host.alias("host"), text.alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.array_distinct(F.transform(_split(F.col("text")), lambda x: F.btrim(x, F.lit(BLANKS))))
    counts = (
        pages.select("host", F.explode(lines).alias("line"))
        .filter(F.col("line") != "")
        .select("host", _digest(F.col("line")).alias("digest"))
        .groupBy("host", "digest")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= REPEATED)
    )
    return (
        counts.join(totals.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host")))
        .filter(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("digest").alias("digests"))
    )


def drop_lines(pages: DataFrame, host: Column, text_col: str, ratio: float = RATIO) -> DataFrame:
    """The rows of ``pages`` in struct ``page``, with kept_text, n_lines and n_dropped."""
    text = F.col(f"`{text_col}`")
    lists = cut(boilerplate(pages, host, text, ratio), "boilerplate").select(F.col("host").alias("__host"), "digests")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), host.alias("host"), text.alias("text"))
    rows = rows.join(lists, F.col("host").eqNullSafe(F.col("__host")), "left")
    lines = _split(F.col("text"))

    def blank(x: Column) -> Column:
        return F.btrim(x, F.lit(BLANKS)) == ""

    kept = F.when(F.col("digests").isNull(), lines).otherwise(
        F.filter(lines, lambda x: blank(x) | ~F.array_contains(F.col("digests"), _digest(F.btrim(x, F.lit(BLANKS)))))
    )
    return rows.select("page", "host", "text", lines.alias("lines"), kept.alias("kept")).select(
        "page",
        "host",
        F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("kept_text"),
        F.size(F.filter("lines", lambda x: ~blank(x))).cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


#: Blocks end a line; what is inside script, style and comments is no text.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<head\b.*?</head\s*>"
BLOCKS = r"(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|main|aside|table|tr|td|th|h[1-6]|br|hr|pre|body|html|title)\b[^>]*>"
TAGS = r"<[a-zA-Z/!][^>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def page_text(html: Column) -> Column:
    """The visible text of a page, one block a line."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(text, BLOCKS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(text, r"[ \t\r\x0B\x0C]*\n\s*", "\n"), F.lit(BLANKS + "\n"))


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host_of(F.col("url")).alias("site"), page_text(F.col("html")).alias("text"))
    pages = cut(pages, "page_text")  # read twice: the patterns over the HTML run once
    return drop_lines(pages, F.col("site"), "text").select("page.page_id", "host", "n_lines", "n_dropped", F.col("kept_text").alias("text"))


def _page_text_sql(html: str) -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    text = f"regexp_replace({html}, {quoted(HIDDEN)}, '', 'g')"
    text = f"regexp_replace({text}, {quoted(BLOCKS)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {quoted(TAGS)}, '', 'g')"
    for name, char in ENTITIES:
        text = f"replace({text}, {quoted(name)}, {quoted(char)})"
    return rf"trim(regexp_replace({text}, '[ \t\r\x0B\x0C]*\n\s*', chr(10), 'g'), {_BLANKS_SQL} || chr(10))"


_BLANKS_SQL = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
SQL = f"""
WITH p AS (SELECT page_id, row_number() OVER () AS r, lower(regexp_extract(url, '{HOST}', 1)) AS host, {_page_text_sql("html")} AS text FROM pages),
l AS (SELECT r, host, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
k AS (SELECT *, trim(raw, {_BLANKS_SQL}) AS line FROM l),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (
  SELECT k.host, line FROM k JOIN t ON k.host IS NOT DISTINCT FROM t.host WHERE line <> ''
  GROUP BY k.host, line, pages HAVING count(DISTINCT r) >= {REPEATED} AND count(DISTINCT r) > {RATIO}::DOUBLE * pages),
m AS (
  SELECT k.*, b.line IS NOT NULL AS gone FROM k LEFT JOIN b ON b.host IS NOT DISTINCT FROM k.host AND b.line = k.line),
a AS (
  SELECT r, string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE line <> '') AS n_lines,
         count(*) FILTER (WHERE gone) AS n_dropped FROM m GROUP BY r)
SELECT page_id, host, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text
FROM p LEFT JOIN a USING (r)
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": SQL}
