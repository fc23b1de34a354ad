"""File trees, page readers and plan files as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclake.functions import naming, text

# Fixed value: how much of a file's start decides its kind.
HEAD_BYTES = 4096
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:/*"
PAGE = "artifact_id string, status string, error string, pdf_page int, printed_label string, text string, images int"
ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("item", "root_id", "location_id", "artifact_id", "old_path", "new_path")])


def scan_tree(spark: SparkSession, root: str, case_sensitive: bool = True) -> DataFrame:
    """Regular files below a folder with identity, size, time and kind by content.

    Files are read by Spark's own reader, so any store it can open will do; the
    bytes are hashed where they are read and only the head is looked at twice.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(SCHEME, "/", root.rstrip("/")) + "/"
    path = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), SCHEME, "/")
    relative = F.substr(path, F.lit(len(base) + 1))
    head = F.substring(F.col("content"), 1, HEAD_BYTES)
    return files.select(
        relative.alias("relative_path"),
        naming.path_key(relative, case_sensitive).alias("path_key"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("artifact_id"),
        naming.content_kind(head, F.col("length")).alias("content_kind"),
        naming.extension_kind(relative).alias("extension_kind"),
    )


def read_pages(files: DataFrame) -> DataFrame:
    """One row a page of every file: text by form feeds, PDFs by PyMuPDF where it is installed.

    A file that cannot be opened gives one row with its error; a bad page is a
    row of its own and the others stay.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pymupdf
        except ImportError:
            pymupdf = None
        for batch in batches:
            rows = []
            for ident, content in zip(batch["artifact_id"], batch["content"], strict=True):
                if content[:1024].find(b"%PDF-") >= 0:
                    rows += _pdf_pages(pymupdf, ident, content)
                else:
                    try:
                        parts = content.decode("utf-8").split("\f")
                        rows += [(ident, "ok", None, i + 1, None, t, 0) for i, t in enumerate(parts)]
                    except UnicodeDecodeError as problem:
                        rows.append((ident, "failed", str(problem)[:200], None, None, None, None))
            yield pd.DataFrame(rows, columns=["artifact_id", "status", "error", "pdf_page", "printed_label", "text", "images"])

    rows = files.select("artifact_id", "content").mapInPandas(pages, PAGE)
    state = text.page_state(F.length(F.btrim("text")), F.coalesce("images", F.lit(0)), F.col("error").isNotNull())
    return rows.withColumn("text_state", state)


def _pdf_pages(pymupdf, ident: str, content: bytes) -> list[tuple]:
    if pymupdf is None:
        return [(ident, "failed", "no PDF reader is installed", None, None, None, None)]
    try:
        document = pymupdf.open(stream=content, filetype="pdf")
    except Exception as problem:
        return [(ident, "failed", str(problem)[:200], None, None, None, None)]
    rows = []
    for i in range(document.page_count):
        try:
            page = document[i]
            rows.append((ident, "ok", None, i + 1, page.get_label() or None, page.get_text(), len(page.get_images())))
        except Exception as problem:
            rows.append((ident, "partial", str(problem)[:200], i + 1, None, None, None))
    return rows


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan's items with the codes of what is wrong with each; fixed schema, never inferred."""
    items = spark.read.schema(ITEM).json(path)
    problems = naming.component_problems(F.coalesce("new_path", F.lit("")))
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"no_{c}")) for c in ITEM.names]), lambda p: p.isNotNull())
    return items.withColumn("problems", F.concat(missing, problems))


def import_legacy(files: DataFrame, artifacts: DataFrame, extracted: DataFrame) -> DataFrame:
    """What becomes of each record (path, sha, size) of an older index: one outcome each.

    Only known hashes of equal size are taken, each once, and never over text extracted here.
    """
    first = files.groupBy("sha").agg(F.min("path").alias("first"))
    rows = files.join(first, "sha", "left").join(artifacts.select(F.col("artifact_id").alias("sha"), F.col("size").alias("known")), "sha", "left")
    rows = rows.join(extracted.select(F.col("artifact_id").alias("sha"), F.col("source").alias("held")), "sha", "left")
    outcome = (
        F.when(F.col("sha").isNull() | ~F.lower("sha").rlike("^[0-9a-f]{64}$"), "bad_hash")
        .when(F.col("known").isNull(), "unknown_file")
        .when(F.col("known") != F.col("size"), "size_differs")
        .when(F.col("path") != F.col("first"), "duplicate")
        .when(F.col("held") == "native", "already_native")
        .when(F.col("held") == "imported", "already_imported")
        .otherwise("imported")
    )
    return rows.select("path", "sha", outcome.alias("outcome"))
