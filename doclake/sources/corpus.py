"""A document catalog derived from the ``documents`` table.

The driver's tables hold no files, so the catalog's tables (roots, locations,
artifacts, documents, pages, extractions, metadata, proposals, tags,
collections, relations, runs) follow from each row by fixed rules. What costs a
pass over the texts (hashes, titles, pages) is written to the shared folder once
a session, as a real catalog would hold it, and read from there by every query;
the rest are lazy DataFrames over those tables. A changed input file makes new
ones. ``plans/corpus_sql.py`` states the same rules in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions.text import evidence_key
from doclake.session import cut, once, stamp

FIELD_OF = ("title", "title", "doi", "year")
SOURCE_OF = ("pdf_layout", "pdf_info", "pdf_text_doi", "provider")
CONFIDENCES = ("exact", "high", "medium", "low", "ambiguous")
STATUSES = ("accepted", "rejected", "stale", "set_aside", "proposed", "proposed", "proposed")
KINDS = ("part_of", "supplement_of", "version_of", "related_to")
PAGES = 1 << 32  # page ids of a document
MERGED, CHAINED, RING = (120, 170), (0, 100), (100, 119)  # numbers of documents in the long merge chain, the long part chain and the ring
EXTENSIONS = ("pdf", "txt", "PDF", "docx", "csv", "bin")


def pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index % len(names) + 1).cast("int"))


class Catalog:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, written once for the state the documents are in."""
        state = stamp(self.spark, f"{self.sf_dir}/documents.parquet")
        return once(self.spark, (self.sf_dir, state, name), lambda: cut(make(), name))

    @cached_property
    def text(self) -> DataFrame:
        return self.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    @cached_property
    def rows(self) -> DataFrame:
        """What is known of each file without its text: identity, size, place and the first line that is not blank."""
        return self.derived("rows", self._rows)

    def _rows(self) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        first = F.regexp_extract(text, r"^[ \n]*+([^\n]*+)", 1)  # the rest of the text is not split
        title = F.when(text.rlike(r"[^ \n\t\r]"), F.btrim(first)).otherwise("")
        return self.table("documents").select(
            "doc_id",
            F.coalesce("lang", F.lit("xx")).alias("lang"),
            F.coalesce("source", F.lit("none")).alias("source"),
            F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
            F.sha2(text.cast("binary"), 256).alias("artifact_id"),
            title.alias("title"),
        )

    @cached_property
    def root(self) -> DataFrame:
        n = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
        return self.rows.select("source").distinct().select(
            F.col("source").alias("root_id"),
            F.concat(F.lit("root "), "source").alias("label"),
            F.when(n % 7 == 3, "unavailable").otherwise("online").alias("status"),
            (n % 2 == 0).alias("allow_organize"),
            (n % 5 == 4).alias("never_scanned"),
        )

    @cached_property
    def location(self) -> DataFrame:
        i = F.col("doc_id")
        path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), i.cast("string"), F.lit("."), pick(EXTENSIONS, i))
        ended = i % 19 == 7
        return self.rows.select(
            F.concat(F.lit("loc-"), i.cast("string")).alias("location_id"),
            F.col("source").alias("root_id"),
            path.alias("relative_path"),
            F.lower(path).alias("path_key"),
            "artifact_id",
            F.col("n_chars").alias("size"),
            F.when(i % 13 == 5, "missing").when(i % 17 == 3, "inaccessible").otherwise("active").alias("state"),
            ended.alias("ended"),
            F.when(ended, F.when(i % 2 == 1, "replaced").otherwise("moved")).alias("end_reason"),
            F.when(ended & (i % 38 != 26), F.concat(F.lit("loc-"), (i + 1).cast("string"))).alias("successor_location_id"),
            (i + (i * 7) % 50).alias("last_seen"),
            i.alias("seq"),
        )

    @cached_property
    def artifact(self) -> DataFrame:
        return self.derived("artifact", self._artifact)

    def _artifact(self) -> DataFrame:
        rows = self.rows.groupBy("artifact_id").agg(F.min("doc_id").alias("no"), F.max("n_chars").alias("size"))
        return rows.withColumn("content_kind", F.when(F.col("no") % 6 < 4, "pdf").when(F.col("no") % 6 == 4, "text").otherwise("image"))

    @cached_property
    def document_artifact(self) -> DataFrame:
        owner = F.col("no") - F.when(F.col("no") % 10 == 9, 1).otherwise(0)
        return self.artifact.select(
            F.concat(F.lit("doc-"), owner.cast("string")).alias("document_id"),
            "artifact_id",
            owner.alias("no"),
            ((F.col("no") == owner) & (F.col("no") % 31 != 9)).alias("canonical"),
        )

    @cached_property
    def document(self) -> DataFrame:
        return self.derived("document", self._document)

    def _document(self) -> DataFrame:
        """Some are merged into their predecessor; those of ``MERGED`` form one long chain of merges."""
        n = F.col("no")
        rows = self.document_artifact.select("document_id", "no").distinct()
        before = F.lag("document_id").over(Window.orderBy("no"))  # a fixed range of numbers
        chain = rows.filter(n.between(*MERGED)).select("document_id", before.alias("before"))
        rows = rows.join(F.broadcast(chain), "document_id", "left")
        usual = F.when((n % 23 == 11) & (n % 46 != 11), F.concat(F.lit("doc-"), (n - 1).cast("string")))
        return rows.select("document_id", "no", ((n % 23 == 11) | F.col("before").isNotNull()).alias("retired"), F.coalesce("before", usual).alias("merged_into"))

    @cached_property
    def live(self) -> DataFrame:
        return self.document.filter(~F.col("retired")).select("document_id", "no")

    @cached_property
    def page(self) -> DataFrame:
        """One row per line of each artifact's text; blank pages are kept."""
        return self.derived("page", self._page)

    def _page(self) -> DataFrame:
        texts = self.text.join(self.artifact.select("artifact_id", "no"), F.col("doc_id") == F.col("no"))
        pages = texts.select("artifact_id", "no", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
        return pages.select(
            "artifact_id",
            "no",
            (F.col("no") * PAGES + F.col("pos") + 1).alias("page_id"),
            (F.col("pos") + 1).alias("pdf_page"),
            "text",
            F.length(F.btrim("text")).alias("chars"),
        )

    @cached_property
    def extraction(self) -> DataFrame:
        return self.derived("extraction", self._extraction)

    def _extraction(self) -> DataFrame:
        n = F.col("no")
        rows = self.page.groupBy("artifact_id", "no").agg(F.count(F.lit(1)).alias("page_count"), F.sum("chars").alias("chars"))
        return rows.filter(n % 43 != 6).select(
            "artifact_id",
            "no",
            (F.col("page_count") + F.when(n % 47 == 8, 1).otherwise(0)).alias("page_count"),
            "chars",
            F.when(n % 41 == 7, "failed").when(n % 37 == 5, "partial").otherwise("ok").alias("status"),
            F.when(n % 9 == 4, "imported").otherwise("native").alias("source"),
            F.when(n % 11 == 2, "old").otherwise("current").alias("profile_id"),
        )

    @cached_property
    def titled(self) -> DataFrame:
        """(document_id, no, title, lang, source) of live and retired documents."""
        return self.document.select("document_id", "no").join(self.rows.select(F.col("doc_id").alias("no"), "title", "lang", "source"), "no").select("document_id", "no", "title", "lang", "source")

    @cached_property
    def looked_at(self) -> DataFrame:
        """Documents that metadata was ever gathered for."""
        return self.titled.filter("no % 37 <> 1")

    @cached_property
    def metadata_value(self) -> DataFrame:
        n = F.col("no")
        doc = n.cast("string")
        kind = F.when(n % 12 == 0, "book").when(n % 12 == 1, "book-chapter").when(n % 12 == 2, "posted-content").otherwise("journal-article")
        person = F.concat(F.lit('[{"family":"Fam'), (n % 50).cast("string"), F.lit('","given":"G"},{"name":"Team '), "lang", F.lit('"}]'))
        fields = F.array(
            F.struct(F.lit("title").alias("field"), F.when((n % 7 != 0) & (F.col("title") != ""), F.col("title")).alias("value")),
            F.struct(F.lit("year").alias("field"), F.when(n % 8 != 0, (1990 + n % 35).cast("string")).alias("value")),
            F.struct(F.lit("doi").alias("field"), F.when(n % 3 != 0, F.concat(F.lit("10.5555/doc."), (n % 300).cast("string"))).alias("value")),
            F.struct(F.lit("type").alias("field"), F.when(n % 5 != 0, kind).alias("value")),
            F.struct(F.lit("container").alias("field"), F.when(n % 4 != 0, F.concat(F.lit("Journal of "), "source")).alias("value")),
            F.struct(F.lit("authors").alias("field"), F.when(n % 6 != 0, person).alias("value")),
        )
        rows = self.looked_at.select("document_id", "no", F.explode(fields).alias("f"))
        return rows.filter(F.col("f.value").isNotNull()).select(
            "document_id",
            "no",
            "f.field",
            "f.value",
            F.when(n % 2 == 0, "provider").otherwise("pdf_info").alias("source"),
            (n % 16 == 3).alias("locked"),
            F.when(n % 4 == 1, "user").otherwise("rule:safe").alias("accepted_by"),
            F.when(n % 5 == 2, F.md5(F.concat(F.lit("cand-"), doc, F.lit("-0")).cast("binary"))).alias("source_candidate_id"),
        )

    @cached_property
    def metadata_candidate(self) -> DataFrame:
        n, k = F.col("no"), F.col("k")
        other = F.when(n % 4 == 0, F.concat("title", F.lit(" ."))).when(n % 4 == 1, F.concat(F.lit("Other title number "), n.cast("string"))).otherwise(F.col("title"))
        value = (
            F.when(k == 0, F.col("title"))
            .when(k == 1, other)
            .when(k == 2, F.concat(F.lit("10.5555/doc."), (n % 100).cast("string")))
            .otherwise((1990 + n % 35 + F.when(n % 9 == 0, 1).otherwise(0)).cast("string"))
        )
        rows = self.looked_at.select("document_id", "no", "title", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).filter("title <> ''")
        rows = rows.select("document_id", "no", "k", pick(FIELD_OF, k).alias("field"), value.alias("value"), pick(SOURCE_OF, k).alias("source"))
        return rows.select(
            "*",
            F.md5(F.concat(F.lit("cand-"), n.cast("string"), F.lit("-"), k.cast("string")).cast("binary")).alias("candidate_id"),
            evidence_key(F.col("field"), F.col("value"), F.col("source")).alias("evidence_key"),
            F.when(k == 2, F.when(n % 3 == 0, "own").when(n % 3 == 1, "ambiguous").otherwise("foreign")).otherwise("own").alias("classification"),
            pick(CONFIDENCES, n + k).alias("confidence"),
            F.when((n + k) % 3 == 0, "safe").otherwise("required").alias("review"),
            pick(STATUSES, n + k * 2).alias("status"),
            ((n * 3 + k) % 10).cast("long").alias("priority"),
            F.when((k == 2) & (n % 4 == 2), F.concat(F.lit('{"shared_by_documents":'), (n % 7).cast("string"), F.lit("}"))).otherwise("{}").alias("evidence"),
        )

    @cached_property
    def document_tag(self) -> DataFrame:
        labels = self.table("labels").join(self.document.select("document_id", F.col("no").alias("doc_id")), "doc_id")
        tags = F.filter(
            F.array(F.when(F.col("quality") == 1, "Good  Text"), F.when(F.col("toxic") == 1, "Toxic"), F.when(F.col("doc_id") % 5 == 0, "good text")),
            lambda t: t.isNotNull(),
        )
        rows = labels.select("document_id", F.explode(tags).alias("tag"))
        key = F.lower(F.btrim(F.regexp_replace("tag", r"\s+", " ")))
        return rows.groupBy("document_id", key.alias("tag_key")).agg(F.min("tag").alias("tag"))

    @cached_property
    def collection(self) -> DataFrame:
        return self.rows.select("lang").distinct().select(
            F.concat(F.lit("col-"), "lang").alias("collection_id"), F.concat(F.lit("Texts in "), "lang").alias("name"), (F.col("lang") == "es").alias("retired")
        )

    @cached_property
    def collection_member(self) -> DataFrame:
        return self.titled.filter("no % 3 = 1").select(F.concat(F.lit("col-"), "lang").alias("collection_id"), "document_id")

    @cached_property
    def document_relation(self) -> DataFrame:
        """Each document points at the one of half its number, where that exists; a long chain of parts and a ring besides."""
        n = F.col("no")
        known = self.document.select(F.col("document_id").alias("target_id"))
        rows = self.document.filter("no > 1").select(
            F.concat(F.lit("rel-"), n.cast("string")).alias("relation_id"),
            F.col("document_id").alias("source_id"),
            F.concat(F.lit("doc-"), F.floor(n / 2).cast("string")).alias("target_id"),
            pick(KINDS, n).alias("kind"),
            (n % 29 == 3).alias("retracted"),
        )
        columns = ["relation_id", "source_id", "target_id", "kind", "retracted"]
        order = Window.orderBy("no")  # fixed ranges of numbers
        chain = self.document.filter(n.between(*CHAINED)).withColumn("target_id", F.lag("document_id").over(order))
        ring = self.document.filter(n.between(*RING)).withColumn("target_id", F.coalesce(F.lead("document_id").over(order), F.first("document_id").over(order)))
        for name, kind, extra in (("chain-", "part_of", chain), ("ring-", "supplement_of", ring)):
            extra = extra.filter("target_id IS NOT NULL").select(
                F.concat(F.lit(name), n.cast("string")).alias("relation_id"), F.col("document_id").alias("source_id"), "target_id", F.lit(kind).alias("kind"), F.lit(False).alias("retracted")
            )
            rows = rows.unionByName(extra)
        return rows.join(known, "target_id").select(*columns)

    @cached_property
    def candidate_source(self) -> DataFrame:
        """(candidate_id, artifact_id): the bytes each proposal was read from; some are no longer the document's."""
        n = F.col("no")
        rows = self.metadata_candidate.select("candidate_id", "document_id", "no").join(self.artifact.select("artifact_id", "no"), "no")
        other = F.sha2(F.concat(F.lit("gone-"), n.cast("string")).cast("binary"), 256)
        return rows.select("candidate_id", "document_id", F.when(n % 53 == 7, other).otherwise(F.col("artifact_id")).alias("artifact_id"))

    @cached_property
    def run(self) -> DataFrame:
        """Three scans of every root; some never came to an end."""
        n = F.coalesce(F.regexp_extract("root_id", "([0-9]+)$", 1).try_cast("long"), F.lit(0))
        rows = self.root.select("root_id", n.alias("n"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
        return rows.select(
            F.concat(F.lit("run-"), "root_id", F.lit("-"), F.col("i").cast("string")).alias("run_id"),
            "root_id",
            (F.col("i") * 100 + F.col("n")).alias("started"),
            F.when((F.col("i") + F.col("n")) % 5 == 3, "running").when((F.col("i") + F.col("n")) % 7 == 2, "interrupted").otherwise("completed").alias("status"),
        )

    @cached_property
    def relation_candidate(self) -> DataFrame:
        n = F.col("no")
        return self.document.select(
            F.concat(F.lit("rc-"), n.cast("string")).alias("candidate_id"),
            F.when(n % 10 == 0, "group").otherwise("document").alias("level"),
            F.when(n % 4 == 0, "same_document").when(n % 4 == 1, "version_of").otherwise("related_to").alias("kind"),
            F.col("document_id").alias("source_id"),
            F.concat(F.lit("doc-"), (n + 1).cast("string")).alias("target_id"),
            pick(CONFIDENCES, n).alias("confidence"),
            F.when(n % 3 == 0, "proposed").when(n % 3 == 1, "accepted").otherwise("stale").alias("status"),
            F.transform(F.array(n, n + 1, n + 2), lambda x: F.concat(F.lit("doc-"), x.cast("string"))).alias("members"),
        )
