"""Relation detectors: each proposes rows (kind, source_id, target_id, evidence_key, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions.identifiers import AUTHORS, find_dois
from doclake.functions.naming import stem_of
from doclake.functions.text import alnum_key, column_key, fingerprint_text, is_correction, supplement_name_hint, supplement_says_so
from doclake.operators.pairs import spread_join, spread_pairs
from doclake.operators.views import latest_location, main_artifact, pivoted, union
from doclake.session import cut

# Thresholds and record types.
MIN_FINGERPRINT_CHARS, MAX_PAIRWISE, MIN_TITLE_KEY, SHARED_DOI_DOCUMENTS, FRONT_PAGES = 400, 6, 20, 3, 2
PART_TYPES = ("book-chapter", "reference-entry", "book-section", "book-part")
WHOLE_TYPES = ("book", "edited-book", "reference-book", "monograph", "book-set")
PREPRINT_TYPES = ("posted-content", "preprint")
#: Letters of a gram and the step between a text's grams; a key of MIN_TITLE_KEY letters holds a whole one at any offset.
GRAM, STEP = 12, 8


def proposal(rows: DataFrame, kind: str, source: str, target: str, evidence: str, confidence: Column | str) -> DataFrame:
    confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
    return rows.select(F.lit(kind).alias("kind"), F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(evidence).alias("evidence_key"), confidence.alias("confidence"))


def group_pairs(rows: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group, a, b): every pair of a group, whatever its size, as structs of the rows' other columns.

    The rows carry what their pairs are judged by, so pairs come out of the join once and
    are not shuffled; those of a large group are dealt over many tasks. Groups of one are
    left out before rows are dealt.
    """
    several = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*group)
    return spread_pairs(rows.join(several, group, "left_semi"), group, item)


def starred_pairs(rows: DataFrame, group: list[str], item: str, most: int = MAX_PAIRWISE) -> DataFrame:
    """(group, a, b): the reference's rule for proposals: every pair of a small group, a star to the smallest item of a large one.

    Large groups cost one row a member: only members of groups of at most
    ``most`` meet each other in the join.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.min(item).alias("__first")).filter("__n > 1")
    rows = rows.select(*group, F.col(item).alias("b")).join(sizes, group)
    star = rows.filter((F.col("__n") > most) & (F.col("b") != F.col("__first"))).select(*group, F.col("__first").alias("a"), "b")
    small = rows.filter(F.col("__n") <= most)
    pairs = small.select(*group, F.col("b").alias("a")).join(small.select(*group, "b"), group).filter("a < b")
    return star.unionByName(pairs.select(*group, "a", "b"))


def fingerprints(page: DataFrame) -> DataFrame:
    """(artifact_id, fingerprint) of texts with enough letters and digits, pages in order."""
    parts = page.select("artifact_id", F.struct("pdf_page", fingerprint_text(F.col("text")).alias("t")).alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "")
    rows = parts.groupBy("artifact_id").agg(text.alias("t"))
    return rows.filter(F.length("t") >= MIN_FINGERPRINT_CHARS).select("artifact_id", F.sha2(F.col("t").cast("binary"), 256).alias("fingerprint"))


def described(c) -> DataFrame:
    """One row per live document with what its accepted values say; no page is read."""
    rows = c.live.select("document_id").join(main_artifact(c.document_artifact), "document_id")
    rows = rows.join(pivoted(c.metadata_value, ("title", "doi", "type", "container", "authors")), "document_id", "left").withColumn("key", column_key("title"))
    people = F.from_json("authors", AUTHORS)
    named = F.filter(F.transform(people, lambda p: F.coalesce(p["family"], p["name"])), lambda n: n.isNotNull())
    return rows.select(
        "document_id", "artifact_id", "title", "doi", F.lower(F.coalesce("type", F.lit(""))).alias("type"), "container",
        F.when(F.length("key") >= MIN_TITLE_KEY, F.col("key")).alias("title_key"), F.nullif(alnum_key(F.col("container")), F.lit("")).alias("container_key"),
        F.nullif(alnum_key(F.get(named, F.lit(0))), F.lit("")).alias("first_family"), F.lower(F.coalesce("type", F.lit(""))).isin(*PREPRINT_TYPES).alias("preprint"),
    )


def documents(c) -> DataFrame:
    """``described`` with each document's stem and the text of its first pages."""
    front = c.page.filter(F.col("pdf_page") <= FRONT_PAGES).groupBy("artifact_id")
    front = front.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pdf_page", "text"))), lambda p: p["text"]), "\n").alias("first_text"))
    rows = described(c)
    columns, rows = rows.columns, rows.join(front, "artifact_id", "left").join(latest_location(c.location), "artifact_id", "left")
    return rows.select(*columns, F.coalesce("first_text", F.lit("")).alias("first_text"), stem_of(F.col("relative_path")).alias("stem"))


def printed_keys(texts: DataFrame, titled: DataFrame) -> DataFrame:
    """(reader, title): the digests of whole title keys that stand in a first text.

    A text gives the hash of every ``STEP``-th gram, cut in one pass over it; a key
    gives those of its first ``STEP`` offsets, one of which must fall on a gram of
    any text that holds the key. Hashes and ids meet in an equi-join; the pairs that
    it finds fetch text and key for the containment test. Equal keys are looked for
    once, whoever has them.
    """
    folded = texts.select(F.col("document_id").alias("reader"), alnum_key(F.col("first_text")).alias("hay"))
    grams = F.regexp_extract_all("hay", F.lit(f"(?s)(?=(.{{{GRAM}}})).{{{STEP}}}"), 1)
    places = folded.select("reader", F.explode(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))).alias("gram"))
    keys = titled.filter("title_key IS NOT NULL").select(F.col("document_id").alias("printed"), "title_key", F.xxhash64("title_key").alias("key"))
    starts = F.array(*[F.xxhash64(F.substring("title_key", i + 1, GRAM)) for i in range(STEP)])
    wanted = keys.select("key", "title_key").distinct().select("key", F.explode(starts).alias("gram")).distinct()
    pairs = cut(places.join(wanted, "gram").select("reader", "key").distinct(), "hopeful")
    hits = pairs.join(folded, "reader").join(keys.select("key", "title_key").distinct(), "key").filter(F.contains("hay", F.col("title_key")))
    return hits.select("reader", title_digest().alias("title")).distinct()


def title_digest() -> Column:
    """What stands for a title key in joins, so that long titles are not shuffled."""
    return F.sha2(F.col("title_key").cast("binary"), 256)


def printed_titles(texts: DataFrame, titled: DataFrame) -> DataFrame:
    """(reader, printed): whose whole title key stands in whose first text; a pair once, where each id of ``titled`` has one key."""
    mains = titled.filter("title_key IS NOT NULL").select(F.col("document_id").alias("printed"), title_digest().alias("title")).distinct()
    return spread_join(cut(printed_keys(texts, titled), "printed"), mains, ["title"]).filter("reader <> printed").select("reader", "printed")


def corrections(docs: DataFrame) -> DataFrame:
    """A correction is related to the work whose title it prints."""
    marked = docs.withColumn("correction", is_correction(F.col("title"), F.col("first_text")) & (F.col("first_text") != ""))
    hits = printed_titles(marked.filter("correction"), marked.filter("NOT correction"))
    return proposal(hits, "related_to", "reader", "printed", "correction-of", "high")


def _marked(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("says_so", supplement_says_so(F.col("first_text"))).withColumn("hint", supplement_name_hint(F.col("stem")))
    return docs.withColumn("correction", is_correction(F.col("title"), F.col("first_text")))


def _dois_of() -> Column:
    """A document's own DOI and those its first text prints."""
    return F.array_distinct(F.array_compact(F.concat(F.array("doi"), find_dois(F.col("first_text")))))


def supplements(docs: DataFrame) -> DataFrame:
    """A text that says it is a supplement, or is named so, and prints another's DOI or title.

    The DOIs and title keys that a reader prints stand beside it, so a pair found by
    one signal tells by itself whether it has the other: pairs come out of the joins
    once and are neither grouped nor shuffled. How many targets a reader has is
    reckoned from the counts of documents by DOI, by title and by both.
    """
    docs = _marked(docs)
    marked = docs.filter("(says_so OR hint) AND first_text <> '' AND NOT correction")
    mains = cut(docs.filter("NOT says_so").select(F.col("document_id").alias("printed"), "doi", F.when(F.col("title_key").isNotNull(), title_digest()).alias("title")), "mains")
    titles = printed_keys(marked, docs.filter("NOT says_so")).groupBy("reader").agg(F.collect_set("title").alias("titles"))
    readers = marked.select(F.col("document_id").alias("reader"), "says_so", _dois_of().alias("dois")).join(titles, "reader", "left")
    readers = cut(readers.withColumn("titles", F.coalesce("titles", F.array().cast("array<string>"))), "readers")
    by_doi = readers.select("reader", "titles", F.explode("dois").alias("doi"))
    by_title = readers.select("reader", F.explode("titles").alias("title"))
    own = readers.join(mains.select(F.col("printed").alias("reader"), "doi", "title"), "reader")
    counts = [
        by_doi.join(mains.groupBy("doi").count(), "doi").select("reader", "count"),
        by_title.join(mains.groupBy("title").count(), "title").select("reader", "count"),
        by_doi.select("reader", "doi", F.explode("titles").alias("title")).join(mains.groupBy("doi", "title").count(), ["doi", "title"]).select("reader", (-F.col("count")).alias("count")),
        own.filter(_held("dois", "doi") | _held("titles", "title")).select("reader", F.lit(-1).cast("long").alias("count")),
    ]
    targets = union(counts).groupBy("reader").agg(F.sum("count").alias("targets"))
    confidence = F.when(F.col("targets") > 1, "ambiguous").when(F.col("says_so"), "high").otherwise("medium")
    readers = cut(readers.join(targets, "reader").withColumn("confidence", confidence), "readers")
    first = spread_join(readers.select("*", F.explode("dois").alias("doi")), mains.filter("doi IS NOT NULL"), ["doi"])
    first = first.filter(F.col("says_so") | _held("titles", "title"))
    other = readers.filter("says_so").select("*", F.explode("titles").alias("title"))
    other = spread_join(other, mains.filter("title IS NOT NULL"), ["title"]).filter(~_held("dois", "doi"))
    rows = first.select("reader", "printed", "confidence").unionByName(other.select("reader", "printed", "confidence")).filter("reader <> printed")
    return proposal(rows, "supplement_of", "reader", "printed", "supplement", F.col("confidence"))


def _held(values: str, value: str) -> Column:
    return F.coalesce(F.array_contains(values, F.col(value)), F.lit(False))


def supplement_pairs(docs: DataFrame) -> DataFrame:
    """Supplements and corrections: their two ends are not the same document, whatever they share."""
    return union([corrections(docs), supplements(docs)])


def _ends(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))


def apart_among(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that ``supplement_pairs`` holds in either direction, by its rules for the two documents alone.

    Supplements and corrections grow with the square of a title's documents, the
    pairs asked about do not: so each is looked at by itself.
    """
    pairs = pairs.select("a", "b").distinct()
    both = pairs.select("a", "b", F.col("a").alias("reader"), F.col("b").alias("printed")).unionByName(pairs.select("a", "b", F.col("b").alias("reader"), F.col("a").alias("printed")))
    asked = both.select(F.col("reader").alias("document_id")).distinct()
    docs = cut(_marked(docs.join(asked, "document_id", "left_semi")).select("document_id", "doi", "title_key", "first_text", "says_so", "hint", "correction"), "asked")
    mains = docs.select(F.col("document_id").alias("printed"), F.col("doi").alias("its_doi"), "title_key", F.col("says_so").alias("main_says"), (F.col("correction") & (F.col("first_text") != "")).alias("main_corrects"))
    readers = docs.filter("first_text <> '' AND (correction OR says_so OR hint)").select(
        F.col("document_id").alias("reader"), "correction", "says_so", alnum_key(F.col("first_text")).alias("hay"), _dois_of().alias("dois")
    )
    rows = both.join(mains, "printed").join(readers, "reader").withColumns({"by_title": F.coalesce(F.contains("hay", F.col("title_key")), F.lit(False)), "by_doi": _held("dois", "its_doi")})
    corrects = "correction AND NOT main_corrects AND by_title"
    supplements_ = "NOT correction AND NOT main_says AND ((by_title AND by_doi) OR (says_so AND (by_title OR by_doi)))"
    return rows.filter(f"({corrects}) OR ({supplements_})").select("a", "b").distinct()


def _doi_groups(docs: DataFrame) -> DataFrame:
    groups = docs.filter("doi IS NOT NULL").groupBy("doi").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(title_digest()).alias("titles"))
    return groups.filter("n > 1").withColumn("parent", (F.col("n") >= SHARED_DOI_DOCUMENTS) & (F.col("titles") > 1))


def same_doi(docs: DataFrame, prints: DataFrame, apart: DataFrame | None = None) -> DataFrame:
    """Pairs with one DOI; many titles under one DOI are a parent work instead. ``apart``: supplement and correction pairs, else judged here."""
    groups = _doi_groups(docs).filter("NOT parent").select("doi", "titles")
    pairs = cut(starred_pairs(docs.join(groups, "doi", "left_semi"), ["doi"], "document_id").join(groups, "doi"), "same_doi")
    pairs = pairs.join(apart_among(docs, pairs) if apart is None else _ends(apart).distinct(), ["a", "b"], "left_anti")
    marks = docs.join(prints, "artifact_id", "left").select("document_id", "fingerprint")
    pairs = pairs.join(marks.toDF("a", "fa"), "a").join(marks.toDF("b", "fb"), "b")
    confidence = F.when(F.col("fa") == F.col("fb"), "exact").when(F.col("titles") <= 1, "high").otherwise("medium")
    return proposal(pairs, "same_document", "a", "b", "shared-doi", confidence)


def identical_text(prints: DataFrame, document_artifact: DataFrame) -> DataFrame:
    """Equal fingerprints: equivalent artifacts, and the same document where the owners differ."""
    rows = prints.join(document_artifact.select("artifact_id", "document_id"), "artifact_id")
    artifacts = proposal(starred_pairs(rows, ["fingerprint"], "artifact_id"), "equivalent_to", "a", "b", "identical-text", "exact")
    owners = proposal(starred_pairs(rows.select("fingerprint", "document_id").distinct(), ["fingerprint"], "document_id"), "same_document", "a", "b", "identical-text", "exact")
    return artifacts.unionByName(owners)


def same_title_and_author(docs: DataFrame, already: DataFrame, judge: bool = False) -> DataFrame:
    """One title key and first surname, but for pairs that others found (``already``) and, with ``judge``, supplements and corrections."""
    pairs = starred_pairs(docs.filter("title_key IS NOT NULL AND first_family IS NOT NULL"), ["title_key", "first_family"], "document_id")
    ends = docs.select("document_id", "doi")
    pairs = pairs.join(ends.toDF("a", "da"), "a").join(ends.toDF("b", "db"), "b").filter("da IS NULL OR db IS NULL OR da = db")
    pairs = pairs.join(_ends(already.filter("kind <> 'equivalent_to'")).distinct(), ["a", "b"], "left_anti")
    if judge:
        pairs = cut(pairs, "same_title")
        pairs = pairs.join(apart_among(docs, pairs), ["a", "b"], "left_anti")
    return proposal(pairs, "same_document", "a", "b", "same-title-and-first-author", "medium")


def versions(docs: DataFrame) -> DataFrame:
    """One title under two DOIs: preprint and published, or two related publications."""
    titled = docs.filter("title_key IS NOT NULL AND doi IS NOT NULL").select(title_digest().alias("title"), "document_id", "doi", "preprint")
    pairs = group_pairs(titled, ["title"], "document_id").filter("a.doi <> b.doi AND NOT (a.preprint AND b.preprint)")
    mixed, turned = F.col("a.preprint") != F.col("b.preprint"), F.col("b.preprint")
    return pairs.select(
        F.when(mixed, "version_of").otherwise("related_to").alias("kind"),
        F.when(turned, F.col("b.document_id")).otherwise(F.col("a.document_id")).alias("source_id"),
        F.when(turned, F.col("a.document_id")).otherwise(F.col("b.document_id")).alias("target_id"),
        F.when(mixed, "preprint-and-published").otherwise("same-title-different-doi").alias("evidence_key"),
        F.when(mixed, "high").otherwise("low").alias("confidence"),
    )


def printed_parents(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, doi): live documents that print a DOI which several print as their own, accepted or not."""
    told = candidates.filter("field = 'doi' AND source = 'pdf_text_doi' AND status IN ('proposed', 'accepted')")
    told = told.filter(F.get_json_object("evidence", "$.shared_by_documents").isNotNull())
    members = told.select("document_id", F.col("value").alias("doi")).distinct().join(docs.select("document_id"), "document_id", "left_semi")
    return members.join(members.groupBy("doi").count().filter(F.col("count") >= SHARED_DOI_DOCUMENTS), "doi", "left_semi").select("document_id", "doi")


def parts_and_collections(docs: DataFrame, printed: DataFrame | None = None) -> DataFrame:
    """Members of a whole work by shared DOI or container title; without the whole, a proposed collection. ``printed``: further members by DOI."""
    wholes = docs.filter(F.col("type").isin(*WHOLE_TYPES))
    by_doi = wholes.filter("doi IS NOT NULL").groupBy("doi").agg(F.max("document_id").alias("whole"))
    parents = docs.join(_doi_groups(docs).filter("parent").select("doi"), "doi", "left_semi").select("document_id", "doi")
    parents = (parents if printed is None else parents.unionByName(printed).distinct()).join(by_doi, "doi", "left")
    parts = docs.filter(F.col("type").isin(*PART_TYPES) & F.col("container_key").isNotNull())
    by_title = wholes.filter("title_key IS NOT NULL").groupBy(F.col("title_key").alias("container_key")).agg(F.max("document_id").alias("whole"))
    chapters = parts.join(by_title, "container_key", "left")
    groups = chapters.filter("whole IS NULL").groupBy("container_key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    shared = parents.filter("whole IS NULL").select(F.concat(F.lit("parent-doi:"), "doi").alias("g")).distinct()
    named = groups.select(F.concat(F.lit("container:"), F.substring("container_key", 1, 60)).alias("g"))
    collections = union([shared, named]).select("g", F.lit("").alias("none"))
    return union(
        [
            proposal(parents.filter("whole IS NOT NULL AND document_id <> whole"), "part_of", "document_id", "whole", "parent-doi", "high"),
            proposal(chapters.filter("whole IS NOT NULL AND document_id <> whole"), "part_of", "document_id", "whole", "container-title", "high"),
            proposal(collections, "collection", "g", "none", "group", "medium"),
        ]
    )


def replacements(location: DataFrame, document_artifact: DataFrame, docs: DataFrame) -> DataFrame:
    """The successor of a replaced location replaces its artifact."""
    old = location.filter("end_reason = 'replaced'").select("successor_location_id", F.col("artifact_id").alias("old"))
    new = location.select(F.col("location_id").alias("successor_location_id"), F.col("artifact_id").alias("new"))
    owner = document_artifact.join(docs.select("document_id", "doi"), "document_id").select("artifact_id", "doi")
    rows = old.join(new, "successor_location_id").filter("old <> new").join(owner.toDF("old", "od"), "old").join(owner.toDF("new", "nd"), "new")
    return proposal(rows, "replaces", "new", "old", "same-path", F.when(F.col("od") == F.col("nd"), "high").otherwise("medium"))


def judged(docs: DataFrame, prints: DataFrame, owned: DataFrame) -> DataFrame:
    """One row a document with all that its pairs with others of its DOI or title are judged by, and no text.

    ``single``: documents with its DOI are one work; ``prints``: fingerprints of all its artifacts, ``print`` that of its main one;
    ``dois`` and ``told``: the DOIs and, of the titles under its DOI and its own, those that its first text prints, where it may be a supplement or correction.
    """
    groups = docs.filter("doi IS NOT NULL").groupBy("doi").agg(F.min("title_key").alias("least"), F.max("title_key").alias("most"))
    groups = groups.join(_doi_groups(docs).filter("NOT parent").select("doi", "titles"), "doi")  # two titles at most
    marks = owned.join(prints, "artifact_id").groupBy("document_id").agg(F.collect_set("fingerprint").alias("prints"))
    rows = _marked(docs).join(groups, "doi", "left").join(marks, "document_id", "left").join(prints.withColumnRenamed("fingerprint", "print"), "artifact_id", "left")
    reads = (F.col("first_text") != "") & (F.col("correction") | F.col("says_so") | F.col("hint"))
    rows = rows.withColumn("hay", F.when(reads, alnum_key(F.col("first_text"))))
    told = F.filter(F.array_distinct(F.array_compact(F.array("title_key", "least", "most"))), lambda t: F.contains("hay", t))
    digests = F.transform(told, lambda t: F.sha2(t.cast("binary"), 256))
    return rows.select(
        "document_id", "doi", title_digest().alias("title"), "first_family", F.col("titles").isNotNull().alias("single"), "titles", "print", "prints", "says_so", "correction", reads.alias("reads"),
        (F.col("correction") & (F.col("first_text") != "")).alias("corrects"), F.when(reads, _dois_of()).alias("dois"), F.when(reads, digests).alias("told"),
    )


def _is_apart(reader: str, printed: str) -> Column:
    """Whether ``supplement_pairs`` holds the pair in this direction; both are structs of ``judged``, of one DOI or title."""
    r, p = F.col(reader), F.col(printed)
    by_title, by_doi = (F.coalesce(F.array_contains(r[values], p[value]), F.lit(False)) for values, value in (("told", "title"), ("dois", "doi")))
    supplement = ~p["says_so"] & ((by_title & by_doi) | (r["says_so"] & (by_title | by_doi)))
    return r["reads"] & F.when(r["correction"], ~p["corrects"] & by_title).otherwise(supplement)


def same_documents(docs: DataFrame, prints: DataFrame, owned: DataFrame) -> DataFrame:
    """``same_doi``, ``identical_text`` and ``same_title_and_author`` over every pair of their groups, each pair by the first of them that finds it."""
    rows = cut(judged(docs, prints, owned), "judged")
    apart = _is_apart("a", "b") | _is_apart("b", "a")
    by_doi = group_pairs(rows.filter("single").withColumn("group", F.col("doi")), ["group"], "document_id").filter(~apart)
    confidence = F.when(F.col("a.print") == F.col("b.print"), "exact").when(F.col("a.titles") <= 1, "high").otherwise("medium")
    found = [_between(by_doi, "same_document", "document_id", "shared-doi", confidence)]
    held = owned.join(prints, "artifact_id")
    artifacts = group_pairs(held.select("fingerprint", "artifact_id").distinct(), ["fingerprint"], "artifact_id")
    found.append(_between(artifacts, "equivalent_to", "artifact_id", "identical-text", F.lit("exact")))
    owners = held.select("fingerprint", "document_id").distinct().join(rows.select("document_id", "prints"), "document_id")
    shared = F.array_min(F.array_intersect("a.prints", "b.prints"))  # a pair comes up under each fingerprint that it shares
    once = F.when((F.size("a.prints") == 1) | (F.size("b.prints") == 1), F.lit(True)).otherwise(shared == F.col("fingerprint"))
    found.append(_between(group_pairs(owners, ["fingerprint"], "document_id").filter(once), "same_document", "document_id", "identical-text", F.lit("exact")))
    titled = rows.filter("title IS NOT NULL AND first_family IS NOT NULL").withColumns({"group": F.col("title"), "family": F.col("first_family")})
    titled = group_pairs(titled, ["group", "family"], "document_id").filter("a.doi IS NULL OR b.doi IS NULL OR (a.doi = b.doi AND NOT a.single)")
    titled = titled.filter(~F.coalesce(F.arrays_overlap("a.prints", "b.prints"), F.lit(False)) & ~apart)
    found.append(_between(titled, "same_document", "document_id", "same-title-and-first-author", F.lit("medium")))
    return union(found)


def _between(pairs: DataFrame, kind: str, item: str, evidence: str, confidence: Column) -> DataFrame:
    rows = pairs.select(F.col(f"a.{item}").alias("source"), F.col(f"b.{item}").alias("target"), confidence.alias("sure"))
    return proposal(rows, kind, "source", "target", evidence, F.col("sure"))


def detect(c, docs: DataFrame | None = None, prints: DataFrame | None = None) -> DataFrame:
    """All detectors in their order, over every pair: later ones leave out what earlier ones found. What the caller has made already is used as it is.

    Pairs are distinct as they come and share no evidence key, so they are neither
    stored nor shuffled; only what follows the documents' number is made distinct.
    """
    docs = documents(c) if docs is None else docs
    prints = fingerprints(c.page) if prints is None else prints
    owned = c.document_artifact.join(docs.select("document_id"), "document_id", "left_semi").select("document_id", "artifact_id")
    parts = parts_and_collections(docs, printed_parents(c.metadata_candidate, docs))
    rest = cut(union([parts, replacements(c.location, c.document_artifact, docs)]).distinct(), "rest")
    return union([supplement_pairs(docs), same_documents(docs, prints, owned), versions(docs), rest])


def reachable(edges: DataFrame, kind: str) -> DataFrame:
    """(start, node, depth): everything reachable along live edges of one kind, with the fewest steps.

    Rounds double the length: a shortest path of more than ``half`` steps has its
    middle at exactly ``half`` steps from the start, and the rest of it is known by
    then. Rounds end when one finds nothing new, whatever the depth.
    """
    step = edges.filter((F.col("kind") == kind) & ~F.col("retracted")).select(F.col("source_id").alias("start"), F.col("target_id").alias("node")).distinct()
    rounds, half = [cut(step.withColumn("depth", F.lit(1)), "walk")], 1
    while True:
        known = union(rounds)
        onward = known.select(F.col("start").alias("middle"), F.col("node").alias("end"), F.col("depth").alias("rest"))
        ahead = known.filter(F.col("depth") == half).select("start", F.col("node").alias("middle")).join(onward, "middle")
        ahead = ahead.groupBy("start", F.col("end").alias("node")).agg((F.min("rest") + half).alias("depth"))
        found = cut(ahead.join(known, ["start", "node"], "left_anti").select("start", "node", "depth"), "walk")
        if found.isEmpty():
            return known
        rounds.append(found)
        half *= 2


def merged_survivors(pairs: DataFrame) -> DataFrame:
    """(absorbed, survivor, depth) after following chains of merges to the last document; a ring of merges has none.

    Pointer jumping: each round takes every pointer to where its end points, so a chain of n takes log n rounds.
    """
    hops = cut(pairs.filter("merged_into IS NOT NULL").select("document_id", F.col("merged_into").alias("survivor"), F.lit(1).cast("long").alias("depth")), "merges")
    left = hops.count().bit_length() + 1  # what still moves after these rounds runs into a ring
    while True:
        further = hops.select(F.col("document_id").alias("survivor"), F.col("survivor").alias("next"), F.col("depth").alias("more"))
        ahead = hops.join(further, "survivor", "left")
        if left == 0 or ahead.filter("next IS NOT NULL").isEmpty():
            return ahead.filter("next IS NULL").select("document_id", "survivor", "depth")
        hops = cut(ahead.select("document_id", F.coalesce("next", "survivor").alias("survivor"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "merges")
        left -= 1


ACYCLIC = ("part_of", "supplement_of", "version_of")


def additions(edges: DataFrame, wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """Outcome of adding each edge (kind, source_id, target_id): itself, unknown, exists, cycle or added."""
    live = edges.filter("NOT retracted").select("kind", "source_id", "target_id").distinct().withColumn("held", F.lit(True))
    known = documents.select("document_id")
    rows = wanted.join(live, ["kind", "source_id", "target_id"], "left")
    for end in ("source_id", "target_id"):
        rows = rows.join(known.select(F.col("document_id").alias(end)).withColumn(f"{end}_known", F.lit(True)), end, "left")
    back = None
    for kind in ACYCLIC:
        part = reachable(edges, kind).select(F.lit(kind).alias("kind"), F.col("start").alias("target_id"), F.col("node").alias("source_id"))
        back = part if back is None else back.unionByName(part)
    rows = rows.join(back.withColumn("back", F.lit(True)), ["kind", "source_id", "target_id"], "left")
    outcome = (
        F.when(F.col("source_id") == F.col("target_id"), "itself")
        .when(F.col("source_id_known").isNull() | F.col("target_id_known").isNull(), "unknown")
        .when(F.col("held"), "exists")
        .when(F.col("back"), "cycle")
        .otherwise("added")
    )
    return rows.select("kind", "source_id", "target_id", outcome.alias("outcome"))
