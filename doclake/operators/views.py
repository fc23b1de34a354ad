"""Computed views, reports and integrity checks over a catalog's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions.identifiers import agreement_key, normalise
from doclake.functions.naming import extension_kind, kinds_disagree
from doclake.operators.filters import available
from doclake.session import cut

CONFIDENCE_RANK = {"exact": 0, "high": 1, "medium": 2, "low": 3, "ambiguous": 4}
INBOX = ("unresolved", "ambiguous", "missing", "new")


def confidence_rank(confidence: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in CONFIDENCE_RANK.items() for x in item]), confidence)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def first_reason(rows: DataFrame, by: str, order: Column) -> DataFrame:
    """One row per ``by``, the first in ``order``; no window, so hot keys combine on the map side."""
    rest = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(order, *rest)).alias("r")).select(by, "r.*")


# --------------------------------------------------------------------- views


def title_states(c) -> DataFrame:
    """Per document with a PDF as its main artifact: accepted, or why it has no title."""
    title = c.metadata_value.filter("field = 'title'").select("document_id", F.lit(True).alias("titled"))
    waiting = c.metadata_candidate.filter("field = 'title' AND status = 'proposed'").select("document_id").distinct().withColumn("waiting", F.lit(True))
    pdf = c.artifact.filter("content_kind = 'pdf'").select("artifact_id")
    docs = c.document_artifact.filter("canonical").join(pdf, "artifact_id", "left_semi").select("document_id", "artifact_id")
    text = c.extraction.select("artifact_id", (F.col("chars") == 0).alias("scanned"))
    rows = docs.join(title, "document_id", "left").join(waiting, "document_id", "left").join(text, "artifact_id", "left")
    state = (
        F.when(F.col("titled"), "accepted")
        .when(F.col("scanned").isNull(), "not_extracted")
        .when(F.col("waiting"), "candidates_awaiting_review")
        .when(F.col("scanned"), "no_text_layer")
        .otherwise("no_title_found")
    )
    return rows.select("document_id", state.alias("state"))


def unresolved(c) -> DataFrame:
    return title_states(c).filter("state <> 'accepted'").select("document_id", F.col("state").alias("reason"))


def ambiguous(c) -> DataFrame:
    own = c.metadata_candidate.filter("status = 'proposed' AND (classification = 'ambiguous' OR confidence = 'ambiguous')")
    own = own.select("document_id", F.lit("a proposal the evidence does not decide").alias("detail"), F.lit(0).alias("rank"))
    pairs = c.relation_candidate.filter("status = 'proposed' AND level <> 'group' AND confidence IN ('low', 'ambiguous')")
    ends = pairs.select(F.explode(F.array("source_id", "target_id")).alias("document_id")).distinct().join(c.live.select("document_id"), "document_id", "left_semi")
    ends = ends.select("document_id", F.lit("a relation the evidence does not decide").alias("detail"), F.lit(1).alias("rank"))
    return first_reason(own.distinct().unionByName(ends), "document_id", F.col("rank")).select("document_id", "detail")


def missing(c) -> DataFrame:
    return c.live.select("document_id").join(available(c.document_artifact, c.location, c.root), "document_id", "left_anti")


def current_copies(c) -> DataFrame:
    return c.location.filter("NOT ended AND state = 'active'")


def exact_copies(c) -> DataFrame:
    """One artifact at several current paths, paths in order."""
    rows = current_copies(c).join(c.root.select("root_id", "label"), "root_id")
    groups = rows.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_key", "label", "relative_path"))), lambda p: F.concat(p["label"], F.lit(":"), p["relative_path"])), "|").alias("paths"),
    )
    return groups.filter("copies > 1").join(c.document_artifact.select("artifact_id", "document_id"), "artifact_id", "left")


def duplicates(c) -> DataFrame:
    same = exact_copies(c).filter("document_id IS NOT NULL").groupBy("document_id").agg(F.max_by("copies", "artifact_id").alias("copies"))
    same = same.select("document_id", F.concat(F.lit("the same file at "), F.col("copies").cast("string"), F.lit(" paths")).alias("detail"), F.lit(0).alias("rank"))
    pairs = c.relation_candidate.filter("status = 'proposed' AND kind = 'same_document'")
    ends = pairs.select(F.explode(F.array("source_id", "target_id")).alias("document_id")).distinct()
    ends = ends.select("document_id", F.lit("may be the same document as another").alias("detail"), F.lit(1).alias("rank"))
    return first_reason(same.unionByName(ends), "document_id", F.col("rank")).select("document_id", "detail")


def new(c) -> DataFrame:
    seen = c.metadata_candidate.select("document_id").union(c.metadata_value.select("document_id")).distinct()
    return c.live.select("document_id").join(seen, "document_id", "left_anti")


def untagged(c) -> DataFrame:
    return c.live.select("document_id").join(c.document_tag, "document_id", "left_anti")


def uncollected(c) -> DataFrame:
    live = c.collection.filter("NOT retired").select("collection_id")
    return c.live.select("document_id").join(c.collection_member.join(live, "collection_id", "left_semi"), "document_id", "left_anti")


def inbox(c) -> DataFrame:
    """What needs a person first; a document appears once, under its first reason."""
    parts = [unresolved(c).select("document_id"), ambiguous(c).select("document_id"), missing(c), new(c)]
    rows = union([p.select("document_id", F.lit(name).alias("reason"), F.lit(i).alias("rank")) for i, (name, p) in enumerate(zip(INBOX, parts, strict=True))])
    return first_reason(rows, "document_id", F.col("rank"))


VIEWS = {"unresolved": unresolved, "ambiguous": ambiguous, "missing": missing, "duplicates": duplicates, "new": new, "untagged": untagged, "uncollected": uncollected, "inbox": inbox}


# -------------------------------------------------------------------- listing


def pivoted(values: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(document_id, a column a field): each document's value of each field, in one shuffle."""
    each = [F.first(F.when(F.col("field") == name, F.col("value")), ignorenulls=True).alias(name) for name in fields]
    return values.filter(F.col("field").isin(*fields)).groupBy("document_id").agg(*each)


def latest_location(location: DataFrame) -> DataFrame:
    """Per artifact the path to show: current before ended, then last seen."""
    order = F.struct(F.col("ended"), -F.col("last_seen"), F.col("path_key"))
    return location.groupBy("artifact_id").agg(F.min_by("relative_path", order).alias("relative_path"))


def main_artifact(document_artifact: DataFrame) -> DataFrame:
    """The canonical artifact, else the smallest id."""
    order = F.struct(~F.col("canonical"), F.col("artifact_id"))
    return document_artifact.groupBy("document_id").agg(F.min_by("artifact_id", order).alias("artifact_id"))


def listing(c) -> DataFrame:
    """Live documents with display title, fields, availability and inbox reason, ranked in the default order."""
    fields = pivoted(c.metadata_value, ("title", "authors", "year", "doi"))
    rows = c.live.select("document_id").join(main_artifact(c.document_artifact), "document_id", "left").join(latest_location(c.location), "artifact_id", "left")
    rows = rows.join(fields, "document_id", "left").join(inbox(c), "document_id", "left")
    here = available(c.document_artifact, c.location, c.root).withColumn("available", F.lit(True))
    rows = rows.join(here, "document_id", "left")
    title = F.coalesce("title", "relative_path", F.substring("document_id", 1, 12))
    rows = rows.select(
        "document_id", title.alias("display"), "year", "doi", F.coalesce("available", F.lit(False)).alias("available"),
        F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("rank", F.lit(len(INBOX))).alias("reason_rank"),
    )
    return rows.withColumn("sort_title", F.lower("display"))


def sidebar(c) -> DataFrame:
    live = c.live.select("document_id")
    parts = [view(c).select(F.lit("view").alias("kind"), F.lit(name).alias("name"), "document_id") for name, view in VIEWS.items()]
    parts.append(c.document_tag.join(live, "document_id", "left_semi").select(F.lit("tag").alias("kind"), F.col("tag_key").alias("name"), "document_id"))
    kept = c.collection.filter("NOT retired").select("collection_id", "name")
    members = c.collection_member.join(kept, "collection_id").join(live, "document_id", "left_semi")
    parts.append(members.select(F.lit("collection").alias("kind"), "name", "document_id"))
    parts.append(live.select(F.lit("all").alias("kind"), F.lit("all").alias("name"), "document_id"))
    return union(parts).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("documents"))


def review_queue(c, review: str | None = None) -> DataFrame:
    """Open proposals by (document, field, value), most urgent first; those an accepted value already says are left out."""
    rows = c.metadata_candidate.filter("status = 'proposed'")
    best = F.struct(confidence_rank(F.col("confidence")).alias("c"), F.col("priority"), F.col("candidate_id"))
    items = rows.groupBy("document_id", "field", "value").agg(
        F.min_by(F.struct("confidence", "classification"), best).alias("best"),
        F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"),
        F.min("priority").alias("priority"),
        F.max((F.col("review") == "safe").cast("int")).alias("safe"),
        F.count(F.lit(1)).alias("candidates"),
    )
    accepted = c.metadata_value.select("document_id", "field", F.col("value").alias("accepted"))
    items = items.join(accepted, ["document_id", "field"], "left")
    says_so = agreement_key(F.col("field"), F.col("accepted")) == agreement_key(F.col("field"), F.col("value"))
    items = items.filter(~F.coalesce(says_so, F.lit(False)))
    items = items.select(
        "document_id", "field", "value", "best.confidence", "best.classification", "sources", "priority", "candidates",
        F.when(F.col("safe") == 1, "safe").otherwise("required").alias("review"), F.col("accepted").alias("differs_from"),
    )
    return items.filter(F.col("review") == review) if review else items


def agreement_states(c) -> DataFrame:
    """Per document and field with a value or a proposal: unknown, unresolved, discrepancy, agreement or uncorroborated."""
    open_ = c.metadata_candidate.select("document_id", "field", agreement_key(F.col("field"), F.col("value")).alias("key"), F.col("source").alias("from"), "status")
    held = c.metadata_value.select("document_id", "field", agreement_key(F.col("field"), F.col("value")).alias("held"), "source")
    rows = open_.join(held, ["document_id", "field"], "full_outer")
    voting = F.col("status").isin("proposed", "accepted")
    proposed = F.col("status") == "proposed"
    flag = lambda x: F.max(F.coalesce(x, F.lit(False)).cast("int"))
    groups = rows.groupBy("document_id", "field").agg(
        flag(F.col("held").isNotNull()).alias("has"),
        flag(proposed).alias("proposed"),
        flag(proposed & (F.col("key") != F.col("held"))).alias("other"),
        flag(voting & (F.col("key") == F.col("held")) & (F.col("from") != F.col("source"))).alias("same"),
    )
    state = (
        F.when(F.col("has") == 0, F.when(F.col("proposed") == 1, "unresolved").otherwise("unknown"))
        .when(F.col("other") == 1, "discrepancy")
        .when(F.col("same") == 1, "agreement")
        .otherwise("uncorroborated")
    )
    return groups.select("document_id", "field", state.alias("state"))


def metadata_report(c) -> DataFrame:
    """Per field: documents with a value, open proposals, safe ones and the share of live documents covered."""
    live = c.live.select("document_id")
    total = live.agg(F.count(F.lit(1)).alias("total"))
    held = c.metadata_value.join(live, "document_id", "left_semi").groupBy("field").agg(F.countDistinct("document_id").alias("documents"))
    groups = c.metadata_candidate.filter("status = 'proposed'").groupBy("document_id", "field", "value").agg(F.max((F.col("review") == "safe").cast("int")).alias("safe"))
    opened = groups.groupBy("field").agg(F.count(F.lit(1)).alias("proposals"), F.sum("safe").alias("safe"))
    rows = held.join(opened, "field", "full_outer").crossJoin(total)  # one row on the right
    return rows.select(
        "field", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("proposals", F.lit(0)).alias("proposals"),
        F.coalesce("safe", F.lit(0)).alias("safe"), F.round(F.try_divide(F.coalesce("documents", F.lit(0)), "total"), 4).alias("share"),
    )


def locate(c) -> DataFrame:
    """Per artifact: available, root_offline, missing or unlocated."""
    rows = c.location.filter("NOT ended").join(c.root.select("root_id", F.col("status").alias("root")), "root_id")
    flags = rows.groupBy("artifact_id").agg(
        F.max(((F.col("state") == "active") & (F.col("root") == "online")).cast("int")).alias("here"),
        F.max(((F.col("state") == "active") & (F.col("root") != "online")).cast("int")).alias("offline"),
        F.count(F.lit(1)).alias("locations"),
    )
    state = F.when(F.col("here") == 1, "available").when(F.col("offline") == 1, "root_offline").when(F.col("locations") > 0, "missing").otherwise("unlocated")
    return c.artifact.select("artifact_id").join(flags, "artifact_id", "left").select("artifact_id", state.alias("state"), F.coalesce("locations", F.lit(0)).alias("locations"))


def stats(c) -> DataFrame:
    """(section, metric, value): inventory, health and organisation counts in one table; one aggregation a table."""

    def metrics(rows: DataFrame, **values: Column) -> DataFrame:
        """``section__metric=aggregate`` pairs of one table, turned into rows."""
        counted = rows.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in values.items()])
        named = [F.struct(F.lit(k.partition("__")[0]).alias("section"), F.lit(k.partition("__")[2]).alias("metric"), F.col(k).alias("value")) for k in values]
        return counted.select(F.explode(F.array(*named)).alias("m")).select("m.*")

    def grouped(rows: DataFrame, **names: Column) -> DataFrame:
        """Counts by each of several names of a row, in one pass."""
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), v.alias("metric")) for k, v in names.items()])).alias("p")
        return rows.select(pairs).groupBy("p.section", "p.metric").agg(F.count(F.lit(1)).alias("value"))

    all_ = F.count(F.lit(1))
    now = c.location.filter("NOT ended")
    kinds = now.join(c.artifact.select("artifact_id", "content_kind"), "artifact_id")
    copies = current_copies(c).join(c.artifact.select("artifact_id", F.col("size").alias("bytes")), "artifact_id").groupBy("artifact_id", "bytes").agg(all_.alias("n")).filter("n > 1")
    several = c.document_artifact.join(c.live.select("document_id"), "document_id", "left_semi").groupBy("document_id").count().filter("count > 1")
    path, state = F.col("relative_path"), F.col("state")
    return union(
        [
            metrics(c.root, inventory__roots=all_, health__roots_not_online=F.count_if(F.col("status") != "online")),
            metrics(c.document, inventory__documents=F.count_if(~F.col("retired")), inventory__documents_merged_away=F.count_if("retired")),
            metrics(c.artifact, inventory__artifacts=all_, inventory__total_bytes=F.sum("size")),
            metrics(
                c.location,
                inventory__locations_current=F.count_if(~F.col("ended")),
                inventory__locations_ended=F.count_if("ended"),
                health__locations_missing=F.count_if(~F.col("ended") & (state == "missing")),
                health__locations_inaccessible=F.count_if(~F.col("ended") & (state == "inaccessible")),
            ),
            grouped(kinds, locations_by_state=state, by_extension_kind=extension_kind(path), by_content_kind=F.col("content_kind"), locations_by_root=F.col("root_id")),
            metrics(copies, health__exact_duplicate_groups=all_, health__exact_duplicate_files=F.sum("n"), health__exact_duplicate_bytes_reclaimable=F.sum((F.col("n") - 1) * F.col("bytes"))),
            metrics(kinds, health__extension_content_mismatches=F.count_if(kinds_disagree(path, F.col("content_kind")))),
            metrics(c.collection, organization__collections=F.count_if(~F.col("retired"))),
            metrics(c.document_tag.select("tag_key").distinct(), organization__tags=all_),
            metrics(c.document_relation, organization__document_relations=F.count_if(~F.col("retracted"))),
            metrics(c.relation_candidate, organization__relation_proposals_waiting=F.count_if(F.col("status") == "proposed")),
            metrics(several, organization__documents_with_several_artifacts=all_),
        ]
    )


def tag_list(c) -> DataFrame:
    rows = c.document_tag.join(c.live.select("document_id"), "document_id", "left_semi")
    return rows.groupBy("tag_key").agg(F.min("tag").alias("tag"), F.count(F.lit(1)).alias("documents"))


def collection_sizes(c) -> DataFrame:
    live = c.collection_member.join(c.live.select("document_id"), "document_id", "left_semi").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    return c.collection.filter("NOT retired").join(live, "collection_id", "left").select("collection_id", "name", F.coalesce("n", F.lit(0)).alias("members"))


def explain(c) -> DataFrame:
    """Per document: paths, fields, tags and relations in one row."""
    owned = c.document_artifact.select("document_id", "artifact_id")
    paths = owned.join(c.location.select("artifact_id", "relative_path"), "artifact_id").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("relative_path")), "|").alias("paths"))
    values = c.metadata_value.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("field", F.lit("="), "value"))), "|").alias("fields"))
    tags = c.document_tag.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("tag_key")), "|").alias("tags"))
    ends = related(c).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit(":"), "direction", F.lit(":"), "other_id"))), "|").alias("relations"))
    rows = c.live.select("document_id")
    for side in (paths, values, tags, ends):
        rows = rows.join(side, "document_id", "left")
    return rows.select("document_id", *[F.coalesce(n, F.lit("")).alias(n) for n in ("paths", "fields", "tags", "relations")])


def related(c) -> DataFrame:
    """Live relations seen from both ends: a union of two equi-joinable tables, not an OR join."""
    live = c.document_relation.filter("NOT retracted")
    out = live.select(F.col("source_id").alias("document_id"), "kind", F.lit("out").alias("direction"), F.col("target_id").alias("other_id"), "relation_id")
    back = live.select(F.col("target_id").alias("document_id"), "kind", F.lit("in").alias("direction"), F.col("source_id").alias("other_id"), "relation_id")
    return out.unionByName(back)


BINS = 256


def timing(rows: DataFrame, group: Column, value: Column, item: Column | None = None, size: Column | None = None) -> DataFrame:
    """Median, upper-middle median, nearest-rank p95 and maximum of each group; with ``item`` the slowest, with ``size`` (bytes) the rate.

    Equal values are counted before they move. Bin counts say in which bin an order
    statistic lies, and only those bins' distinct values are put in order, so five
    groups of any size are no five tasks.
    """
    more = [] if item is None else [F.max_by("item", F.struct("v", "item")).alias("slowest")]
    more += [] if size is None else [F.round(F.try_divide(F.sum("size") / 1e6, F.sum("v")), 6).alias("mb_per_s")]
    rows = rows.select(group.alias("g"), value.alias("v"), (F.lit(None) if item is None else item).alias("item"), (F.lit(None) if size is None else size).alias("size")).filter("v IS NOT NULL")
    whole = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("longest"), *more)
    low, high = whole.select(F.col("g").alias("__g"), "n", "least", "longest"), F.col("n")
    width = (F.col("longest") - F.col("least")) / BINS
    bin_ = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("least")) / width))).otherwise(0).cast("int")
    counted = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")).join(low, F.col("g").eqNullSafe(F.col("__g"))).withColumn("bin", bin_).drop("__g")
    bins = counted.groupBy("g", "bin", "n").agg(F.sum("c").alias("c"))
    before = F.sum("c").over(Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn("before", F.coalesce(before, F.lit(0)))
    places = {"lower": F.floor((high - 1) / 2), "upper": F.floor(high / 2), "p95": F.least(high - 1, F.floor(high * F.lit(0.95)))}
    wanted = bins.select("g", "bin", "before", "c", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), p.cast("long").alias("i")) for k, p in places.items()])).alias("p"))
    wanted = wanted.filter((F.col("p.i") >= F.col("before")) & (F.col("p.i") < F.col("before") + F.col("c"))).select(F.col("g").alias("__g"), F.col("bin").alias("__bin"), "before", "p.k", "p.i")
    inside = counted.select("g", "bin", "v", "c").join(wanted, F.col("g").eqNullSafe(F.col("__g")) & (F.col("bin") == F.col("__bin")))
    upto = F.sum("c").over(Window.partitionBy("g", "bin", "k").orderBy("v")) + F.col("before")
    found = inside.withColumn("upto", upto).filter((F.col("i") < F.col("upto")) & (F.col("i") >= F.col("upto") - F.col("c")))
    found = found.groupBy(F.col("g").alias("__g")).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in places])
    out = whole.join(found, F.col("g").eqNullSafe(F.col("__g")))
    names = [n for n, given in (("slowest", item), ("mb_per_s", size)) if given is not None]
    return out.select("g", "n", ((F.col("lower") + F.col("upper")) / 2).alias("median"), F.col("upper").alias("upper_median"), "p95", "longest", *names)


def placed(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Rows with their 0-based place in the whole order: ranges are sorted apart, and counts of the ranges before say where each begins."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = cut(rows, "ordered").withColumn("__part", F.shiftright("__at", 33))
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))  # one row a range
    return rows.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__first")


PREFIX = 8  # fixed value: hexadecimal digits that name an artifact, up to 63


def resolve_names(c, names: DataFrame) -> DataFrame:
    """Names (column ``name``) to documents: id, hash, path or its end, file name, hash prefix; the first kind that matches wins.

    Paths and file names of the present come before those of the past. The ends of a
    path are its suffixes at folder borders, so a name is one equi-join.
    """
    live = c.live.select("document_id")
    owned = c.document_artifact.select("document_id", "artifact_id").join(live, "document_id", "left_semi")
    parts = F.split("relative_path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    places = owned.join(c.location.select("artifact_id", "relative_path", "ended"), "artifact_id").select("document_id", "ended", F.posexplode(ends).alias("depth", "key"), F.size(parts).alias("n"))
    rank = F.when(F.col("depth") == 0, 2).when(F.col("depth") < F.col("n") - 1, 3).otherwise(4) + F.when(F.col("ended"), 3).otherwise(0)
    short = names.filter(F.col("name").rlike("^[0-9a-f]{%d,63}$" % PREFIX)).withColumn("key", F.substring("name", 1, PREFIX))
    found = [
        names.join(live, names["name"] == live["document_id"]).select("name", "document_id", F.lit(0).alias("kind")),
        names.join(owned, names["name"] == owned["artifact_id"]).select("name", "document_id", F.lit(1).alias("kind")),
        names.join(places, names["name"] == places["key"]).select("name", "document_id", rank.alias("kind")),
        short.join(owned.withColumn("key", F.substring("artifact_id", 1, PREFIX)), "key").filter(F.startswith("artifact_id", F.col("name"))).select("name", "document_id", F.lit(8).alias("kind")),
    ]
    rows = union(found).distinct()
    best = rows.groupBy("name").agg(F.min("kind").alias("kind"))
    hits = rows.join(best, ["name", "kind"]).groupBy("name").agg(F.countDistinct("document_id").alias("n"), F.min("document_id").alias("document_id"))
    rows = names.join(hits, "name", "left")
    outcome = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return rows.select("name", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("document_id")).alias("document_id"))


# --------------------------------------------------------------------- doctor


def doctor(c) -> DataFrame:
    """Findings (category, severity, code, subject)."""
    from doclake.operators.relate import ACYCLIC, reachable  # relate builds on the views

    def finding(rows: DataFrame, category: str, severity: str, code: str, subject: Column | str) -> DataFrame:
        subject = F.col(subject) if isinstance(subject, str) else subject
        return rows.select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"))

    live, owned = c.live.select("document_id"), c.document_artifact
    pdf = c.artifact.filter("content_kind = 'pdf'").select("artifact_id")
    ext = c.extraction.join(pdf, "artifact_id", "left_semi")
    retired = c.document.filter("retired").select("document_id", "merged_into")
    target = c.document.select(F.col("document_id").alias("merged_into"), F.col("retired").alias("target_retired"))
    merged = retired.join(target, "merged_into", "left")
    by_root = c.location.filter("NOT ended").groupBy("root_id", "state").count()
    ends = c.document_relation.filter("NOT retracted").select("relation_id", F.explode(F.array("source_id", "target_id")).alias("document_id"))
    values = c.metadata_value.filter("field <> 'authors'")
    canonical = normalise(F.col("field"), F.col("value"))
    dangling = c.metadata_value.filter("source_candidate_id IS NOT NULL").join(
        c.metadata_candidate.select(F.col("candidate_id").alias("source_candidate_id")), "source_candidate_id", "left_anti"
    )
    foreign = c.candidate_source.join(owned.select("document_id", "artifact_id"), ["document_id", "artifact_id"], "left_anti")
    newest = c.run.groupBy("root_id").agg(F.max("started").alias("newest"))
    cycles = union([reachable(c.document_relation, kind).filter("start = node").select(F.concat(F.lit(f"{kind}:"), "start").alias("at")) for kind in ACYCLIC])
    counted = lambda rows: rows.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    pages = c.page.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("pages"))
    return union(
        [
            finding(c.run.join(newest, "root_id").filter("status = 'running' AND started < newest"), "catalog", "warning", "stale_run", "run_id"),
            finding(foreign, "metadata", "error", "proposal_from_wrong_artifact", "candidate_id"),
            finding(cycles, "relationships", "error", "relation_cycle", "at"),
            finding(c.extraction.join(pages, "artifact_id", "left").filter("page_count <> coalesce(pages, 0)"), "extraction", "error", "page_count_mismatch", "artifact_id"),
            finding(live.join(owned.filter("canonical"), "document_id", "left_anti"), "catalog", "error", "no_canonical", "document_id"),
            finding(c.artifact.join(owned, "artifact_id", "left_anti"), "catalog", "error", "artifact_without_document", "artifact_id"),
            finding(c.location.filter("ended AND end_reason = 'moved' AND successor_location_id IS NULL"), "catalog", "error", "move_without_successor", "location_id"),
            finding(c.root.filter("status <> 'online'"), "filesystem", "warning", "root_not_online", "root_id"),
            finding(c.root.filter("never_scanned"), "filesystem", "info", "never_scanned", "root_id"),
            finding(by_root.filter("state = 'missing'"), "filesystem", "warning", "missing_locations", F.concat_ws(":", "root_id", "count")),
            finding(by_root.filter("state = 'inaccessible'"), "filesystem", "warning", "inaccessible_locations", F.concat_ws(":", "root_id", "count")),
            finding(counted(pdf.join(c.extraction, "artifact_id", "left_anti")), "extraction", "info", "not_extracted", "n"),
            finding(counted(c.extraction.join(pdf, "artifact_id", "left_anti")), "extraction", "warning", "orphan_extraction", "n"),
            finding(counted(ext.filter("source <> 'imported' AND profile_id <> 'current'")), "extraction", "warning", "stale_extraction", "n"),
            finding(counted(ext.filter("status = 'partial'")), "extraction", "warning", "partial_extraction", "n"),
            finding(counted(ext.filter("status = 'failed'")), "extraction", "warning", "failed_extraction", "n"),
            finding(counted(ext.filter("source = 'imported'")), "extraction", "info", "provisional_import", "n"),
            finding(values.filter(~canonical.eqNullSafe(F.col("value"))), "metadata", "error", "value_not_canonical", F.concat_ws(":", "document_id", "field")),
            finding(c.metadata_value.filter("field = 'doi'").groupBy("value").count().filter("count > 1"), "metadata", "warning", "doi_collision", F.concat_ws(":", "value", "count")),
            finding(dangling, "metadata", "error", "value_without_source", F.concat_ws(":", "document_id", "field")),
            finding(merged.filter("target_retired IS NULL"), "relationships", "error", "retired_without_survivor", "document_id"),
            finding(merged.filter("target_retired"), "relationships", "warning", "merge_chain", "document_id"),
            finding(retired.join(owned, "document_id", "left_semi"), "relationships", "error", "retired_holds_artifacts", "document_id"),
            finding(ends.join(retired, "document_id", "left_semi").select("relation_id").distinct(), "relationships", "warning", "relation_to_retired", "relation_id"),
        ]
    )


def duplicate_key_report(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Uniqueness that a database would enforce: (table, key) values that occur more than once."""
    return union(
        [rows.groupBy(F.concat_ws("|", *keys).alias("key")).count().filter("count > 1").select(F.lit(name).alias("table"), "key", "count") for name, (rows, keys) in tables.items()]
    )
