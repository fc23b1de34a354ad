"""Scan runs, root states, transitions as events, extraction records and what reports say of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions.identifiers import find_doi
from doclake.functions.naming import within
from doclake.functions.text import is_scanned
from doclake.operators.views import union

# How much of a document its record quotes, and the transitions that are events.
DOI_PAGES, FIRST_CHARS, NEWEST = 2, 600, 25
EVENTS = ("new_location", "new_artifact", "replaced", "reappeared", "missing", "inaccessible", "touched")


def gated(result: DataFrame, probes: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Outcomes of ``lifecycle.reconcile`` after looking at the roots themselves.

    ``probes``: (root_id, status); under a root that is not online nothing changes
    (``root_unavailable``). ``unreadable``: (root_id, directory) that could not be
    listed; what is gone below one is inaccessible, not missing.
    """
    rows = result.join(probes.select("root_id", F.col("status").alias("probe")), "root_id", "left")
    below = rows.filter("result = 'missing'").select("root_id", "path_key").join(unreadable, "root_id").filter(within(F.col("path_key"), F.col("directory")))
    rows = rows.join(below.select("root_id", "path_key").distinct().withColumn("below", F.lit(True)), ["root_id", "path_key"], "left")
    outcome = F.when(F.coalesce("probe", F.lit("online")) != "online", "root_unavailable").when(F.col("below"), "inaccessible").otherwise(F.col("result"))
    return rows.select("root_id", "path_key", "old_artifact", "artifact_id", outcome.alias("result"))


def closed_runs(runs: DataFrame) -> DataFrame:
    """Runs (run_id, root_id, started, status) as a new scan leaves them: what still runs was killed."""
    return runs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def stale_runs(runs: DataFrame) -> DataFrame:
    """Runs that say they are running though a later one of their root has started."""
    last = runs.groupBy("root_id").agg(F.max("started").alias("last"))
    return runs.join(last, "root_id").filter("status = 'running' AND started < last").select("run_id", "root_id", "started")


def last_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each root, and of all (root_id null), with its status."""
    newest = F.max_by(F.struct("run_id", "status", "started"), F.struct("started", "run_id")).alias("r")
    each = runs.groupBy("root_id").agg(newest)
    return union([each, runs.agg(newest).select(F.lit(None).cast("string").alias("root_id"), "r")]).select("root_id", "r.run_id", "r.status", "r.started")


def transitions(result: DataFrame, run: str) -> DataFrame:
    """An event for each path whose state changed."""
    return result.filter(F.col("result").isin(*EVENTS)).select(F.lit(run).alias("run_id"), "root_id", "path_key", F.col("result").alias("event"), F.coalesce("artifact_id", "old_artifact").alias("artifact_id"))


def overlapping_roots(roots: DataFrame, wanted: DataFrame, catalog_path: str) -> DataFrame:
    """(path, outcome) of adding roots: contains_catalog, exists, overlaps or added. Paths are joined on their ancestors, never all with all."""

    def ancestors(path: Column) -> Column:
        parts = F.split(path, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))

    held = roots.select(F.col("root_key").alias("held")).distinct()
    new = wanted.select("path").distinct()
    above = new.select("path", F.explode(ancestors(F.col("path"))).alias("held")).join(held, "held").select("path", "held")
    below = held.select("held", F.explode(ancestors(F.col("held"))).alias("path")).join(new, "path").select("path", "held")
    hits = union([above, below]).groupBy("path").agg(F.bool_or(F.col("held") == F.col("path")).alias("same"))
    rows = new.join(hits, "path", "left")
    inside = within(F.lit(catalog_path), F.col("path"))
    return rows.select("path", F.when(inside, "contains_catalog").when(F.col("same"), "exists").when(F.col("same").isNotNull(), "overlaps").otherwise("added").alias("outcome"))


# ----------------------------------------------------------------- extraction


def page_spans(page: DataFrame) -> DataFrame:
    """First and last page and their number for each artifact."""
    return page.groupBy("artifact_id").agg(F.min("pdf_page").alias("first_page"), F.max("pdf_page").alias("last_page"), F.count(F.lit(1)).alias("pages"))


def page_count_mismatches(extraction: DataFrame, page: DataFrame) -> DataFrame:
    """Extractions whose page count is not the number of their page rows."""
    rows = extraction.select("artifact_id", "page_count").join(page_spans(page), "artifact_id", "left")
    return rows.filter("page_count <> coalesce(pages, 0)").select("artifact_id", "page_count", F.coalesce("pages", F.lit(0)).alias("pages"))


def records(page: DataFrame) -> DataFrame:
    """What an extraction stores of each artifact: characters, pages, whether it looks scanned, the first DOI and the first words."""
    front = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pdf_page") <= DOI_PAGES, F.struct("pdf_page", "text")))), lambda p: p["text"]), "\n")
    rows = page.groupBy("artifact_id").agg(
        F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("page_count"), front.alias("front"), F.max(F.when(F.col("pdf_page") == 1, F.substring("text", 1, FIRST_CHARS))).alias("first")
    )
    return rows.select(
        "artifact_id", "chars", "page_count", is_scanned(F.col("chars"), F.col("page_count")).alias("scanned"),
        F.nullif(find_doi(F.col("front")), F.lit("")).alias("first_doi"), F.nullif("first", F.lit("")).alias("first_text"),
    )


def stored_records(stored: DataFrame, new: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(artifact_id, outcome): replaced or added records; nothing is stored where the file's size or time changed.

    ``before`` and ``after``: (artifact_id, size, modified) around the reading; ``stored``
    and ``new``: (artifact_id).
    """
    now = after.select("artifact_id", F.struct("size", "modified").alias("now"))
    rows = new.select("artifact_id").join(before.select("artifact_id", F.struct("size", "modified").alias("then")), "artifact_id", "left").join(now, "artifact_id", "left")
    rows = rows.join(stored.select("artifact_id").withColumn("had", F.lit(True)), "artifact_id", "left")
    same = F.coalesce(F.col("then") == F.col("now"), F.lit(False))
    return rows.select("artifact_id", F.when(~same, "changed").when(F.col("had"), "replaced").otherwise("added").alias("outcome"))


# -------------------------------------------------------------------- reports


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, place): values by how often they occur, ties by value."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")))  # one row a value


def newest(events: DataFrame, key: str, order: list[str], most: int = NEWEST) -> DataFrame:
    """The newest events of each key; only that many of a key leave a map task."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("place", place).filter(F.col("place") <= most)


def caveats(coverage: DataFrame) -> DataFrame:
    """(caveat, n) of a coverage row: what a search could not see; ``nothing_searchable`` is an error and not a caveat."""
    names = ("not_yet_extracted", "no_text_layer", "partially_indexed", "extraction_failed")
    pairs = F.array(*[F.struct(F.lit(n).alias("caveat"), F.col(n).cast("long").alias("n")) for n in names])
    rows = coverage.select("searchable", F.explode(pairs).alias("p"))
    some = rows.filter("searchable > 0 AND p.n > 0").select("p.*")
    return some.unionByName(coverage.filter("searchable = 0").select(F.lit("nothing_searchable").alias("caveat"), F.lit(0).cast("long").alias("n")))


def health_lines(stats: DataFrame) -> DataFrame:
    """(place, line) of the health report, from (section, metric, value) rows."""
    words = {
        "locations_missing": "paths whose file is missing", "locations_inaccessible": "paths that cannot be read", "roots_not_online": "roots out of reach",
        "extension_content_mismatches": "files whose name and contents disagree", "exact_duplicate_groups": "files at more than one path",
    }
    order = F.create_map(*[F.lit(x) for i, k in enumerate(words) for x in (k, i)])
    text = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    rows = stats.filter((F.col("section") == "health") & F.col("metric").isin(*words) & (F.col("value") > 0))
    return rows.select(F.element_at(order, F.col("metric")).alias("place"), F.concat_ws(" ", F.col("value").cast("string"), F.element_at(text, F.col("metric"))).alias("line"))


PREFERRED = ("excerpt", "page", "region", "provider", "state", "verdict", "reasons", "components", "cues", "foreign_cues")  # fixed values: shown first
MAX_VALUE = 300


def evidence_lines(rows: DataFrame, column: str = "evidence") -> DataFrame:
    """(candidate_id, place, name, value) of a flat JSON object: what explains most first, empty facts left out, long values cut."""
    pairs = F.explode(F.map_entries(F.from_json(column, "map<string,string>"))).alias("e")
    value = F.btrim(F.regexp_replace("e.value", r"\s+", " "))
    facts = rows.select("candidate_id", pairs).select("candidate_id", F.col("e.key").alias("name"), value.alias("value")).filter("value IS NOT NULL AND value NOT IN ('', '[]', '{}', 'null')")
    cut = F.when(F.length("value") <= MAX_VALUE, F.col("value")).otherwise(F.concat(F.substring("value", 1, MAX_VALUE - 1), F.lit("…")))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(PREFERRED) for x in (k, i)]), F.col("name")), F.lit(len(PREFERRED)))
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy(rank, "name"))
    return facts.select("candidate_id", place.alias("place"), "name", cut.alias("value"))


def envelope(rows: DataFrame, kind: str) -> DataFrame:
    """One JSON document a row, with its kind: what a caller outside Spark reads."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), *[F.col(c) for c in sorted(rows.columns)])).alias("record"))


def revision(outcomes: DataFrame, now: int, unchanged: tuple[str, ...] = ("unchanged", "decided", "kept", "held")) -> DataFrame:
    """(revision) after a batch of outcomes: one more if anything changed."""
    changed = F.coalesce(F.bool_or(~F.col("outcome").isin(*unchanged)), F.lit(False))
    return outcomes.agg((F.lit(now) + changed.cast("int")).cast("long").alias("revision"))
