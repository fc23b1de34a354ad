"""Search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.functions.text import terms
from doclake.operators import cursor, filters, search
from doclake.plans.corpus_sql import fold, sql
from doclake.session import once, scratch_path, stamp
from doclake.sources.corpus import Catalog

TOP = 20


def _search(spark: SparkSession, sf_dir: str, query: search.Query, offset: int = 0) -> DataFrame:
    catalog = Catalog(spark, sf_dir)
    scope = None
    if query.filters or query.path:
        scope = catalog.page.select("page_id", "artifact_id")
        if query.filters:
            docs = filters.filtered(catalog, query.filters)
            scope = scope.join(catalog.document_artifact.join(docs, "document_id", "left_semi"), "artifact_id", "left_semi")
        if query.path:
            scope = scope.join(filters.path_scope(catalog.location, query.path), "artifact_id", "left_semi")
    hits = search.search_pages(index(catalog), query, scope)
    return search.ranked(hits, catalog.page, TOP, offset)


def index(catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """The catalog's stored index; pages are tokenised the first time it is asked for."""
    spark = catalog.spark

    def build() -> tuple[DataFrame, DataFrame]:
        path = scratch_path(spark, "index")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        search.store_index(search.build_index(catalog.page), path, buckets)
        return search.open_index(spark, path)

    return once(spark, (catalog.sf_dir, stamp(spark, f"{catalog.sf_dir}/documents.parquet"), "index"), build)


QUERY_OF = {
    "search_phrase": search.parse_query("of the"),
    "search_prefix": search.parse_query("thnt*"),
    "search_alternatives": search.parse_query("pour la | und der | and the"),
    "search_near": search.parse_query("the", near=["and"], within=3),
    "search_near_three": search.parse_query("of the", near=["and", "is"], within=12),
    "search_also": search.parse_query("the", also=["of", "by"]),
    "search_filtered": search.parse_query("the year:2000-2015 kind:pdf author:Fam1"),
    "search_tagged": search.parse_query('the | la tag:"good text"'),
    "search_path": search.parse_query("the", path="EN\\src1"),
    "search_collection": search.parse_query('die collection:"texts in de"'),
    "search_accents": search.parse_query("elle"),
}

TERMS = rf"""
tokens AS (SELECT page_id, regexp_extract_all({fold("text")}, '[\p{{L}}\p{{N}}]+') AS t FROM page WHERE chars > 0),
lengths AS (SELECT page_id, len(t) AS length FROM tokens),
terms AS (SELECT page_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tokens)
"""


def _words(text: str) -> list[str]:
    return text.rstrip("*").split()


def _instances_sql(text: str) -> str:
    words = _words(text)
    joins, conditions = [], []
    for i, word in enumerate(words):
        last = i == len(words) - 1 and text.endswith("*")
        conditions.append(f"t{i}.term LIKE '{word}%'" if last else f"t{i}.term = '{word}'")
        if i:
            joins.append(f"JOIN terms t{i} ON t{i}.page_id = t0.page_id AND t{i}.pos = t0.pos + {i}")
    return f"SELECT t0.page_id, t0.pos AS start, t0.pos + {len(words) - 1} AS last FROM terms t0 {' '.join(joins)} WHERE {' AND '.join(conditions)}"


def _search_sql(query: search.Query, scope: str = "", offset: int = 0) -> str:
    ctes, counted, hits = [TERMS.strip()], [], []
    for a, text in enumerate(query.alternatives):
        parts = [text, *query.near]
        names = [f"i{a}_{j}" for j in range(len(parts))]
        ctes += [f"{n} AS ({_instances_sql(p)})" for n, p in zip(names, parts, strict=True)]
        if query.near:
            starts = ", ".join(f"{n}.start AS s{j}" for j, n in enumerate(names))
            far = "list_max([" + ", ".join(f"{n}.start" for n in names) + "])"
            first = "list_sort([" + ", ".join(f"{{'s': {n}.start, 'l': {n}.last}}" for n in names) + "])[1].l"
            joins = " ".join(f"JOIN {n} ON {n}.page_id = {names[0]}.page_id" for n in names[1:])
            ctes.append(f"g{a} AS (SELECT {names[0]}.page_id, {starts} FROM {names[0]} {joins} WHERE {far} - {first} - 1 <= {query.within})")
            for j, n in enumerate(names):
                counted.append((f"(SELECT DISTINCT page_id, s{j} FROM g{a})", n))
            hits.append(f"SELECT page_id FROM g{a}")
        else:
            counted.append((names[0], names[0]))
            hits.append(f"SELECT page_id FROM {names[0]}")
    where = ""
    for j, text in enumerate(query.also):
        ctes.append(f"also{j} AS ({_instances_sql(text)})")
        counted.append((f"also{j}", f"also{j}"))
        where += f" AND page_id IN (SELECT page_id FROM also{j})"
    if scope:
        where += f" AND page_id IN (SELECT page_id FROM page WHERE artifact_id IN ({scope}))"
    ctes.append(f"hits AS (SELECT DISTINCT page_id FROM ({' UNION ALL '.join(hits)}) WHERE true{where})")
    ctes.append("corpus AS (SELECT count(*) AS total, avg(length) AS mean FROM lengths)")
    parts = " UNION ALL ".join(
        f"SELECT page_id, count(*) AS f, (SELECT count(DISTINCT page_id) FROM {n}) AS n FROM {p} GROUP BY page_id" for p, n in counted
    )
    ctes.append(f"parts AS ({parts})")
    idf = "CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END"
    ctes.append(
        f"scored AS (SELECT page_id, -sum({idf} * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))) AS rank "
        "FROM parts JOIN lengths USING (page_id), corpus WHERE page_id IN (SELECT page_id FROM hits) GROUP BY page_id)"
    )
    return sql(
        "SELECT page_id, artifact_id, pdf_page, round(rank, 6) AS rank FROM scored JOIN page USING (page_id) "
        f"ORDER BY round(rank, 6), artifact_id, pdf_page LIMIT {TOP + 1} OFFSET {offset}",
        *ctes,
    )


OWNED = "SELECT artifact_id FROM document_artifact WHERE document_id IN (SELECT document_id FROM live) AND document_id IN ({}) "
SCOPES = {
    "search_filtered": OWNED.format("SELECT document_id FROM metadata_value WHERE field = 'year' AND TRY_CAST(value AS INTEGER) BETWEEN 2000 AND 2015")
    + "AND document_id IN (SELECT document_id FROM document_artifact JOIN artifact USING (artifact_id) WHERE content_kind = 'pdf') "
    "AND document_id IN (SELECT document_id FROM metadata_value WHERE field = 'authors' AND contains(value, '\"Fam1'))",
    "search_tagged": OWNED.format("SELECT document_id FROM document_tag WHERE tag_key = 'good text'"),
    "search_path": "SELECT artifact_id FROM location WHERE contains(lower(relative_path), 'en/src1')",
    "search_collection": OWNED.format(
        "SELECT document_id FROM collection_member JOIN collection USING (collection_id) WHERE NOT retired AND lower(name) = 'texts in de'"
    ),
}


def search_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that the first page's cursor leads to."""
    query = QUERY_OF["search_phrase"]
    listing = cursor.Listing(1, cursor.question("search", query=str(query)))
    keys = [f"{r['artifact_id']}:{r['pdf_page']}" for r in _search(spark, sf_dir, query).collect()]  # one page
    following = listing.following(0, keys[:TOP], len(keys) > TOP)
    if following is None:
        return _search(spark, sf_dir, query, offset=len(keys))
    return _search(spark, sf_dir, query, offset=listing.start(following, lambda i: keys[i]))


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per term: pages and occurrences over the whole index."""
    page_terms, _ = index(Catalog(spark, sf_dir))
    return page_terms.groupBy("term").agg(F.countDistinct("page_id").alias("pages"), F.count(F.lit(1)).alias("occurrences"))


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lengths = index(Catalog(spark, sf_dir))
    return lengths.agg(F.count(F.lit(1)).alias("pages"), F.sum("length").alias("tokens"), F.round(F.avg("length"), 6).alias("mean_length"))


def search_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    return filters.coverage(c.artifact, c.extraction, c.page, filters.filtered(c, QUERY_OF["search_filtered"].filters))


def search_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with document, paths, availability and the provisional flag: joins, not a lookup a hit."""
    c = Catalog(spark, sf_dir)
    hits = _search(spark, sf_dir, QUERY_OF["search_phrase"])
    paths = c.location.filter("NOT ended").groupBy("artifact_id").agg(F.array_join(F.array_sort(F.collect_set("relative_path")), "|").alias("paths"))
    here = filters.available(c.document_artifact, c.location, c.root).withColumn("available", F.lit(True))
    return (
        hits.join(c.document_artifact.select("artifact_id", "document_id"), "artifact_id")
        .join(paths, "artifact_id", "left")
        .join(here, "document_id", "left")
        .join(c.extraction.select("artifact_id", (F.col("source") == "imported").alias("provisional")), "artifact_id", "left")
        .select(
            F.concat_ws(":", "artifact_id", "pdf_page").alias("hit_key"), "document_id", "rank", F.coalesce("paths", F.lit("")).alias("paths"),
            F.coalesce("available", F.lit(False)).alias("available"), F.coalesce("provisional", F.lit(False)).alias("provisional"),
        )
    )


def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with a marked excerpt around the phrase's first place."""
    c = Catalog(spark, sf_dir)
    phrase = search.phrase_of(spark, "of the")
    hits = _search(spark, sf_dir, QUERY_OF["search_phrase"]).select("page_id", "rank")
    return hits.join(c.page.select("page_id", "text"), "page_id").select("page_id", "rank", search.snippet(F.col("text"), phrase).alias("snippet"))


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of every artifact with its state."""
    return Catalog(spark, sf_dir).page.filter("pdf_page = 3").select("artifact_id", "pdf_page", F.substring("text", 1, 20_000).alias("text"), F.size(terms(F.col("text"))).alias("n_terms"))


QUERIES = {name: (lambda s, d, q=q: _search(s, d, q)) for name, q in QUERY_OF.items()} | {
    "search_second_page": search_second_page,
    "search_enriched": search_enriched,
    "search_snippets": search_snippets,
    "search_coverage": search_coverage,
    "index_terms": index_terms,
    "index_statistics": index_statistics,
    "page_lookup": page_lookup,
}
ORACLES = {name: _search_sql(q, SCOPES.get(name, "")) for name, q in QUERY_OF.items()} | {
    "search_second_page": _search_sql(QUERY_OF["search_phrase"], offset=TOP),
    "search_enriched": sql(
        """SELECT artifact_id || ':' || pdf_page AS hit_key, document_id, rank,
             coalesce((SELECT string_agg(DISTINCT relative_path, '|' ORDER BY relative_path) FROM location l
                       WHERE l.artifact_id = h.artifact_id AND NOT ended), '') AS paths,
             document_id IN (SELECT a.document_id FROM document_artifact a JOIN location l USING (artifact_id) JOIN root r USING (root_id)
                             WHERE NOT l.ended AND l.state = 'active' AND r.status = 'online') AS available,
             coalesce(artifact_id IN (SELECT artifact_id FROM extraction WHERE source = 'imported'), false) AS provisional
           FROM h JOIN document_artifact USING (artifact_id)""",
        "h AS (SELECT * FROM (" + _search_sql(QUERY_OF["search_phrase"]) + "))",
    ),
    "search_snippets": sql(
        r"""SELECT page_id, rank, CASE WHEN start > 0 THEN ' ... ' ELSE '' END
              || array_to_string(list_transform(w, lambda x, i: CASE WHEN i - 1 >= hit AND i - 1 < hit + 2 THEN '[[' || x || ']]' ELSE x END)[start + 1 : start + 24], ' ')
              || CASE WHEN len(w) > start + 24 THEN ' ... ' ELSE '' END AS snippet
            FROM (SELECT *, greatest(0, coalesce(hit, 0) - 11) AS start FROM (
              SELECT *, list_filter(range(0, len(w)), lambda i: f[i + 1] = 'of' AND f[i + 2] = 'the')[1] AS hit FROM (
                SELECT page_id, rank, regexp_split_to_array(trim(text), '\s+') AS w,
                       list_transform(regexp_split_to_array(trim(text), '\s+'), lambda x: regexp_replace(strip_accents(lower(x)), '[^\p{L}\p{N}]+', '', 'g')) AS f
                FROM h JOIN page USING (page_id))))""",
        "h AS (SELECT page_id, rank FROM (" + _search_sql(QUERY_OF["search_phrase"]) + "))",
    ),
    "search_coverage": sql(
        """SELECT count(*) FILTER (WHERE p) AS pdf_documents, count(*) FILTER (WHERE p AND status <> 'failed') AS searchable,
             count(*) FILTER (WHERE p AND status = 'partial') AS partially_indexed,
             count(*) FILTER (WHERE p AND status <> 'failed' AND source = 'imported') AS provisional_imported,
             count(*) FILTER (WHERE p AND status = 'failed') AS extraction_failed,
             count(*) FILTER (WHERE p AND status IS NULL) AS not_yet_extracted,
             count(*) FILTER (WHERE p AND status <> 'failed' AND artifact_id NOT IN (SELECT artifact_id FROM page WHERE chars > 0)) AS no_text_layer,
             count(*) FILTER (WHERE NOT p) AS other_files_not_searchable, (SELECT count(DISTINCT document_id) FROM document_artifact WHERE artifact_id IN ({})) AS documents_matching
           FROM (SELECT a.artifact_id, content_kind = 'pdf' AS p, status, source FROM artifact a LEFT JOIN extraction e USING (artifact_id))""".replace("{}", SCOPES["search_filtered"])
    ),
    "index_terms": sql("SELECT term, count(DISTINCT page_id) AS pages, count(*) AS occurrences FROM terms GROUP BY term", TERMS.strip()),
    "index_statistics": sql("SELECT count(*) AS pages, sum(length)::BIGINT AS tokens, round(avg(length), 6) AS mean_length FROM lengths", TERMS.strip()),
    "page_lookup": sql(
        rf"""SELECT artifact_id, pdf_page, left(text, 20000) AS text,
               len(regexp_extract_all({fold("text")}, '[\p{{L}}\p{{N}}]+'))::INTEGER AS n_terms FROM page WHERE pdf_page = 3"""
    ),
}
