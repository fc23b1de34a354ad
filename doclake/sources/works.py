"""Provider records: JSON to a fixed work schema, and lookups as joins on a static table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.identifiers import normalise_doi
from doclake.functions.text import alnum_key, clean
from doclake.operators.pairs import spread_join
from doclake.session import cut

# Fixed value: the fields of a provider's message that are read.
MESSAGE = (
    "struct<DOI:string,title:array<string>,subtitle:array<string>,author:array<struct<family:string,given:string,name:string>>,"
    "issued:struct<`date-parts`:array<array<int>>>,`published-print`:struct<`date-parts`:array<array<int>>>,"
    "`published-online`:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,publisher:string,type:string,"
    "volume:string,issue:string,page:string,score:double>"
)


def _first(values: Column) -> Column:
    return F.nullif(clean(F.get(values, F.lit(0))), F.lit(""))


def _year(date: Column) -> Column:
    return F.get(F.get(date["date-parts"], F.lit(0)), F.lit(0))


def normalise_works(raw: DataFrame, column: str = "json") -> DataFrame:
    """One fixed record per message; a message that is no JSON gives nulls."""
    m = F.from_json(F.col(column), MESSAGE)
    year = F.coalesce(_year(m["issued"]), _year(m["published-print"]), _year(m["published-online"]))
    return raw.select(
        normalise_doi(m["DOI"]).alias("doi"),
        _first(m["title"]).alias("title"),
        _first(m["subtitle"]).alias("subtitle"),
        F.coalesce(m["author"], F.array().cast("array<struct<family:string,given:string,name:string>>")).alias("authors"),
        year.alias("year"),
        _first(m["container-title"]).alias("container"),
        m["publisher"].alias("publisher"),
        m["type"].alias("type"),
        m["volume"].alias("volume"),
        m["issue"].alias("issue"),
        m["page"].alias("pages"),
        (m["type"] == "posted-content").alias("preprint"),
        m["score"].alias("score"),
    )


def lookup_dois(wanted: DataFrame, works: DataFrame) -> DataFrame:
    """Works by DOI; a DOI without one is a row with nulls."""
    return wanted.join(works, "doi", "left")


def lookup_titles(wanted: DataFrame, works: DataFrame) -> DataFrame:
    """(document_id, work columns) for equal title keys, which meet as digests; similarity is judged afterwards.

    The digests are made once and stored: rows are counted by them before they are joined.
    """
    key = F.unhex(F.sha2(alnum_key(F.col("title")).cast("binary"), 256))
    wanted, works = cut(wanted.withColumn("key", key).drop("title"), "wanted"), cut(works.withColumn("key", key), "works")
    return spread_join(wanted, works, ["key"]).drop("key")
