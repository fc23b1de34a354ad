"""Collections, tags, saved searches and scopes: set operations on (container, document) rows.

Every operation takes the rows as they are and what is asked, and gives the rows as
they will be, so that one write replaces one table.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.functions.text import name_key
from doclake.operators import views
from doclake.operators.search import Query, QueryError

LANGUAGE = 1  # fixed value: version of the saved query's language
SCOPES = ("view", "collection", "tag")


def added(members: DataFrame, asked: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Members with what is asked for and new, live documents only; (keys, outcome added, held or refused) of each ask."""
    asked = asked.select(*keys).distinct()
    held = members.select(*keys).distinct().withColumn("held", F.lit(True))
    known = live.select("document_id").distinct().withColumn("known", F.lit(True))
    rows = asked.join(held, keys, "left").join(known, "document_id", "left")
    return rows.select(*keys, F.when(F.col("known").isNull(), "refused").when(F.col("held"), "held").otherwise("added").alias("outcome"))


def removed(members: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The members that stay."""
    return members.join(asked.select(*keys).distinct(), keys, "left_anti")


def tagged(tags: DataFrame, documents: DataFrame, wanted: list[str], live: DataFrame) -> DataFrame:
    """Tags (document_id, tag_key, tag) after giving each document each of ``wanted``; the spelling that was there first stays."""
    words = documents.select("document_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("tag")) for i, w in enumerate(wanted)])).alias("t"))
    clean = F.btrim(F.regexp_replace("t.tag", r"\s+", " "))
    words = words.select("document_id", name_key(F.col("t.tag")).alias("tag_key"), clean.alias("tag"), F.col("t.i").alias("i")).filter("tag_key IS NOT NULL")
    words = words.join(live.select("document_id"), "document_id", "left_semi").groupBy("document_id", "tag_key").agg(F.min_by("tag", "i").alias("tag"))
    return tags.select("document_id", "tag_key", "tag").unionByName(words.join(tags.select("document_id", "tag_key"), ["document_id", "tag_key"], "left_anti"))


def group_collections(proposals: DataFrame, collections: DataFrame, members: DataFrame, live: DataFrame) -> DataFrame:
    """(name_key, collection_id, document_id, outcome) of accepting group proposals (name, members).

    A live collection of that name is used again, else its id is the key's hash; members
    that were merged away since are skipped.
    """
    rows = proposals.select(name_key(F.col("name")).alias("name_key"), F.explode("members").alias("document_id")).distinct()
    here = collections.filter("NOT retired").select(name_key(F.col("name")).alias("name_key"), "collection_id").groupBy("name_key").agg(F.min("collection_id").alias("held_id"))
    rows = rows.join(here, "name_key", "left").withColumn("collection_id", F.coalesce("held_id", F.concat(F.lit("col-"), F.substring(F.md5(F.col("name_key").cast("binary")), 1, 12))))
    rows = rows.join(live.select("document_id").withColumn("live", F.lit(True)), "document_id", "left")
    rows = rows.join(members.select("collection_id", "document_id").distinct().withColumn("held", F.lit(True)), ["collection_id", "document_id"], "left")
    return rows.select("name_key", "collection_id", "document_id", F.when(F.col("live").isNull(), "skipped_retired").when(F.col("held"), "held").otherwise("added").alias("outcome"))


def proposals_naming(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, candidate_id) of the group proposals that each document is a member of."""
    rows = candidates.filter("level = 'group'").select("candidate_id", F.explode("members").alias("document_id")).distinct()
    return rows.join(documents.select("document_id"), "document_id", "left_semi").select("document_id", "candidate_id")


# --------------------------------------------------------------------- scopes


def parse_scope(text: str) -> tuple[str, str | None]:
    """``all``, ``view:x``, ``collection:x`` or ``tag:x``."""
    kind, colon, name = (text or "all").partition(":")
    if (kind, colon) == ("all", ""):
        return kind, None
    if kind not in SCOPES or not name:
        raise QueryError(f"not a scope: {text!r}")
    return kind, name


def in_scope(c, text: str) -> DataFrame:
    """(document_id) of a scope."""
    kind, name = parse_scope(text)
    live = c.live.select("document_id")
    if kind == "all":
        return live
    if kind == "view":
        if name not in views.VIEWS:
            raise QueryError(f"no view is called {name!r}")
        return views.VIEWS[name](c).select("document_id").distinct()
    if kind == "tag":
        found = c.document_tag.filter(F.col("tag_key") == name_key(F.lit(name)))
    else:
        wanted = c.collection.filter(~F.col("retired") & (name_key(F.col("name")) == name_key(F.lit(name))))
        found = c.collection_member.join(wanted.select("collection_id"), "collection_id", "left_semi")
    return live.join(found.select("document_id"), "document_id", "left_semi")


# -------------------------------------------------------------- saved searches


def saved(query: Query) -> str:
    return json.dumps({"language": LANGUAGE, "query": asdict(query)}, sort_keys=True)


def restored(text: str) -> Query:
    """The query that was saved; one of a newer language is refused."""
    held = json.loads(text)
    if held["language"] > LANGUAGE:
        raise QueryError(f"a query of language {held['language']}; this is {LANGUAGE}")
    q = held["query"]
    lists = {k: tuple(q[k]) for k in ("alternatives", "near", "also")}
    return Query(**lists, within=q["within"], path=q["path"], filters=tuple(map(tuple, q["filters"])))
