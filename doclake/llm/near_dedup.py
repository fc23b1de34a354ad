"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles. Its sketch has
``BANDS * ROWS`` registers; register i is the truncated, exponentially spaced
level ``floor(1 - log_b(min h_i))`` of the least of independent exponential
draws over the set's members, so sketches merge by the maximum and two
registers agree with a probability close to the Jaccard similarity.

1. One pass over the texts: exact set, its digest, registers. Documents with
   equal sets form a class and only its first row goes on. Band hashes (a band is
   ROWS register values) follow from its registers and are dealt by band once.
2. Classes that share a band are candidates; of bands with the same members one
   is kept, as they would be compared alike. What a candidate's set shares with
   any other candidate, counted exactly, bounds what it shares with one of
   them; a candidate that cannot reach the threshold so goes. Each bucket's star
   is the member that shares most of its set, and every member is paired with
   its buckets' stars: a number of pairs linear in the rows.
3. A pair's similarity is estimated jointly from the registers that are above,
   below and equal, by maximum likelihood given the known set sizes; pairs far
   below the threshold go. The rest are verified on the full sets, recomputed
   from the whole texts. This goes in rounds: one pair for each class, then
   of the pairs whose ends are still in different components again one for each
   class, until no more are left than there are classes; those go in one round.
4. A bucket whose members are by now in one component is settled. In the
   others, members of different components are compared exactly with one another
   inside a join that only links leave, so no link within a bucket is lost.

A pair at similarity 0.8 shares a band with probability
``1 - (1 - 0.8**8)**64 = 1 - 8e-6``; more similar pairs are surer.

Shapes at scale: sketches and candidates move as ids, 1 KB of registers and
band hashes; texts are fetched for candidates only, by a broadcast of ids where
these are few (``BROADCAST_IDS``, checked) and by a shuffle join otherwise.
Copies and hot buckets meet in joins of narrow rows that AQE may split. Tables
written on the way are dropped once the groups are written, and each query's
shuffle files when it ends. Of ``doc``, only the columns asked for are shuffled.

Edge cases: a null text, or one without words, has an empty set: it is linked
with nothing and its component is its own id; fewer words than a shingle make
one shingle of all words; rows that repeat are members of one class, and of
rows with the same smallest id one stays; null ids are never chosen where a
group has another; an empty table gives no rows; other columns are kept,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import worker
from doclake.llm.components import components_at
from doclake.session import SPARING, cut, cut_at, drop_path, held, small_batches

WIDTH = 5
BANDS, ROWS = 64, 8
BASE, RATE, TOP = 1.001, 20.0, 65_534
THRESHOLD = 80  # percent
MARGIN = 0.15  # over 8 standard deviations of the estimate at the threshold
BROADCAST_IDS = 2_000_000
BATCH_ROWS = 1_000
GROUP_BYTES = 1 << 19

_rng = np.random.default_rng(20_240_607)
_SEEDS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
for _upper in range(65, 91):  # A-Z count as a-z
    _BYTES[_upper] = _BYTES[_upper + 32]
_BAND_SEEDS = _rng.integers(0, 1 << 64, BANDS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# ---------------------------------------------------------------- full sets


def each_set(texts: Iterable[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each whole text, in order.

    Texts are hashed in groups of about ``GROUP_BYTES``: the arrays behind a group
    take some fifty times its bytes, whatever the batch holds.
    """
    group, size = [], 0
    for text in texts:
        raw = (text or "").encode()
        if group and size + len(raw) > GROUP_BYTES:
            yield from _group_sets(group, width)
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    if group:
        yield from _group_sets(group, width)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    return list(each_set(texts, width))


def _group_sets(raw: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    of_doc = np.searchsorted(starts, offsets)
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in raw]
    lengths = ends - starts
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _STEP, dtype=np.uint64))
        inside = np.flatnonzero(word)
        place = inside - np.repeat(starts, lengths)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        words = _mix(np.add.reduceat(_BYTES[data[inside]] * powers[place], first) + lengths.astype(np.uint64))
        joined = words.copy()
        for j in range(1, width):
            joined[: len(words) - j] = _mix(joined[: len(words) - j] * _STEP + words[j:])
        sets = []
        for a, b in zip(of_doc, of_doc[1:], strict=False):
            if b - a >= width:
                sets.append(np.unique(joined[a : b - width + 1]))
            elif b > a:
                one = words[a : a + 1]
                for j in range(a + 1, b):
                    one = _mix(one * _STEP + words[j : j + 1])
                sets.append(_mix(one + np.uint64(b - a)))
            else:
                sets.append(np.empty(0, np.uint64))
    return sets


# ----------------------------------------------------------------- sketches


def registers(members: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    short = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(short), 1024):
        np.minimum(least, ((short[i : i + 1024, None] ^ _SEEDS) * _ODD).min(axis=0), out=least)
    draw = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(draw) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_hashes(sketches: np.ndarray) -> np.ndarray:
    """(documents, registers) -> (documents, bands) as signed 64-bit."""
    halves = np.ascontiguousarray(sketches).view("<u8").reshape(len(sketches), BANDS, ROWS // 4)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(_BAND_SEEDS, halves.shape[:2]).copy()
        for i in range(halves.shape[2]):
            out = _mix((out ^ halves[:, :, i]) * _STEP + np.uint64(i))
    return out.view(np.int64)


def estimate(above: np.ndarray, below: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        same = np.clip(1 - up - down, 1e-12, 1)
        return above * np.log(np.clip(up, 1e-12, 1)) + below * np.log(np.clip(down, 1e-12, 1)) + equal * np.log(same)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(40):  # the likelihood is concave
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = fit(a) > fit(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def sketched(df: DataFrame, text_col: str, width: int) -> DataFrame:
    """row_id, doc (all columns), n, set_key, registers; written once."""
    small_batches(df.sparkSession, BATCH_ROWS)

    @F.pandas_udf("struct<n:long,set_key:binary,registers:binary>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker.claim("near_dedup")
        for texts in batches:
            sizes, keys, regs = [], [], np.empty((len(texts), BANDS * ROWS), "<u2")
            for i, s in enumerate(each_set(texts, width)):  # no set outlives its turn
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs[i] = registers(s)
            some = [size > 0 for size in sizes]
            yield pd.DataFrame(
                {
                    "n": sizes,
                    "set_key": keys,
                    "registers": [r.tobytes() if ok else None for r, ok in zip(regs, some, strict=True)],
                }
            )

    rows = df.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"),
        sketch(F.col(f"`{text_col}`")).alias("s"),
    )
    return cut(rows.select("row_id", "doc", "s.*"), "sketches")


def dealt_bands(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, band) of each class's first row, dealt by band.

    Band hashes follow from the registers, so they are not stored. Their rows are most of what the
    search for candidates moves: whoever groups or joins them by band reads this one exchange.
    """

    @F.pandas_udf("array<long>")
    def hashes(kept: pd.Series) -> pd.Series:
        return pd.Series(list(band_hashes(np.frombuffer(b"".join(kept), "<u2").reshape(len(kept), -1))))

    # inner joins, as nodes and bands are unique on the right; a semi-join would sink below the hashes and the exchange.
    # The join asks for bands that are not null; said here, both readers ask for the same exchange.
    leaders = rows.filter("n > 0").select(F.col("row_id").alias("node"), hashes("registers").alias("bands")).join(classes.select("node"), "node")
    return leaders.select("node", F.explode("bands").alias("band")).filter("band IS NOT NULL").repartition("band")


# ------------------------------------------------------------------ linking


def _similar_sizes(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def _may_reach(a_n: Column, a_shared: Column, b_n: Column, b_shared: Column) -> Column:
    """Whether two sets can reach the threshold: they share no more than what each shares with any candidate."""
    most = F.least(a_shared, b_shared)
    return _similar_sizes(a_n, b_n) & (most * 100 >= (a_n + b_n - most) * THRESHOLD)


def shared_sizes(nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, shared): how many of a candidate's shingles occur in another candidate as well.

    Two aggregations by shingle and by node; shingles are exact 64-bit members of
    the full sets. A candidate of which too few are shared can have no link.
    """

    @F.pandas_udf("array<long>")
    def members(texts: pd.Series) -> pd.Series:
        return pd.Series([s.view(np.int64) for s in shingle_sets(texts.tolist(), width)])

    single = nodes.select("node", F.explode(members("text")).alias("shingle")).groupBy("shingle")
    single = single.agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")).filter("df = 1")
    own = single.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    rows = nodes.select("node", "n").join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))
    return rows.filter(F.col("shared") * 100 >= F.col("n") * THRESHOLD)


def _ends(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Pairs with the named columns of both ends, as a_x and b_x."""
    for end in ("a", "b"):
        side = nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        pairs = pairs.join(side, end)
    return pairs


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose estimate comes near it."""

    @F.pandas_udf("double")
    def likely(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), "<u2").reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), "<u2").reshape(len(b), -1)
        counts = [(x > y).sum(axis=1), (x < y).sum(axis=1), (x == y).sum(axis=1)]
        return pd.Series(estimate(*counts, n_a.to_numpy(float), n_b.to_numpy(float)))

    pairs = _ends(pairs, nodes, "n", "registers").filter(_similar_sizes(F.col("a_n"), F.col("b_n")))
    guess = likely("a_registers", "b_registers", "a_n", "b_n")
    return pairs.withColumn("guess", guess).filter(F.col("guess") >= THRESHOLD / 100 - MARGIN).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        texts = list(dict.fromkeys([*a, *b]))
        sets = dict(zip(texts, shingle_sets(texts, width), strict=True))
        out = []
        for x, y in zip(a, b, strict=True):
            s, t = sets[x], sets[y]
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * both >= THRESHOLD * (len(s) + len(t) - both))
        return pd.Series(out, dtype=bool)

    return _ends(pairs, nodes, "text").withColumn("linked", linked("a_text", "b_text")).filter("linked").select("a", "b")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
        pairs = pairs.withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return pairs.filter("a_root <> b_root").drop("a_root", "b_root")


def common_bands(bands: DataFrame) -> DataFrame:
    """(band): the bands that several nodes share, one for each set of members.

    A set is told by its size and two sums without carry of 64-bit hashes.
    """
    marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit("again"))).alias("y")]
    sets = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), *marks).filter("low <> high")
    return sets.groupBy("low", "high", "n", "x", "y").agg(F.min("band").alias("band")).select("band")


def across(members: DataFrame, labels: DataFrame, nodes: DataFrame, width: int, keep: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """Links (a, b) between members of one bucket that are still in different components.

    Each such member is written as its bucket's star with some shingles taken
    away and some added, so two members' exact intersection is
    ``|star| - |gone_a| - |gone_b| + |gone_a & gone_b| + |new_a & new_b|``. The
    join evaluates that and only links leave it: pairs are compared but never
    materialised, and buckets within one component are not compared at all.
    """

    @F.pandas_udf("struct<gone:array<long>,new:array<long>>")
    def edits(star: pd.Series, text: pd.Series) -> pd.DataFrame:
        texts = list(dict.fromkeys([*star, *text]))
        sets = {t: s.view(np.int64) for t, s in zip(texts, shingle_sets(texts, width), strict=True)}
        both = [(sets[a], sets[b]) for a, b in zip(star, text, strict=True)]
        return pd.DataFrame({"gone": [np.setdiff1d(a, b) for a, b in both], "new": [np.setdiff1d(b, a) for a, b in both]})

    rows = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    rows = keep(rows.join(mixed, "band", "left_semi"), "open")
    ends = _ends(rows.select(F.col("star").alias("a"), F.col("node").alias("b")).distinct(), nodes, "text")
    ends = ends.select(F.col("a").alias("star"), F.col("b").alias("node"), edits("a_text", "b_text").alias("e")).select("star", "node", "e.*")
    rows = keep(rows.join(ends, ["star", "node"]), "edited")
    left, right = (rows.select("band", *[F.col(c).alias(f"{e}_{c}") for c in ("node", "n", "shared", "root", "star_n", "gone", "new")]) for e in ("a", "b"))
    both = F.col("a_star_n") - F.size("a_gone") - F.size("b_gone") + F.size(F.array_intersect("a_gone", "b_gone")) + F.size(F.array_intersect("a_new", "b_new"))
    linked = both * 100 >= (F.col("a_n") + F.col("b_n") - both) * THRESHOLD
    reach = _may_reach(F.col("a_n"), F.col("a_shared"), F.col("b_n"), F.col("b_shared"))
    apart = (F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root"))
    found = left.join(right, (left["band"] == right["band"]) & apart & reach & linked)
    return found.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def grouped(df: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and for each set_key (set_key, best): the keeper of its component."""
    made: list[str] = []

    def keep(frame: DataFrame, name: str) -> DataFrame:
        table, path = cut_at(frame, name)
        made.append(path)
        return table

    def rooted(links: DataFrame) -> DataFrame:
        table, path = components_at(links)
        made.append(path)
        return table

    rows = sketched(df, text_col, width)
    ident = F.col("doc")[id_col].cast("long")
    keeper = F.struct(ident.isNull().alias("no_id"), ident.alias("id"), F.col("row_id"))
    classes = rows.filter("n > 0").groupBy("set_key").agg(F.min("row_id").alias("node"), F.min(keeper).alias("keeper"))
    classes = keep(classes, "classes")

    bands = dealt_bands(rows, classes)
    members = keep(bands.join(common_bands(bands), "band"), "members")

    ids = keep(members.select(F.col("node").alias("row_id")).distinct(), "ids")
    most = ids.count()
    nodes = rows.select("row_id", "n", "registers", F.col("doc")[text_col].alias("text"))
    nodes = nodes.join(F.broadcast(ids) if most <= BROADCAST_IDS else ids, "row_id", "left_semi").withColumnRenamed("row_id", "node")
    nodes = keep(nodes, "nodes")
    sizes = keep(shared_sizes(nodes, width), "sizes")

    # a bucket's star is the member that shares most of its set: a base text rather than an edited copy
    members = members.join(sizes, "node")
    share = F.floor(F.col("shared") * 1_000_000 / F.col("n"))
    stars = members.groupBy("band").agg(F.max(F.struct(share.alias("share"), (-F.col("node")).alias("minus"), "n", "shared")).alias("star"))
    members = members.join(stars, "band").select(
        "band", "node", "n", "shared", (-F.col("star.minus")).alias("star"), F.col("star.n").alias("star_n"), F.col("star.shared").alias("star_shared"), "star.share"
    )
    members = keep(members, "members")
    reach = _may_reach(F.col("star_n"), F.col("star_shared"), F.col("n"), F.col("shared"))
    pairs = members.filter((F.col("node") != F.col("star")) & reach).select(F.col("star").alias("a"), F.col("node").alias("b"), "share").distinct()
    pairs = keep(pairs, "pairs")

    # each round: at most one pair a class, then only what is still in different components
    links, labels, rounds = pairs.select("a", "b").limit(0), rooted(pairs.select("a", "b").limit(0)), 0
    while not pairs.isEmpty():
        last = rounds > 0 and pairs.count() <= most
        best = F.max(F.struct("share", (-F.col("a")).alias("minus")))
        batch = pairs.select("a", "b") if last else pairs.groupBy("b").agg(best.alias("m")).select((-F.col("m.minus")).alias("a"), "b")
        batch = keep(batch, "batch")
        hopeful, spent = cut_at(plausible(batch, nodes), "hopeful")
        links = keep(links.unionByName(verified(hopeful, nodes, width)), "links")
        drop_path(df.sparkSession, spent)
        labels = rooted(links)
        if last:
            break
        pairs = keep(_apart(pairs.join(batch, ["a", "b"], "left_anti"), labels), "pairs")
        rounds += 1

    late = keep(across(members, labels, nodes, width, keep), "late")
    if not late.isEmpty():
        labels = rooted(links.unionByName(late))

    groups = classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = groups.groupBy("root").agg(F.min("keeper").alias("best"))
    groups = cut(groups.join(best, "root").select("set_key", "best"), "groups")
    for path in made:
        drop_path(df.sparkSession, path)
    return rows, groups


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, columns: list[str] | None = None) -> DataFrame:
    """row_id, doc, n_shingles, component_id, stays (one row of each component).

    ``doc`` has all columns, or those named: what it holds is shuffled once, so texts that nobody reads need not be named.
    """
    with held(df.sparkSession, SPARING):
        rows, groups = grouped(df, id_col, text_col, width)
    doc = F.col("doc") if columns is None else F.struct(*[F.col("doc")[c].alias(c) for c in columns])
    ident = F.col("doc")[id_col].cast("long")
    out = rows.select("row_id", doc.alias("doc"), ident.alias("ident"), "n", "set_key").join(groups, "set_key", "left")
    own = F.col("best").isNull()
    return out.select(
        "row_id",
        "doc",
        F.col("n").alias("n_shingles"),
        F.when(own, F.col("ident")).otherwise(F.col("best.id")).alias("component_id"),
        (own | (F.col("best.row_id") == F.col("row_id"))).alias("stays"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs, width=2, columns=["doc_id"])
    return out.select(
        "doc.doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc.doc_id") == F.col("component_id"), F.col("stays")).alias("kept")
    )


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                    WHEN len(w) = 1 THEN w ELSE [] END) AS x FROM d),
c AS (SELECT list_sort(x) AS k, len(x) AS n, min(doc_id) AS doc_id FROM s WHERE len(x) > 0 GROUP BY 1, 2),
e AS (SELECT doc_id, n, unnest(k) AS g FROM c),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
o AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS r FROM e JOIN f USING (g)),
p AS (SELECT doc_id, n, g FROM o WHERE r <= n - (80 * n + 99) // 100 + 1),
q AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b USING (g)
      WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i AS (SELECT x, y, nx, ny, count(*) AS c FROM q JOIN e a ON a.doc_id = x JOIN e b ON b.doc_id = y AND a.g = b.g GROUP BY 1, 2, 3, 4),
l AS (SELECT x, y FROM i WHERE 100 * c >= 80 * (nx + ny - c)),
m AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM c UNION SELECT m.y, root FROM r JOIN m ON m.x = node),
b AS (SELECT node, min(root) AS root FROM r GROUP BY node),
k AS (SELECT s.doc_id, len(x)::BIGINT AS n_shingles, coalesce(root, s.doc_id) AS component_id
      FROM s LEFT JOIN c ON c.k = list_sort(s.x) AND c.n = len(s.x) LEFT JOIN b ON b.node = c.doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM k
"""

QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES = {"op2_near_dedup": SQL}
