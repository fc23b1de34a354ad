r"""Chat formatting in budgeted, turn-aligned windows.

Every turn becomes ``<s>[INST] role [/INST]text</s>``. Inside roles and texts
the four control strings and the escape character are written as two-character
escapes (``\o \c \i \j \b``), so a formatted string parses back to the turns
that went in.

A turn costs the tokens of its formatted piece, marks and role included. Where
the caller has stored counts of a model's tokenizer (``token_counts``' cache, by
content digest) a text's own tokens are taken from there; all else is counted by
a native tokenizer, the matches of ``TOKEN``: two letters, three digits or one
other sign. On the shipped tables the 50k byte-BPE gives 0.87 of that count, at
the 99th percentile of turns 1.10 of it.

Windows: prefix sums of these costs lay the turns on a line that is cut into cells of ``budget - system -
history`` tokens. Turns inside a cell form a window; a turn that crosses a cell
border goes with the cell it ends in if that fits, else it is a window by
itself. No turn is ever cut: one that is larger than the room gets a window of
its own, marked ``over_budget``. Each window after the first repeats the system
turn (a conversation's first turn, if its role is ``system``) and the latest
turns before it that fit into ``history`` tokens. Repeats are masked: the loss
spans cover the text of each assistant turn in the one window where it is new.

Shapes at scale: one shuffle by conversation, running sums, and a range frame
that holds no more than ``history`` tokens; a window is the largest unit that
is ever put together. Only the digest query joins a conversation's windows.

Edge cases: null text or role counts as empty; turns that tie on their number
are ordered by role and text, null numbers first; repeated rows are turns of
their own; null conversation ids are one conversation; an empty table gives no
windows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET, HISTORY = 1024, 256
OPEN, MID, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: control string -> escape; the escape character itself comes first
ESCAPES = (("\\", "\\b"), ("</s>", "\\c"), ("<s>", "\\o"), ("[/INST]", "\\j"), ("[INST]", "\\i"))
TOKEN = r"\p{L}{1,2}|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{N}]"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    """How many tokens the native tokenizer makes of a text."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, counts: DataFrame | None = None) -> DataFrame:
    """conv_id, window, formatted, loss (array of start and length in code points), n_context, n_turns, tokens, over_budget.

    ``counts``: (digest, n_tokens), stored counts by SHA-256 of a text.
    """
    conv = Window.partitionBy("conv_id")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("stored", F.lit(None).cast("long"))
    if counts is not None:
        known = counts.select(F.col("digest").alias("__digest"), F.col("n_tokens").cast("long").alias("stored"))
        rows = rows.drop("stored").join(known, F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("__digest"), "left").drop("__digest")
    rows = rows.withColumn("ord", F.row_number().over(conv.orderBy(F.asc_nulls_first("turn"), "role", "text")))
    rows = rows.select(
        "conv_id",
        "ord",
        "role",
        ((F.col("ord") == 1) & (F.col("role") == "system")).alias("is_system"),
        "stored",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID)).alias("head"),
        escape(F.col("text")).alias("body"),
    ).withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    counted = F.when(F.col("stored").isNull(), tokens(F.col("piece"))).otherwise(F.col("stored") + tokens(F.concat("head", F.lit(CLOSE))))
    rows = rows.withColumn("cost", counted).drop("stored")
    upto = conv.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "*",
        F.max(F.when(F.col("is_system"), F.col("piece"))).over(conv).alias("system"),
        F.coalesce(F.max(F.when(F.col("is_system"), F.col("cost"))).over(conv), F.lit(0)).alias("system_cost"),
        F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("cost"))).over(upto).alias("end"),
    )
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.col("system_cost"))
    start = F.when(F.col("is_system"), F.lit(-history - 1)).otherwise(F.col("end") - F.col("cost"))
    rows = rows.withColumn("room", room).withColumn("start", start.cast("long"))
    rows = rows.withColumn("cell", F.when(F.col("is_system"), 0).otherwise(F.floor((F.col("end") - 1) / F.col("room"))).cast("long"))
    inside = F.col("is_system") | (F.floor(F.col("start") / F.col("room")) == F.col("cell"))
    rows = rows.withColumn("inside", inside)
    cell = Window.partitionBy("conv_id", "cell")
    filled = F.coalesce(F.sum(F.when(F.col("inside") & ~F.col("is_system"), F.col("cost"))).over(cell), F.lit(0))
    rows = rows.withColumn("joins", F.col("inside") | ((filled > 0) & (F.col("cost") + filled <= F.col("room"))))
    before = Window.partitionBy("conv_id").orderBy("start").rangeBetween(-history, -1)
    rows = rows.select(
        "*",
        F.dense_rank().over(conv.orderBy("cell", "joins")).alias("rank"),
        F.collect_list(F.struct("ord", "piece", "cost")).over(before).alias("past"),
    )
    # the system turn alone in cell 0 belongs with the first turns
    rows = rows.withColumn("rank", F.when(F.col("is_system"), F.min(F.when(~F.col("is_system"), F.col("rank"))).over(conv)).otherwise(F.col("rank")))
    rows = rows.withColumn("rank", F.coalesce("rank", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("conv_id", "rank").orderBy("ord")) == 1
    own = F.struct("ord", "role", "head", "body", "piece", "cost", F.when(first, F.col("past")).alias("past"), "system", "system_cost", "is_system")
    packed = rows.select("conv_id", "rank", own.alias("own")).groupBy("conv_id", "rank").agg(F.sort_array(F.collect_list("own")).alias("turns"))
    least = Window.partitionBy("conv_id")
    packed = packed.withColumn("window", (F.col("rank") - F.min("rank").over(least)).cast("long"))
    repeats = (F.col("window") > 0) & F.col("turns")[0]["system"].isNotNull()
    past = F.when(F.col("window") > 0, F.sort_array(F.col("turns")[0]["past"]))
    packed = packed.select(
        "conv_id",
        "window",
        "turns",
        F.coalesce(past, F.array()).alias("past"),
        F.when(repeats, F.col("turns")[0]["system"]).otherwise(F.lit("")).alias("system"),
        F.when(repeats, F.col("turns")[0]["system_cost"]).otherwise(F.lit(0)).alias("system_cost"),
        repeats.cast("int").alias("n_system"),
    )
    packed = packed.withColumn("context", F.concat("system", F.array_join(F.transform("past", lambda t: t["piece"]), "")))
    span = "struct<start:int,length:int>"
    loss = F.aggregate(
        "turns",
        F.struct(F.length("context").alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["piece"])).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )

    def total(column: str) -> Column:
        return F.aggregate(column, F.lit(0).cast("long"), lambda acc, t: acc + t["cost"])

    spent = F.col("system_cost") + total("past") + total("turns")
    return packed.select(
        "conv_id",
        "window",
        F.concat("context", F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
        loss.alias("loss"),
        (F.col("n_system") + F.size("past")).alias("n_context"),
        F.size("turns").alias("n_turns"),
        spent.alias("tokens"),
        (spent > budget).alias("over_budget"),
    )


def parse(formatted: Column, n_context: Column, n_turns: Column) -> Column:
    """The new turns of a window, read from its string: array of (role, text)."""
    marked = F.slice(F.split(formatted, r"\Q</s>\E", -1), n_context + 1, n_turns)

    def turn(x: Column) -> Column:
        halves = F.split(F.substring(x, len(OPEN) + 1, 1 << 30), r"\Q [/INST]\E", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(marked, turn)


def read_back(out: DataFrame) -> DataFrame:
    """Per conversation, from the formatted strings and the mask alone."""
    turns = F.transform(parse(F.col("formatted"), F.col("n_context"), F.col("n_turns")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    rows = out.select(
        "conv_id",
        F.struct(
            "window",
            F.size(turns).alias("n"),
            F.array_join(turns, "").alias("turns"),
            F.array_join(loss, "").alias("loss"),
            F.length("formatted").alias("chars"),
        ).alias("w"),
    )
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    rows = rows.withColumn("loss", F.array_join(F.transform("ws", lambda w: w["loss"]), ""))

    def total(field: str) -> Column:
        return F.aggregate("ws", F.lit(0).cast("long"), lambda acc, w: acc + w[field])

    return rows.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(F.array_join(F.transform("ws", lambda w: w["turns"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
        F.size("ws").cast("long").alias("n_windows"),
    )


PLANTED = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return read_back(windows(df.unionByName(planted)))


def _escape_sql(text: str) -> str:
    for plain, code in ESCAPES:
        text = f"replace({text}, '{plain}', '{code}')"
    return text


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ord FROM c),
s AS (
  SELECT *, ord = 1 AND role = 'system' AS sys, len(regexp_extract_all(piece, '{TOKEN}')) AS cost, length(piece) AS chars
  FROM (SELECT *, '{OPEN}' || {_escape_sql("role")} || '{MID}' || {_escape_sql("text")} || '{CLOSE}' AS piece FROM o)),
e AS (
  SELECT *, coalesce(max(chars) FILTER (WHERE sys) OVER (PARTITION BY conv_id), 0) AS sys_chars,
         greatest(1, {BUDGET - HISTORY} - coalesce(max(cost) FILTER (WHERE sys) OVER (PARTITION BY conv_id), 0)) AS room,
         sum(CASE WHEN sys THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY ord) AS "end" FROM s),
p AS (
  SELECT *, ("end" - cost)::BIGINT AS start, floor(("end" - 1) / room) AS cell, floor(("end" - cost) / room) = floor(("end" - 1) / room) AS inside
  FROM e WHERE NOT sys),
j AS (
  SELECT *, inside OR (sum(CASE WHEN inside THEN cost ELSE 0 END) OVER g > 0 AND cost + sum(CASE WHEN inside THEN cost ELSE 0 END) OVER g <= room) AS joins,
         coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY start RANGE BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING), 0) AS past
  FROM p WINDOW g AS (PARTITION BY conv_id, cell)),
w AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY cell, joins) AS rank FROM j),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, rank ORDER BY ord) = 1 AND rank > 1 AS opens FROM w),
x AS (SELECT conv_id, sum(CASE WHEN opens THEN past + sys_chars ELSE 0 END) AS extra, max(rank) AS n_windows FROM f GROUP BY conv_id),
t AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY ord) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars FROM s GROUP BY conv_id)
SELECT t.conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       (chars + coalesce(extra, 0))::BIGINT AS formatted_chars, coalesce(n_windows, 1)::BIGINT AS n_windows
FROM t LEFT JOIN x ON t.conv_id IS NOT DISTINCT FROM x.conv_id
"""

QUERIES = {"op1_chat": op1_chat}
ORACLES = {"op1_chat": SQL}
