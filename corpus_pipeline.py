"""From raw documents to encoded training data, in five stages.

Language ID, line dedup, near-dedup, mixing sources, byte-level BPE. Each stage
works on all rows its predecessor kept and takes and returns the columns of
``documents``; the last returns token counts and digests per copy taken.

Edge cases follow the operators: null or letterless texts are rejected by the
first stage; a document of which every line is dropped stays with an empty
text; rows with a null source are a source of their own; an empty table runs
through; further columns travel along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import byte_bpe, language, lines, mixing, near_dedup
from doclake.session import cut


def _columns(holder: str, docs: DataFrame, text: str | None = None) -> list:
    """The columns of ``docs`` out of a struct; with a new text, n_chars follows."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")} if text else {}
    return [new.get(c, F.col(holder)[c]).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; the rejected go."""
    return language.identified(docs, language.learn(docs)).filter(~F.col("rejected")).select(*_columns("doc", docs))


#: A source holds many sites, so a line that one site repeats is on a far smaller part of it than of a host.
SOURCE_RATIO = 0.01


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat on more than ``SOURCE_RATIO`` of a source's documents go; every document stays."""
    return lines.drop_lines(docs, F.col("source"), "text", SOURCE_RATIO).select(*_columns("page", docs, "kept_text"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return near_dedup.near_duplicates(docs).filter("stays").select(*_columns("doc", docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it leaves out go."""
    copies = mixing.mixed(docs).filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copies.select(*_columns("doc", docs))


#: Words a worker keeps, characters and rows it takes at a time: the stages before leave an executor less memory than the
#: operator has alone. Results are the same.
SPARE = {"memo": 100_000, "slice_chars": 1 << 20, "batch_rows": 500}


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every copy."""
    return byte_bpe.digests(byte_bpe.round_trip(docs.select("doc_id", "text"), **SPARE))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: Compression sizes and merges have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
