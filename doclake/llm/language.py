"""Language identification by compression.

For each language a bounded sample of labelled text is a zstandard raw-content
dictionary. A text is cut into blocks, every block is encoded with every
dictionary, and the language whose dictionary gives the fewest bytes over the
whole text wins. The margin to the runner-up, relative to the runner-up's size,
is the score; a text whose margin is below ``margin`` is rejected.

Texts are lower-cased and runs of anything but letters become one space, in the
sample and in what is predicted, so that capitals, marks and digits do not pass
for a language. Blocks keep the dictionary in reach: in one long frame a text would soon be its
own dictionary and the languages would draw level. All blocks of a text count,
so whole texts are compared.

The sample (documented bound): every labelled text, whole, is cut into pieces
of ``PIECE_BYTES``, and per language the ``SAMPLE_PIECES`` pieces with the
smallest hash draws make the dictionary, so any part of any text is as likely
as any other. Counts of pieces give a threshold that all but about
``SPARE * SAMPLE_PIECES`` draws a language fail before a piece is cut out; only
what passes is sorted, in ``SAMPLE_SALTS`` parts. Only the sample reaches the
driver, and only the dictionaries, at most ``SAMPLE_PIECES * PIECE_BYTES`` a
language, are sent to the executors.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text when nothing could be learned; with one learned language the score
is 1; a tie has score 0, is rejected and goes to the language with the most
learned rows, then to the one that sorts first; rows that repeat are predicted
alike; null ids count as the empty string in the fold; other columns are kept
(``identified``) or ignored (the query), whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.llm import worker
from doclake.session import small_batches

SAMPLE_PIECES, SAMPLE_SALTS, PIECE_BYTES, SPARE = 128, 16, 2048, 16
BLOCK, LEVEL = 4096, 3
MARGIN = 0.0005
BATCH_ROWS = 2_000
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}]+")


def fold(id_col: Column) -> Column:
    """crc32(id as text) mod 3; 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def letters(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a bounded, deterministic sample; most rows first."""
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = df.filter((fold(doc_id) != 1) & F.col(f"`{lang_col}`").isNotNull() & (F.length(text) > 0))
    pieces = F.ceil(F.octet_length(text) / PIECE_BYTES).cast("int")
    counts = rows.groupBy(F.col(f"`{lang_col}`").alias("counted")).agg(F.count(F.lit(1)).alias("n"), F.sum(pieces).alias("pieces"))
    rows = rows.select(F.col(f"`{lang_col}`").alias("lang"), doc_id.alias("doc_id"), text.cast("binary").alias("text"), pieces.alias("k"))
    rows = rows.join(F.broadcast(counts), F.col("lang") == F.col("counted"))  # one short row a language
    share = F.lit(SPARE * SAMPLE_PIECES) / F.col("pieces")

    def draw(i: Column) -> Column:
        return F.struct(F.xxhash64("doc_id", F.lit("sample"), i).alias("draw"), i.alias("i"))

    def passes(d: Column) -> Column:
        return (d["draw"] / F.lit(float(1 << 63)) + 1) / 2 < share

    def piece(d: Column) -> Column:
        return F.struct(d["draw"].alias("draw"), F.substr(F.col("text"), d["i"] * PIECE_BYTES + 1, F.lit(PIECE_BYTES)).alias("piece"))

    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.col("k") - 1), draw), passes)
    rows = rows.select("lang", "n", F.explode(F.transform(drawn, piece)).alias("p")).select("lang", "n", "p.*")
    part = Window.partitionBy("lang", F.pmod("draw", F.lit(SAMPLE_SALTS))).orderBy("draw", "piece")
    rows = rows.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= SAMPLE_PIECES // SAMPLE_SALTS)
    found: dict[str, list] = {}
    for row in rows.select("lang", "draw", "piece", "n").collect():
        found.setdefault(row["lang"], []).append((row["draw"], bytes(row["piece"]).decode(errors="ignore"), row["n"]))
    order = sorted(found, key=lambda lang: (-max(n for _, _, n in found[lang]), lang))
    return {lang: "\n".join(letters(piece) for _, piece, _ in sorted(found[lang])).encode() for lang in order}


class Classifier:
    """One compressor per language; digested dictionaries are shared by all calls."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = list(samples)
        self.coders = []
        for sample in samples.values():
            content = zstandard.ZstdCompressionDict(sample.ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.coders.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)
            )

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        plain = letters(text or "")
        if not plain or not self.langs:
            return UNKNOWN, 0.0
        sizes = self.sizes(plain.encode())
        if len(sizes) == 1:
            return self.langs[0], 1.0
        best = int(np.argmin(sizes))
        rest = min(s for i, s in enumerate(sizes) if i != best)
        return self.langs[best], min(1.0, max(0.0, (rest - sizes[best]) / rest))


def identified(df: DataFrame, samples: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """All columns in struct ``doc``, with lang_pred, score, rejected."""
    spark = df.sparkSession
    small_batches(spark, BATCH_ROWS)
    shared = spark.sparkContext.broadcast(samples)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker.claim("language")
        classifier = Classifier(shared.value)
        for batch in texts:
            yield pd.DataFrame([classifier.predict(t) for t in batch], columns=["lang_pred", "score"])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), predict(F.col(f"`{text_col}`")).alias("p"))
    return rows.select("doc", "p.lang_pred", "p.score", rejected(F.col("p.lang_pred"), F.col("p.score")).alias("rejected"))


def rejected(lang: Column, score: Column) -> Column:
    return (lang == UNKNOWN) | (score < MARGIN)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identified(docs.select("doc_id", "text"), learn(docs))
    return out.select(F.col("doc.doc_id").alias("doc_id"), (fold(F.col("doc.doc_id")) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def held_out_fold(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
