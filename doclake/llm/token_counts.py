"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer digest, content digest, n_tokens) that
only grows. Contents are joined to it by digest; distinct contents that it
lacks, and only those, are encoded by the tokenizer's own library and appended;
then every row takes its count from the cache. The tokenizer's digest is the
SHA-256 of its file, so a changed file never meets old counts.

Normalised content: null is empty; where the tokenizer drops white space
(declared by its own file), space, tab, newline and carriage return at both
ends are trimmed, which cannot change the count. Nothing else is touched, as
special strings are matched before the tokenizer's own normaliser runs.

In a worker, texts of a tokenizer that drops white space are cut at spaces and
line ends, where no token and no special string can cross, and a piece that
recurs is counted once (a bounded table, ``MEMO`` entries).

Shapes at scale: which digests the cache lacks is settled on digests alone.
Where that list is short (``BROADCAST_DIGESTS``, checked) it goes to the texts
and only missing texts move; otherwise texts are shuffled by digest once,
combined per map task, and meet the list where they lie. Thousands of copies
cost one row a task either way; counts come back by a narrow equi-join that AQE
may split where one content is hot. An append that is run again after a lost
executor writes the same rows (the reader takes one per digest).

The query takes the documents in as two deliveries, the lower half of the ids
first, so its second pass finds part of its contents stored.

Edge cases: null and empty texts have 0 bytes and their count is the
tokenizer's for the empty string; repeated rows are counted alike; null ids are
kept; an empty table gives no rows and appends nothing; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import worker
from doclake.session import cut_at, drop_path, scratch_path, small_batches

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
MEMO = 1_000_000
BATCH_ROWS = 2_000
SPACES = " \t\n\r"
BROADCAST_DIGESTS = 500_000
CACHE = "tokenizer string, digest binary, n_tokens long"


def version(path: str) -> str:
    with open(path, "rb") as data:
        return hashlib.sha256(data.read()).hexdigest()


def drops_spaces(path: str) -> bool:
    """True if the file's pre-tokenizer removes all white space before the merges."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as data:
        spec = json.load(data).get("pre_tokenizer") or {}
    steps = spec.get("pretokenizers", [spec])
    return any(
        s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and r"[^\s" in s["pattern"].get("Regex", "") for s in steps
    )


class Counter:
    """Counts tokens as the tokenizer's own library does."""

    def __init__(self, path: str):
        self.memo: dict[str, int] = {}
        self.pieces = drops_spaces(path)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._lengths = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._lengths = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.pieces:
            return self._lengths(texts)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        fresh = list({p for t in texts for p in self._cut(t) if p not in memo})
        memo.update(zip(fresh, self._lengths(fresh), strict=True))
        return [sum(map(memo.__getitem__, self._cut(t))) for t in texts]

    @staticmethod
    def _cut(text: str) -> list[str]:
        for space in SPACES[1:]:
            text = text.replace(space, " ")
        return text.split(" ")


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    worker.claim("token_counts")
    if path not in _counters:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _counters[path] = Counter(path)
        worker.keep("token_counts", _counters.clear)
    return _counters[path]


def content(text: Column, path: str) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return F.btrim(plain, F.lit(SPACES)) if drops_spaces(path) else plain


def digest_of(plain: Column) -> Column:
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """The stored counts of one tokenizer, one row a digest; None before the first append."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def remember(contents: DataFrame, cache: str, path: str) -> None:
    """Encode the distinct contents (digest, text) that the cache lacks and append their counts."""
    spark, tokenizer = contents.sparkSession, version(path)
    small_batches(spark, BATCH_ROWS)
    stored, spent = read_cache(spark, cache, tokenizer), None
    if stored is None:
        misses = contents.dropDuplicates(["digest"])
    else:
        missing, spent = cut_at(contents.select("digest").distinct().join(stored, "digest", "left_anti"), "missing")
        if missing.count() <= BROADCAST_DIGESTS:
            misses = contents.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            misses = contents.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = counter(path)
        for batch in batches:
            yield pd.DataFrame({"tokenizer": tokenizer, "digest": batch["digest"], "n_tokens": library.count(batch["text"].tolist())})

    misses.select("digest", "text").mapInPandas(encode, CACHE).write.mode("append").parquet(cache)
    if spent:
        drop_path(spark, spent)


def token_counts(df: DataFrame, cache: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit; ``cache`` grows by the misses."""
    spark, where = df.sparkSession, path or public_tokenizers.path(TOKENIZER)
    tokenizer = version(where)
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"),
        content(F.col(f"`{text_col}`"), where).alias("text"),
    ).withColumn("digest", digest_of(F.col("text")))
    remember(rows.select("digest", "text"), cache, where)
    return (
        rows.select("id", "n_bytes", "digest")
        .join(read_cache(spark, cache, tokenizer), "digest")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cache = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), scratch_path(spark, "token_cache")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    path = public_tokenizers.path(TOKENIZER)
    if low is not None:
        text = content(F.col("text"), path)
        first = docs.filter(F.col("doc_id") <= (low + high) // 2).select(digest_of(text).alias("digest"), text.alias("text"))
        remember(first, cache, path)
    return token_counts(docs, cache, path)


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
