r"""Byte-level BPE encoding and decoding by DuckDB recursive queries.

Every Python worker holds one in-process DuckDB with the merge table: for each
token of the rank file and each split of it into two tokens, (left, right,
token); the token's rank is its id. The words of a batch that the worker has
not met before become token-position rows, starting from single bytes. A
recursive query joins neighbouring rows with the merge table, contracts each
word's leftmost pair of minimum rank and repeats until no pair of any word is
in the table. A word that is itself a token is that token, as in the public
libraries. Decoding joins token positions with the vocabulary and aggregates
the bytes in order.

Words are the matches of ``pattern``; a text is cut into units only at single
spaces between two characters that are not white space, where every match of
the pattern must end, so a unit that recurs in a batch, or a word that recurs in
any, is looked up and not encoded again. The lookup tables are bounded (``MEMO``
entries, or as many as the caller gives; the ids are the same with any number)
and local to a worker: nothing is shuffled, and losing an executor loses only
what it had looked up.

One pass of the recursion contracts one pair a word. For words longer than
``LONG_WORD`` bytes a second form of the query contracts, in one pass, every
place of a word's minimum-rank pair, from the left and without overlaps. That is
the same fixpoint wherever each token of the file is what its own bytes encode
to, as in every file that training made (the tests check the shipped one): no
pair of lower rank can arise before the places are used up. A word of n bytes so
takes as many passes as it has different merges, not n.

Edge cases: a null text is encoded as empty (no ids, empty bytes); unknown ids
raise ``KeyError``; lone surrogates cannot occur in Spark strings; rows that
repeat give equal ids; an empty table gives no rows; other columns are kept
(``round_trip``) or ignored (the query), whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import worker
from doclake.session import small_batches

RANKS = "byte_bpe_50k.tiktoken"
MEMO = 400_000
LONG_WORD = 64
WORDS_PER_QUERY = 15_000
BATCH_ROWS = 2_000
#: Characters of text that are encoded and decoded at a time: about an Arrow batch. Smaller slices take less memory and some more time.
SLICE_CHARS = 8 << 20

ENCODE = """
WITH RECURSIVE state(k, tok, done) AS (
  SELECT k, tok, false FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT k, tok, lead(k) OVER o AS next_k, lead(tok) OVER o AS next_tok FROM state WHERE NOT done WINDOW o AS (ORDER BY k)),
   ranked AS (SELECT k, next_k, (id::BIGINT << 16) | (k & 65535) AS pick FROM pairs JOIN merges ON l = tok AND r = next_tok WHERE next_k >> 16 = k >> 16),
   best AS (SELECT k >> 16 AS word, min(pick) AS pick, arg_min(next_k, pick) AS gone FROM ranked GROUP BY 1)
   SELECT p.k, CASE WHEN (p.k & 65535) = (pick & 65535) THEN (pick >> 16)::INTEGER ELSE p.tok END, word IS NULL
   FROM pairs p LEFT JOIN best ON word = p.k >> 16 WHERE word IS NULL OR p.k <> gone)
)
SELECT (k >> 16)::INTEGER AS word, tok FROM state WHERE done ORDER BY k
"""

#: As ENCODE, every place of the pair in one pass; positions take 32 bits.
ENCODE_LONG = """
WITH RECURSIVE state(k, tok, done) AS (
  SELECT k, tok, false FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT k, tok, lead(k) OVER o AS next_k, lead(tok) OVER o AS next_tok FROM state WHERE NOT done WINDOW o AS (ORDER BY k)),
   ranked AS (SELECT k, next_k, id, min(id) OVER (PARTITION BY k >> 32) AS least FROM pairs JOIN merges ON l = tok AND r = next_tok WHERE next_k >> 32 = k >> 32),
   places AS (SELECT k, next_k, id, row_number() OVER (ORDER BY k) AS n, lag(next_k) OVER (ORDER BY k) IS NOT DISTINCT FROM k AS chained FROM ranked WHERE id = least),
   runs AS (SELECT *, n - max(CASE WHEN NOT chained THEN n END) OVER (ORDER BY k) AS step FROM places),
   best AS (SELECT k, next_k, id FROM runs WHERE step % 2 = 0),
   going AS (SELECT DISTINCT k >> 32 AS word FROM best)
   SELECT p.k, coalesce(b.id, p.tok), word IS NULL
   FROM pairs p LEFT JOIN best b ON b.k = p.k LEFT JOIN best g ON g.next_k = p.k LEFT JOIN going ON word = p.k >> 32 WHERE g.k IS NULL)
)
SELECT (k >> 32)::INTEGER AS word, tok FROM state WHERE done ORDER BY k
"""

DECODE = "SELECT s, string_agg(hex, '' ORDER BY pos) AS hex FROM segments JOIN vocabulary USING (tok) GROUP BY s ORDER BY s"


def spaced(pattern: str) -> str:
    """The pattern with white space as the Unicode property, whichever engine runs it."""
    return pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


#: A space beside white space: there a cut at the space would not be a cut of the pattern.
_PAIRS = ["  ", *(p for c in "\t\n\x0b\x0c\r" for p in (" " + c, c + " "))]


class Codec:
    """Encoder and decoder over one rank file; texts in, packed little-endian ids out, and back."""

    def __init__(self, path: str, pattern: str):
        self.most = MEMO
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = regex.compile(spaced(pattern))
        self.plain = pattern == public_tokenizers.PATTERN  # there a space and letters are one word
        self.uneven = regex.compile(r"\p{White_Space} | \p{White_Space}")
        self.cuts = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.memo: dict[str, bytes] = {}
        self.segments: dict[bytes, bytes] = {}
        size = max(self.ranks.values()) + 1
        self.leads = np.zeros(size, dtype=bool)
        self.known = np.zeros(size, dtype=bool)
        for token, rank in self.ranks.items():
            self.leads[rank], self.known[rank] = token[0] < 128 and not token[:1].isalnum(), True
        pairs = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None
        ]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = pa.table({n: pa.array(list(c), pa.int32()) for n, c in zip(("l", "r", "id"), zip(*pairs, strict=True), strict=True)})
        vocabulary = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("incoming", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
            self.db.unregister("incoming")

    # ------------------------------------------------------------- encoding

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; units are told apart and put together by Arrow, and looked up once a batch."""
        texts = [t or "" for t in texts]
        uneven = [any(pair in t for pair in _PAIRS) if t.isascii() else self.uneven.search(t) is not None for t in texts]
        plain = pc.split_pattern(pa.array([t for t, u in zip(texts, uneven, strict=True) if not u], pa.large_string()), " ")
        rough = pa.array([self.cuts.split(t) for t, u in zip(texts, uneven, strict=True) if u], pa.list_(pa.large_string()))
        done = [iter(self._encode_split(units)) for units in (plain, rough)]
        return [next(done[u]) for u in uneven]

    def _encode_split(self, split: pa.ListArray) -> list[bytes]:
        """As ``encode``, of texts cut into units; a space belongs to each unit but a text's first."""
        if not len(split):
            return []
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        codes, units = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        heads, head_codes = np.unique(codes[ends[:-1]], return_inverse=True)
        codes[ends[:-1]] = len(units) + head_codes
        met = np.flatnonzero(np.bincount(codes, minlength=len(units))[: len(units)]).tolist()
        ids = self._encode_units([" " + units[i] for i in met] + [units[h] for h in heads])
        place = np.zeros(len(units) + len(heads), dtype=np.int64)
        place[met] = np.arange(len(met))
        place[len(units) :] = len(met) + np.arange(len(heads))
        return _joined(ids, place[codes], ends)

    def _encode_units(self, units: list[str]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.memo.clear()
        memo, find = self.memo, self.words.findall
        split = [(u,) if self.plain and u[1:].isalpha() and u[0] == " " else find(u) for u in units]
        fresh = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in memo]
        for i in range(0, len(fresh), WORDS_PER_QUERY):
            part = fresh[i : i + WORDS_PER_QUERY]
            memo.update(zip(part, self._encode_words([w.encode() for w in part]), strict=True))
        return [memo[s[0]] if len(s) == 1 else b"".join(map(memo.__getitem__, s)) for s in split]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        short, long = [], []
        for i, word in enumerate(words):
            if (rank := self.ranks.get(word)) is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                (long if len(word) > LONG_WORD else short).append(i)
        for rest, query, bits in ((short, ENCODE, 16), (long, ENCODE_LONG, 32)):
            for i, ids in zip(rest, self._contract([words[i] for i in rest], query, bits), strict=True):
                out[i] = ids
        return out

    def _contract(self, words: list[bytes], query: str, bits: int) -> list[bytes]:
        """Token-position rows of the words, contracted by a recursive query; a position takes ``bits`` bits."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        k = np.repeat(np.arange(len(words), dtype=np.int64), lengths) << bits | np.arange(len(starts)) - starts
        tok = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        self.db.register("start", pa.table({"k": k, "tok": tok}))
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister("start")
        word, ids = found["word"].to_numpy(), found["tok"].to_numpy().astype("<u4").tobytes()
        ends = np.searchsorted(word, np.arange(len(words) + 1)) * 4
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    # ------------------------------------------------------------- decoding

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of each text's packed ids, by runs of ids that begin where a token begins with a space or a sign."""
        if len(self.segments) > self.most:
            self.segments.clear()
        memo, data = self.segments, b"".join(packed)
        ids = np.frombuffer(data, dtype="<u4")
        if not len(ids):
            return [b""] * len(packed)
        if ids.max() >= len(self.known) or not self.known[ids].all():
            raise KeyError("an id is not in the vocabulary")
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        cut = self.leads[ids]
        cut[ends[:-1][ends[:-1] < len(ids)]] = True
        starts = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.append(starts * 4, len(data)).astype(np.int64).tobytes())
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        keys = runs.dictionary.to_pylist()
        self._decode_runs([k for k in keys if k not in memo])
        return _joined([memo[k] for k in keys], runs.indices.to_numpy(), np.searchsorted(starts, ends))

    def _decode_runs(self, runs: list[bytes]) -> None:
        """Token positions joined with the vocabulary, bytes aggregated in order."""
        if not runs:
            return
        lengths = np.array([len(r) // 4 for r in runs])
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        table = {
            "s": np.repeat(np.arange(len(runs), dtype=np.int32), lengths),
            "pos": (np.arange(len(starts)) - starts).astype(np.int32),
            "tok": np.frombuffer(b"".join(runs), dtype="<u4").astype(np.int32),
        }
        self.db.register("segments", pa.table(table))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("segments")
        self.segments.update(zip(runs, map(bytes.fromhex, found["hex"].to_pylist()), strict=True))


def _joined(pieces: list[bytes], codes: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """For each stretch of ``codes`` between two ``ends`` its pieces, one after another."""
    taken = pa.array(pieces, pa.large_binary()).take(pa.array(codes))
    at = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1][ends].tolist()
    data = memoryview(taken.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per worker process: tasks that follow find its tables filled."""
    worker.claim("byte_bpe")
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
        worker.keep("byte_bpe", _codecs.clear)
    return _codecs[path, pattern]


def slices(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """Stretches of the texts of about ``most`` characters, one text at least."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text or "") > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def round_trip(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, memo: int = MEMO, slice_chars: int = SLICE_CHARS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """All columns in struct ``doc``, with ids (packed little-endian) and decoded bytes; a worker keeps about ``memo`` words and takes ``slice_chars`` characters at a time."""
    where = path or public_tokenizers.path(RANKS)
    small_batches(df.sparkSession, batch_rows)

    @F.pandas_udf("struct<ids:binary,decoded:binary>")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = codec(where, pattern)
        coder.most = memo
        for batch in texts:
            ids, decoded = [], []
            for part in slices(batch.tolist(), slice_chars):
                ids += coder.encode(part)
                decoded += coder.decode(ids[len(decoded) :])
            yield pd.DataFrame({"ids": ids, "decoded": decoded})

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), both(F.col(f"`{text_col}`")).alias("b"))
    return rows.select("doc", "b.ids", "b.decoded")


def digests(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return out.select(
        F.col("doc")[id_col].alias(id_col),
        F.expr("octet_length(ids) DIV 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
