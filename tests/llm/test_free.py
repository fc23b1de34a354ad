"""Language ID, byte BPE, token counts, near-dedup, top-k and the pipeline: brute force, round trips, held-out accuracy."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from doclake.llm import byte_bpe, components, language, near_dedup, token_counts, topk

TEXTS = st.text(alphabet=st.sampled_from(list(" \n\tab'sét1.\x1c\xa0日ß😀XY")), max_size=40)


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXTS, max_size=30))
def test_bpe_equals_the_library(codec, library, texts):
    ids = codec.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [library.encode_ordinary(t) for t in texts]
    assert [b.decode() for b in codec.decode(ids)] == texts


def test_bpe_long_words(codec, library):
    rng = random.Random(1)
    texts = ["x" * 70_000, "".join(rng.choice("abcdef") for _ in range(2000)), "ab" * 200 + " " + "é" * 400, "aaab" * 30 + "a" * 33, "x" * 64, "x" * 65]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(60, 400))) for letters in ("ab", "aet", "xyz", "\u65e5\u672c", "é😀") for _ in range(20)]
    assert [np.frombuffer(i, "<u4").tolist() for i in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    with pytest.raises(KeyError):
        codec.decode([(4_000_000).to_bytes(4, "little")])


def test_every_token_encodes_to_itself(codec):
    """What contracting all places of a pair at once rests on; both queries."""
    tokens = [t for t in codec.ranks if len(t) > 1]
    want = [codec.ranks[t].to_bytes(4, "little") for t in tokens]
    for query, bits in ((byte_bpe.ENCODE, 16), (byte_bpe.ENCODE_LONG, 32)):
        assert codec._contract(tokens, query, bits) == want


def test_bpe_table(odd, empty, library):
    for r in byte_bpe.round_trip(odd).collect():
        text = r["doc"]["text"] or ""
        assert bytes(r["decoded"]).decode() == text and np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(text)
    assert byte_bpe.digests(byte_bpe.round_trip(empty)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.sampled_from(["<|startoftext|> a", "x<|endoftext|>y", "ΣΑΣ ΑΣ", "I'LL DON'T"])), max_size=20))
def test_counts_equal_the_library(texts):
    path = public_tokenizers.path(token_counts.TOKENIZER)
    model = Tokenizer.from_file(path)
    assert token_counts.counter(path).count(texts) == [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def test_counts_cache_encodes_only_misses(spark, odd, empty, tmp_path):
    cache = f"file://{tmp_path}/cache"
    model = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    half = odd.filter("doc_id < 6")
    token_counts.token_counts(half, cache).collect()
    stored = spark.read.parquet(cache).count()
    out = token_counts.token_counts(odd, cache).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    want = sorted((len(t.encode()), len(model.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in out)
    rows = spark.read.parquet(cache)
    assert stored < rows.count() == rows.select("digest").distinct().count() == len({t.strip(" \t\n\r") for t in texts})
    token_counts.token_counts(odd, cache).collect()
    assert spark.read.parquet(cache).count() == rows.count()
    assert token_counts.token_counts(empty, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("bound", [0, 500_000])
def test_counts_of_the_query_meet_stored_and_missing_contents(spark, corpus_dir, monkeypatch, bound):
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", bound)
    model = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet").collect()
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs)
    got = token_counts.op6_token_counts(spark, corpus_dir).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_counts_with_sentencepiece(odd, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = token_counts.token_counts(odd.filter("length(text) < 1000 OR text IS NULL"), f"file://{tmp_path}/sp", path=path).collect()
    want = [len(model.encode(r["text"] or "")) for r in odd.collect() if r["text"] is None or len(r["text"]) < 1000]
    assert sorted(r["n_tokens"] for r in out) == sorted(want)


def test_language_held_out_accuracy(spark, corpus_dir):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    rows = language.op4_language(spark, corpus_dir).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["text"] and any(c.isalpha() for c in r["text"])]
    assert len(held) > 50 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == language.held_out_fold(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] >= 900} == {900: "und", 901: "und", 902: "und"}


def test_language_learns_from_text_and_label_alone(spark):
    rows = [(i, "the and of to" if i % 2 else "der die das und", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.learn(docs)
    wrong = docs.withColumn("lang", F.when(language.fold(F.col("doc_id")) == 1, "xx").otherwise(F.col("lang")))
    assert samples == language.learn(wrong) and set(samples) == {"en", "de"}


def test_language_edges(spark, odd, empty):
    assert language.learn(empty) == {} and language.identified(empty, {}).count() == 0
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in language.identified(odd, {}).collect())
    out = language.identified(odd, language.learn(odd)).collect()
    assert len(out) == odd.count()
    for r in out:
        has_letter = any(c.isalpha() for c in r["doc"]["text"] or "")
        assert (r["lang_pred"] == "und") == (not has_letter)


def test_language_sizes_scores_and_ties_equal_brute_force(spark):
    rng = random.Random(3)
    texts = {lang: " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(400)) for lang, s in {"aa": "abcdef", "bb": "uvwxyz"}.items()}
    samples = {"aa": texts["aa"].encode(), "bb": texts["bb"].encode()}
    rows = [(1, texts["aa"][:300], 0), (2, texts["bb"][100:900].upper() + " 12!", 0), (3, texts["aa"][:50] + texts["bb"][:50], 0), (4, texts["bb"] * 9, 0)]
    got = {r["doc"]["doc_id"]: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, score int"), samples).collect()}
    for i, text, _ in rows:
        plain, sizes = language.letters(text).encode(), {}
        for lang, sample in samples.items():
            content = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(plain[j : j + language.BLOCK])) for j in range(0, len(plain), language.BLOCK))
        best, other = sorted(sizes, key=lambda lang: sizes[lang])
        score = (sizes[other] - sizes[best]) / sizes[other]
        assert got[i]["score"] == pytest.approx(score, abs=0.02) and got[i]["rejected"] == (got[i]["score"] < language.MARGIN)
        assert score < 0.02 or got[i]["lang_pred"] == best
    same = language.Classifier({"zz": samples["aa"], "aa": samples["aa"]})
    assert same.predict(texts["aa"]) == ("zz", 0.0)  # a tie goes to the first, which has the most rows
    alone = language.Classifier({"aa": samples["aa"]})
    assert alone.predict("anything") == ("aa", 1.0) and alone.predict("12 !") == ("und", 0.0)


def test_language_sample_takes_any_part_of_whole_texts(spark):
    long = "\n".join(f"line{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(6000))
    docs = spark.createDataFrame([(i, long, "en") for i in range(40)] + [(100, "short", "de")], "doc_id long, text string, lang string")
    samples = language.learn(docs)
    held = len(samples["en"])
    assert samples["de"] == b"short" and held <= language.SAMPLE_PIECES * (language.PIECE_BYTES + 1)
    assert held > 0.7 * language.SAMPLE_PIECES * language.PIECE_BYTES  # letters only
    last = long[len(long) // 2 :].split("\n")[5:]
    assert sum(line.encode() in samples["en"] for line in last) > len(last) / 4


def brute_components(rows, width):
    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        words = [w for part in words for w in part.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, corpus_dir, width):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = near_dedup.near_duplicates(docs, width=width).select("doc.doc_id", "n_shingles", "component_id", "stays").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, width))
    assert any(r["component_id"] != r["doc_id"] for r in got)


def test_near_duplicates_edges(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = near_dedup.near_duplicates(odd, width=2).select("doc.doc_id", "n_shingles", "component_id", "stays").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute_components(rows, 2), key=key)
    linked = [r for r in got if r["n_shingles"]]
    assert sum(r["stays"] for r in linked) == len({r["component_id"] for r in linked})
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_large_group_of_edited_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, width=2).select("doc.doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 2))


def test_of_bands_with_the_same_members_one_is_kept(spark):
    rows = [(1, 10), (2, 10), (1, 11), (2, 11), (1, 12), (3, 12), (4, 13), (1, 14), (2, 14), (3, 14)]
    got = near_dedup.common_bands(spark.createDataFrame(rows, "node long, band long")).collect()
    assert sorted(r["band"] for r in got) == [10, 12, 14]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (near_dedup.merge(ra, rb) == near_dedup.registers(np.union1d(a, b))).all()
    counts = [np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([(ra == rb).sum()])]
    got = near_dedup.estimate(*counts, np.array([2000.0]), np.array([2000.0]))[0]
    assert got == pytest.approx(0.6, abs=0.08)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (102, 101), (7, 7), (200, 100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100, 200: 100}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(300)]
    rows += [(300, None, "x"), (301, [1.0, float("nan")], "x"), (302, [None, 1.0], "x"), (350, [0.5, 0.25], "x"), (350, [0.5, 0.25], "x"), (50, rows[50][1], "x"), (None, [1.0], "x"), (400, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    good = [(i, np.floor(256.0 * np.array([np.float32(x) for x in v], dtype=float))) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        x = min(v.tolist() for i, v in good if i == q)
        scores = sorted((-int(sum(a * b for a, b in zip(x, v, strict=False))), i) for i, v in good if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, pivots=8).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_of_huge_components_is_exact(spark):
    rng = random.Random(9)
    sizes = [1.0, 1e9, 1e13, 1e17, 1e30, 3e38]
    rows = [(i, [rng.uniform(-1, 1) * sizes[rng.randrange(1 + i % 6)] for _ in range(3)]) for i in range(120)]
    rows += [(200, [1e307, 1.0, 1.0]), (201, [-1e305, 0.0, 2.0]), (202, [1.0, 1e200, -1e200])]  # 256 * 1e307 is no double
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(256 * x // 1) for x in v] for i, v in rows if all(abs(256 * x) < float("inf") for x in v)}
    assert set(whole) == {i for i, _ in rows} - {200}
    want = []
    for q in sorted(whole):
        if q % 10 == 0:
            scores = {i: max(topk.LONG_MIN, min(topk.LONG_MAX, sum(a * b for a, b in zip(whole[q], v, strict=True)))) for i, v in whole.items() if i != q}
            want += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5])]
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, pivots=6).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_moves_rows_only_where_they_are_wanted(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = np.eye(6) * 100_000

    def moved(n_queries: int) -> tuple[int, int]:
        x = np.concatenate([centres[i % 6] + rng.normal(size=(1, 6)) for i in range(1200)]).round()
        rows = [(i, i < n_queries, v.tolist()) for i, v in enumerate(x)]
        cells = topk.place(spark.createDataFrame(rows, "id long, asks boolean, v array<double>"), centres, 6)
        summary = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r"), F.count_if("asks").alias("q")).collect()}
        n, r, q = (np.array([float(summary[c][k]) for c in range(6)]) for k in ("n", "r", "q"))
        asked, held = topk.exchanged(cells, topk.Cells(centres, n, r, r, 6), q)
        return asked.count(), held.count()

    monkeypatch.setattr(topk, "QUERIES_PER_PART", 20)
    (asked, held), (asked2, held2) = moved(120), moved(240)
    assert (held, asked) == (1200, 120)  # each query wants its own cell, each row goes to one part
    assert held2 <= 2 * held and asked2 == 2 * asked


def test_top_k_parts_hold_near_groups():
    pivots = np.array([[0.0], [10.0], [1.0], [11.0], [2.0]])
    first, parts = topk.dealt(pivots, np.array([topk.QUERIES_PER_PART * 2 + 1, 5, 5, 5, 5]))
    assert parts == [3, 1, 1, 1, 1] and first[0] == 0 and first[1:] == [3, 3, 3, 3]
    first, parts = topk.dealt(pivots, np.full(5, topk.QUERIES_PER_PART // 2))
    assert parts == [1] * 5 and first[0] == first[2] and first[1] != first[2] and max(first) == 2
    assert topk.dealt(pivots, np.zeros(5)) == ([0] * 5, [1] * 5)


@pytest.mark.parametrize("plan_rows", [0, 1_000_000])
def test_top_k_over_several_parts_and_blocks(spark, monkeypatch, plan_rows):
    for name, value in (("PLAN_ROWS", plan_rows), ("QUERIES_PER_PART", 7), ("ROWS_PER_BLOCK", 20)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size=4)]) for i in range(200)]
    rows += [(1000 + i, [1.0, 1.0, 0.0, 2.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = {i: 256 * np.array(v, dtype=int) for i, v in rows}
    want = [(q, r + 1, i, -s) for q in x if q % 5 == 0 for r, (s, i) in enumerate(sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:5])]
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, pivots=8).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_skips_cells_that_cannot_win():
    rng = np.random.default_rng(0)
    pivots = np.eye(8) * 1000
    cells = topk.Cells(pivots, np.full(8, 50.0), np.full(8, 10.0), np.full(8, 10.0), 6)
    wanted = cells.cells_of(pivots + rng.normal(size=(8, 8)), np.arange(8))
    assert wanted.sum() == 8 and wanted.diagonal().all()


def test_pipeline_equals_brute_force(spark, corpus_dir, library):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    name, stage = corpus_pipeline.STAGES[0]
    told = stage(spark, docs, corpus_dir)
    assert told.columns == docs.columns and {900, 901, 902} & {r["doc_id"] for r in told.collect()} == set()
    cleaned = corpus_pipeline.STAGES[1][1](spark, told, corpus_dir)
    by_source = {}
    for r in told.collect():
        by_source.setdefault(r["source"], []).append((r["doc_id"], r["text"]))
    want = {}
    for rows in by_source.values():
        pages = {}
        for i, t in rows:
            for line in {x.strip() for x in t.split("\n")} - {""}:
                pages.setdefault(line, set()).add(i)
        bad = {x for x, p in pages.items() if len(p) >= 2 and len(p) > corpus_pipeline.SOURCE_RATIO * len(rows)}
        want |= {i: "\n".join(x for x in t.split("\n") if x.strip() not in bad) for i, t in rows}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()} and any("cookies" in t for t in (r["text"] for r in told.collect()))
    kept = corpus_pipeline.STAGES[2][1](spark, cleaned, corpus_dir)
    groups = brute_components(sorted(want.items()), 5)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in groups if d == c)
    out = [tuple(r) for r in corpus_pipeline.run(spark, corpus_dir).collect()]
    assert out and {r[0] for r in out} <= {r["doc_id"] for r in kept.collect()}
    for doc_id, n, ids, decoded in out:
        expected = library.encode_ordinary(want[doc_id])
        assert n == len(expected) and ids == hashlib.sha256(np.array(expected, dtype="<u4").tobytes()).hexdigest()
        assert decoded == hashlib.sha256(want[doc_id].encode()).hexdigest()
    assert max(sum(1 for r in out if r[0] == i) for i in {r[0] for r in out}) <= 3


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_pipeline_drops_shared_lines_of_the_shipped_tables(spark, sf):
    def shared(docs):
        texts = {}
        for i, r in enumerate(docs.select("source", "text").collect()):
            for line in {x.strip(" \t\r\x0b\x0c") for x in r["text"].split("\n")} - {""}:
                texts.setdefault((r["source"], line), set()).add(i)
        return {k for k, v in texts.items() if len(v) >= 2 and len(v) > 0.01 * sizes[k[0]]}

    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    sizes = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    assert len(shared(docs)) > 100 and not shared(corpus_pipeline.dedup_lines(spark, docs, ""))


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == table.columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()
