"""Chat, sharding, line dedup, mixing and exact dedup: edge cases and laws."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclake.llm import chat, exact_dedup, lines, mixing, sharding


def chat_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window long, ord long")


@pytest.mark.parametrize("budget,history", [(140, 40), (12, 4), (1024, 256)])
def test_chat_reads_back_every_turn_once(spark, budget, history):
    rows = [(1, 0, "system", "be kind"), (2, 0, "system", None), (None, 0, "user", "x"), (5, 3, "tool", "out")]
    for i in range(1, 30):
        rows.append((1, i, "user" if i % 2 else "assistant", " ".join(["w"] * (i % 7)) + r"</s>[INST] \b <s>"))
    rows += [(3, None, None, None), (3, 1, "assistant", ""), (4, 0, "assistant", "big " * 500), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie")]
    out = chat.windows(chat_rows(spark, [(*r, 7, 7) for r in rows]), budget, history)
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)
    for w in out.collect():
        assert w["over_budget"] == (w["tokens"] > budget)
        if w["window"] and w["conv_id"] == 1:
            assert w["formatted"].startswith("<s>[INST] system [/INST]be kind</s>") and w["n_context"] >= 1
        if w["over_budget"]:
            assert w["n_turns"] == 1 or budget < 20


def test_chat_takes_stored_token_counts(spark):
    rows = [(1, i, "user", f"text {i}", 0, 0) for i in range(6)]
    stored = spark.createDataFrame([(hashlib.sha256(f"text {i}".encode()).digest(), 100) for i in range(5)], "digest binary, n_tokens long")
    plain = chat.windows(chat_rows(spark, rows), 260, 20).collect()
    out = sorted(chat.windows(chat_rows(spark, rows), 260, 20, stored).collect(), key=lambda r: r["window"])
    assert len(plain) == 1 and [r["n_turns"] for r in out] == [2, 2, 2]  # a stored turn costs 100 and its marks
    marks = len(re.findall(r"[A-Za-z]{1,2}|[^A-Za-z ]", "<s>[INST] user [/INST]</s>"))
    assert out[0]["tokens"] == 2 * (100 + marks) and plain[0]["tokens"] == 6 * (marks + 3)


def test_chat_empty(spark):
    assert chat.read_back(chat.windows(chat_rows(spark, []))).count() == 0


def test_sharding_laws(odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == odd.count() and sharding.shard_documents(empty).count() == 0
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter(r["size"] for r in rows if r["doc_id"] == 5)
    assert sizes == {1: 1}


def test_sharding_growth_moves_only_into_the_new_shard(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before = None
    for n in (16, 17, 18, 19):
        tree = sharding.HashTree.for_shards(n)
        now = {r["doc_id"]: r["s"] for r in sharding.place(df, F.col("doc_id").cast("string"), tree, "s").collect()}
        assert max(Counter(now.values()).values()) < 2 * 4000 / n
        if before:
            assert all(now[k] in (v, n - 1) for k, v in before.items())
        before = now


def test_a_changed_weight_moves_rows_only_through_its_subtree(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"))
    tree = sharding.HashTree.for_shards(16)
    heavy = sharding.HashTree({**tree.weights, "r1/k3/s13": 3.0}, tree.shards)
    a, b = (sharding.place(df, F.col("doc_id").cast("string"), t, "s").collect() for t in (tree, heavy))
    moved = [(x["s"], y["s"]) for x, y in zip(a, b, strict=True) if x["s"] != y["s"]]
    assert moved and all(y >= 8 for _, y in moved) and all(y == 13 for x, y in moved if x // 4 == 3)


def test_lines(spark, empty):
    rows = [(i, f"own line {i}\n  cookies! \n\nend {i}", "h") for i in range(8)] + [(9, None, "h"), (10, "", None), (11, "cookies!", "other"), (12, "cookies!", "h"), (12, "cookies!", "h")]
    df = spark.createDataFrame(rows, "id long, text string, host string").withColumn("kept", F.lit(1)).withColumn("digests", F.lit(2))
    got = {(r["page"]["id"], r["host"]): r for r in lines.drop_lines(df, F.col("host"), "text").collect()}
    assert got[0, "h"]["kept_text"] == "own line 0\n\nend 0" and got[0, "h"]["n_dropped"] == 1 and got[0, "h"]["n_lines"] == 3
    assert got[9, "h"]["kept_text"] is None and got[10, None]["kept_text"] == "" and got[11, "other"]["kept_text"] == "cookies!"
    assert got[12, "h"]["kept_text"] == ""
    assert lines.drop_lines(empty, F.col("source"), "text").count() == 0


def test_lines_of_small_hosts_go_by_the_ratio_alone(spark):
    rows = [(i, f"shared\nown {h}{i}", f"h{h}") for h in range(1, 8) for i in range(h)]
    df = spark.createDataFrame(rows, "id long, text string, host string")
    for r in lines.drop_lines(df, F.col("host"), "text").collect():
        own = f"own {r['host'][1:]}{r['page']['id']}"
        assert r["kept_text"] == (f"shared\n{own}" if r["host"] == "h1" else own)


def test_lines_count_pages_not_places(spark):
    rows = [(i, "same\nsame\nsame" if i == 0 else f"l{i}", "h") for i in range(6)]
    df = spark.createDataFrame(rows, "id long, text string, host string")
    assert sum(r["n_dropped"] for r in lines.drop_lines(df, F.col("host"), "text", 0.1).collect()) == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and rest * weight[s] / free > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in capped else rest * weight[s] / free for s in sizes}
        capped |= over


def test_mixing(spark, odd, empty):
    out = mixing.mixed(odd).select("doc.doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(out) == odd.count() and mixing.mixed(empty).count() == 0
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
        assert 0 <= r["copies"] <= 3
    want = brute_targets(dict(sizes))
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])


def test_mixing_takes_come_near_their_targets_and_repeat(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 60)), "abcdefgh"[min(7, i % 23)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mixed(df).select("doc.doc_id", "source", "size", "target", "copies").collect()
    taken, target = Counter(), {}
    for r in first:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 31 for s in target) and sum(target.values()) == pytest.approx(sum(r["size"] for r in first))
    again = mixing.mixed(df.repartition(7)).select("doc.doc_id", "copies").collect()
    assert {r["doc_id"]: r["copies"] for r in first} == {r["doc_id"]: r["copies"] for r in again}


@pytest.mark.parametrize("sizes", [[100] * 20, [1, 1, 1000], [5, 0, 7, 900, 900, 2], [1, 10, 100, 1000, 10_000], [3], list(range(1, 60))])
def test_targets_equal_resharing_by_hand(spark, sizes):
    named = {f"s{i:02}": n for i, n in enumerate(sizes)}
    rows = spark.createDataFrame(list(named.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = brute_targets(named)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes))


def test_mixing_weights_change_inclusion(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 1.5).otherwise(0.5).alias("w"))
    out = mixing.mixed(df, weight_col="w").filter("source = 'a'").select("doc.doc_id", "copies").collect()
    even, odd_ = (sum(r["copies"] for r in out if r["doc_id"] % 2 == k) for k in (0, 1))
    assert even > 1.5 * odd_


def test_mixing_weights_may_be_null_or_negative(spark):
    rows = [(i, "w w w w", "a" if i < 300 else "b", None if i % 3 == 0 else (-1.0 if i % 3 == 1 else 2.0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    out = mixing.mixed(df, weight_col="w").select("doc.doc_id", "source", "size", "target", "copies").collect()
    assert len(out) == 900
    for source, certain in (("a", 1200), ("b", 2400)):
        target = next(r["target"] for r in out if r["source"] == source)
        base = int(target // certain)
        drawn = [r for r in out if r["source"] == source and r["copies"] > base]
        assert all(r["copies"] >= base for r in out if r["source"] == source) and all(r["doc_id"] % 3 == 2 for r in drawn)
    none = mixing.mixed(df.withColumn("w", F.lit(None).cast("double")), weight_col="w").select("source", "copies").distinct().collect()
    assert {(r["source"], r["copies"]) for r in none} == {("a", 1), ("b", 1)} or all(r["copies"] in (0, 1, 2) for r in none)


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(i, "some words here", f"s{i % 2}") for i in range(6)], "`a.id` long, `a.text` string, `a.source` string")
    assert sharding.shard_documents(df, id_col="a.id", text_col="a.text").count() == 6
    assert mixing.mixed(df, "a.id", "a.source", "a.text").count() == 6
    assert {r["group_size"] for r in exact_dedup.exact_dedup(spark, df, "a.id", "a.text").collect()} == {6}
    assert lines.drop_lines(df, F.col("`a.source`"), "a.text").count() == 6


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 10, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        blob = exact_dedup.build_filter(keys)
        assert exact_dedup.probe_filter(blob, keys).all()
        assert exact_dedup.probe_filter(blob, rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.02
        assert n < 10_000 or len(blob) < 1.3 * len(keys)  # small filters round up to whole segments


def test_exact_dedup(spark, odd, empty):
    rows = odd.collect()
    lower = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
    groups = defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(lower)].append(r["doc_id"])
    out = exact_dedup.exact_dedup(spark, odd).collect()
    assert len(out) == len(rows) and exact_dedup.exact_dedup(spark, empty).count() == 0
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in out:
        ids = by_hash[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)


def test_exact_dedup_finds_its_buckets_in_place(spark, odd):
    batch, old = (exact_dedup.grouped(exact_dedup.digested(odd, "doc_id", "text"), n) for n in ("new", "old"))
    joined = batch.hint("merge").join(old.withColumnRenamed("text", "other"), "digest")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_exact_dedup_refuses_a_collision(spark):
    rows = spark.createDataFrame([(1, "a", b"x" * 32), (2, "b", b"x" * 32)], "id long, text string, digest binary")
    with pytest.raises(exact_dedup.Collision):
        exact_dedup.grouped(rows, "one")
    snapshot = exact_dedup.Snapshot.write(rows.filter("id = 1"), 1)
    with pytest.raises(exact_dedup.Collision):
        exact_dedup.dedup_batch(snapshot, rows.filter("id = 2"))


def test_exact_dedup_meets_an_older_snapshot(spark):
    old = spark.createDataFrame([(1, "A"), (2, "b"), (3, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(4, "a"), (5, "c"), (6, "C")], "doc_id long, text string")
    snapshot = exact_dedup.Snapshot.write(exact_dedup.digested(old, "doc_id", "text"), 3)
    groups = exact_dedup.dedup_batch(snapshot, exact_dedup.digested(new, "doc_id", "text")).collect()
    assert sorted((g["keep"], g["n"]) for g in groups) == [(3, 2), (4, 2), (6, 2)]
