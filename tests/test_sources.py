"""File scans, page readers, provider records, cursors, record matching and the streaming fold."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from doclake.operators import cursor, match
from doclake.sources import files, works
from doclake.streaming import events

SF = "/root/testdata/sf0.001"


def test_scan_identifies_by_bytes(spark, tmp_path):
    tree = {"a/x.txt": b"hello", "a/b/y.PDF": b"%PDF-1.7 x", "copy of x.txt": b"hello", "z.bin": b"\x00\x01"}
    for name, data in tree.items():
        path = tmp_path / "lib" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    rows = {r["relative_path"]: r for r in files.scan_tree(spark, f"file://{tmp_path}/lib").collect()}
    assert set(rows) == set(tree)
    assert all(rows[n]["artifact_id"] == hashlib.sha256(d).hexdigest() and rows[n]["size"] == len(d) for n, d in tree.items())
    assert [rows[n]["content_kind"] for n in tree] == ["text", "pdf", "text", "binary"]


def test_pages_of_text_files(spark):
    rows = [("a", b"one\ftwo\f"), ("b", b"\xff\xfe"), ("c", b"%PDF-1.4 broken")]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in rows], "artifact_id string, content binary")
    got = sorted((r["artifact_id"], r["pdf_page"] or 0, r["text_state"]) for r in files.read_pages(df).collect())
    assert got == [("a", 1, "text_sparse"), ("a", 2, "text_sparse"), ("a", 3, "blank"), ("b", 0, "failed"), ("c", 0, "failed")]


def test_legacy_import_outcomes(spark):
    sha = [c * 64 for c in "abcdef"]
    old = [("p1", sha[0], 1), ("p2", sha[0], 1), ("p3", sha[1], 9), ("p4", sha[2], 1), ("p5", sha[3], 1), ("p6", sha[4], 1), ("p7", "zz", 1)]
    artifacts = spark.createDataFrame([(s, 1) for s in (sha[0], sha[1], sha[3], sha[4])], "artifact_id string, size long")
    held = spark.createDataFrame([(sha[3], "native"), (sha[4], "imported")], "artifact_id string, source string")
    out = files.import_legacy(spark.createDataFrame(old, "path string, sha string, size long"), artifacts, held)
    want = {"p1": "imported", "p2": "duplicate", "p3": "size_differs", "p4": "unknown_file", "p5": "already_native", "p6": "already_imported", "p7": "bad_hash"}
    assert {r["path"]: r["outcome"] for r in out.collect()} == want


def test_plan_items_are_checked(spark, tmp_path):
    item = {"item": "1", "root_id": "r", "location_id": "l", "artifact_id": "a", "old_path": "x", "new_path": "d/y.txt"}
    (tmp_path / "plan.json").write_text("\n".join(json.dumps(x) for x in (item, item | {"new_path": "../y"}, {k: v for k, v in item.items() if k != "root_id"})))
    got = [r["problems"] for r in files.read_plan(spark, f"file://{tmp_path}/plan.json").collect()]
    assert got == [[], ["not_allowed"], ["no_root_id"]]


TITLE = "Hansen solubility parameters of aqueous mixtures"


def work(**more):
    return {"DOI": "10.1234/A", "title": [f"<i>{TITLE}</i>"], "author": [{"family": "Kaya", "given": "A"}], "issued": {"date-parts": [[2020, 1]]}, "type": "journal-article"} | more


def test_works_and_verdicts(spark):
    raw = spark.createDataFrame([(json.dumps(work()),), (json.dumps(work(DOI="10.1234/b", type="posted-content")),), ("no json",)], "json string")
    found = works.normalise_works(raw)
    rows = {r["doi"]: r for r in found.collect()}
    assert rows["10.1234/a"]["title"] == TITLE and rows["10.1234/a"]["year"] == 2020 and rows["10.1234/b"]["preprint"] and rows[None]["title"] is None
    texts = [
        ("exact", f"{TITLE}\nA. Kaya 2020", TITLE),
        ("strong", f"{TITLE}\nA. Kaya 1999", TITLE),
        ("strong", f"Correction to {TITLE}, Kaya 2020", f"Correction to {TITLE}"),
        ("weak", f"{TITLE} 2020", TITLE),
        ("contradicted", "something else", None),
    ]
    docs = spark.createDataFrame([(str(i), w, t, lay) for i, (w, t, lay) in enumerate(texts)], "document_id string, want string, text string, layout_title string")
    got = match.verify(docs.crossJoin(found.filter("doi = '10.1234/a'"))).select("want", "level").collect()
    assert all(r["want"] == r["level"] for r in got)
    both = match.choose(match.verify(docs.filter("want = 'exact'").crossJoin(found.filter("doi IS NOT NULL")))).collect()
    assert [(r["doi"], r["ambiguous"]) for r in both] == [("10.1234/a", False)]


def test_cursors_refuse_what_has_changed(spark):
    listing = cursor.Listing(7, cursor.question("search", q="x"))
    text = listing.following(0, ["a", "b"], True)
    assert listing.start(text, lambda i: "b") == 2 and listing.start(None) == 0
    assert listing.following(0, ["a"], False) is None and listing.following(4999, ["a"], True) is None and listing.following(0, [], True) is None
    others = [cursor.Listing(8, listing.question), cursor.Listing(7, cursor.question("list", q="x")), cursor.Listing(7, cursor.question("search", q="y"))]
    for other in others:
        with pytest.raises(cursor.CursorError):
            other.start(text)
    for bad in (text[:-2], "%%", "a", text[:-1] + ("a" if text[-1] != "a" else "b")):
        with pytest.raises(cursor.CursorError):
            listing.start(bad)
    with pytest.raises(cursor.CursorError):
        listing.start(text, lambda i: "moved")
    for n in (0, 1001):
        with pytest.raises(cursor.CursorError):
            cursor.checked_limit(n)
    rows = spark.range(50)
    assert [r["id"] for r in cursor.page(rows, ["id"], 3, 10).collect()] == [10, 11, 12, 13]
    with pytest.raises(cursor.CursorError):
        cursor.page(rows, ["id"], 1000, 4500)


def test_the_streamed_fold_equals_the_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).select(*[c.split()[0] for c in events.SCHEMA.split(", ")]).repartition(3).write.parquet(f"file://{tmp_path}/in")
    query = events.fold_state(events.read_events(spark, f"file://{tmp_path}/in", files=1), f"file://{tmp_path}/state", f"file://{tmp_path}/cp")
    query.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "state").iterdir())
    got = {r["user_id"]: r["e"]["event_id"] for r in spark.read.parquet(f"file://{tmp_path}/state/{last}").collect()}
    want = rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()
    assert got == {r["user_id"]: r["e"] for r in want}
