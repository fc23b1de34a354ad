"""Column functions against plain Python, on edge cases and on random text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from doclake.functions import exact, identifiers, naming, text


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_keys_fold_like_unicode(spark):
    texts = ["Straße Élan", "naïve—Café", "", None, "ŁÓDŹ Ångström ﬁ", "A_b-C 12"]
    latin = [t for t in texts if t is None or not set(t) & set("ﬁŁ")]
    assert column(spark, latin, text.alnum_key) == [exact.key_text(t) for t in latin]
    assert column(spark, texts, exact.alnum_key) == [exact.key_text(t) for t in texts]


def test_title_rules(spark):
    assert column(spark, ["T H E E F F E C T", "Vitamin B 12", "Phase A and B", "a b c d"], text.looks_garbled) == [True, False, False, True]
    junk = ["Microsoft Word - x.docx", "untitled", "paper.pdf", "10.1234/abc", "ISBN 978", "abc", "A real title of a paper", "https://x.org/long/name", "12.34-56"]
    assert column(spark, junk, text.is_junk_title) == [True, True, True, True, True, True, False, True, True]
    assert column(spark, ["<i>A</i> &lt;b&gt;  c ", None], text.clean) == ["A <b> c", ""]
    assert column(spark, ["Hansen_solubility-parameters handbook", "cm4c01978", "kaya2022"], text.filename_title_hint) == ["Hansen solubility parameters handbook", None, None]
    assert column(spark, ["kaya2022", "Kaya_1999b_x", "kaya22"], lambda c: text.filename_author_year(c)[1]) == [2022, 1999, None]
    assert column(spark, ["Erratum: x", "corrections", "Reply to y"], lambda c: text.is_correction(c, F.lit(""))) == [True, False, True]
    assert column(spark, ["paper_si.pdf", "supp-1", "basic"], text.supplement_name_hint) == [True, True, False]
    assert column(spark, [["solu-", "bility"], ["a", "b"], ["x"]], text.join_lines, "array<string>") == ["solubility", "a b", "x"]


def test_page_rules(spark):
    assert column(spark, [0, 10, 50], lambda c: text.page_state(c, F.lit(1), F.lit(False)), "long") == ["image_only", "text_sparse", "text_native"]
    assert column(spark, [0, 10, 50], text.imported_page_state, "long") == ["unknown", "text_sparse", "text_native"]
    assert column(spark, [0, 299, 300], lambda c: text.is_scanned(c, F.lit(3)), "long") == [True, True, False]


def test_dois(spark):
    raw = ["https://doi.org/10.1234/ABC.", "doi: 10.1002/(SICI)1097-0126(1999)48:1).", "10.1234/x)]}>", "11.1/x", None, "10.1234/" + "a" * 300, "10.1/x"]
    want = ["10.1234/abc", "10.1002/(sici)1097-0126(1999)48:1", "10.1234/x", None, None, None, None]
    assert column(spark, raw, identifiers.normalise_doi) == want
    assert column(spark, ["10.1234/abc" + ")" * 9, "10.1234/abc" + ")." * 30 + ",", "10.1234/a(b)" + "]" * 12], identifiers.normalise_doi) == ["10.1234/abc", "10.1234/abc", "10.1234/a(b)"]
    once = [w for w in want if w]
    assert column(spark, once, identifiers.normalise_doi) == once
    assert column(spark, ["see 10.1234/a, 10.1234/b. and 10.1021/acs.jcim.\n2c01234 end"], identifiers.find_dois) == [["10.1234/a", "10.1234/b", "10.1021/acs.jcim.2c01234"]]


def test_identifiers(spark):
    assert column(spark, ["9780306406157", "9780306406158", "0306406152", "080442957X", "x"], identifiers.isbn_ok) == [True, False, True, True, False]
    assert column(spark, ["arXiv:2101.00001v2", "hep-th/9901001", "2101.1"], lambda c: identifiers.normalise(F.lit("arxiv"), c)) == ["2101.00001", "hep-th/9901001", None]
    assert column(spark, ["1999", "99", "3000"], lambda c: identifiers.normalise(F.lit("year"), c)) == ["1999", None, None]
    assert column(spark, ["A, B; C ;; "], lambda c: identifiers.authors_display(identifiers.parse_authors(c))) == ["A, B; C"]
    assert column(spark, ["Ann Lee; Bo & Cy Day and 12"], identifiers.split_authors) == [["Ann Lee", "Cy Day"]]


def test_references_round_trip(spark):
    ident = "a" * 32
    uri = identifiers.reference_uri("doc", F.lit("document"), F.lit(ident), F.lit(None).cast("int"), F.col("v"))
    rows = spark.createDataFrame([("S 1",), ("xi",), ("ü/ä",)], "v string").select("v", identifiers.parse_reference("doc", uri).alias("r")).collect()
    assert all(r["r"]["id"] == ident and r["r"]["label"] == r["v"] for r in rows)
    bad = ["doc://document/xyz", f"doc://document/{ident}/page/0", f"doc://artifact/{ident}", f"doc://document/{ident}/page/1/label/2"]
    assert column(spark, bad, lambda c: identifiers.parse_reference("doc", c)) == [None] * 4


def test_names(spark):
    assert column(spark, ['a:b/c "d" <e>?', " x\t\ny. ", "a‮b", None], naming.clean_component) == ["a - b - c 'd' e", "x y", "ab", ""]
    assert column(spark, ["CON", "con.v2", "CONE", "lpt1"], naming.avoid_reserved) == ["CON_", "con_.v2", "CONE", "lpt1_"]
    long = "w" * 200
    cut = column(spark, [long], naming.shorten)[0]
    assert len(cut) == 120 and cut[111] == "~"
    problems = ["a/b.txt", "/a", "a/../b", "a:b", "a /b", "nul.txt", "x" * 201, "a?b"]
    want = [[], ["not_relative", "not_allowed"], ["not_allowed"], ["colon"], ["dot_or_space_at_end"], ["reserved_name"], ["too_long"], ["forbidden_character"]]
    assert column(spark, problems, naming.component_problems) == want
    people = F.from_json(F.lit('[{"family":"Kaya","given":"A"},{"name":"Team"}]'), identifiers.AUTHORS)
    assert column(spark, ["On: Salt"], lambda c: naming.name_for(c, people, F.lit("2020"), F.lit(".PDF"))) == ["Kaya et al. (2020) - On - Salt.pdf"]


def test_kinds(spark):
    heads = [b"%PDF-1.7", b"junk %PDF-1", b"PK\x03\x04", b"plain text", b"\x00\x01", b"", b"\x89PNG\r\n\x1a\n", b"\xff\xfe\xfa"]
    want = ["pdf", "pdf", "zip_container", "text", "binary", "empty", "image", "binary"]
    assert column(spark, heads, lambda c: naming.content_kind(c, F.octet_length(c)), "binary") == want
    assert column(spark, ["a/b.PDF", ".hidden", "x.tar.gz", "noext"], naming.extension_of) == ["pdf", "", "gz", ""]
    assert column(spark, ["a.docx", "a.pdf", "a.bin"], lambda c: naming.kinds_disagree(c, F.lit("zip_container"))) == [False, True, False]


def test_similarity_is_the_sequence_ratio(spark):
    rows = spark.createDataFrame([("A title of things", "a Title, of thing"), ("", "x"), (None, None)], "a string, b string")
    got = [r[0] for r in rows.select(exact.similarity("a", "b")).collect()]
    assert got == [pytest.approx(exact.ratio("A title of things", "a Title, of thing")), 0.0, 0.0]


def test_a_threshold_is_judged_as_the_ratio_is_without_matching_all(spark, monkeypatch):
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [t[: len(t) // 2] + "x" + t[len(t) // 2 :] for t in texts]
    for least in (0.5, 0.9, 1.0):
        assert all(exact.ratio_reaches(a, b, least) == (exact.ratio(a, b) >= least) for a in texts for b in texts)
    monkeypatch.setattr(exact, "SequenceMatcher", None)  # equal keys, lengths and letters tell these
    assert exact.ratio_reaches("a" * 100_000, "a" * 100_000, 0.9)
    assert not exact.ratio_reaches("a" * 100_000, "a" * 50_000, 0.9) and not exact.ratio_reaches("ab" * 50_000, "cd" * 50_000, 0.9)


def test_long_titles_are_compared_by_bounds_first(spark):
    from doclake.operators import specs

    title = "An endless title of equal words " * 3_000  # matching two of these takes hours
    rows = spark.createDataFrame([("d", "layout_title", title), ("d", "pdf_info_title", title.upper()), ("d", "pdf_xmp_title", None), ("e", "layout_title", title), ("e", "pdf_info_title", "Another")], "document_id string, source string, value string")
    front = spark.createDataFrame([("d", title), ("e", "nothing")], "document_id string, text string")
    got = {(r["document_id"], r["source"]): (r["confidence"], r["review"]) for r in specs.title_specs(rows, front).collect()}
    assert got == {("d", "layout_title"): ("high", "safe"), ("d", "pdf_info_title"): ("high", "safe"), ("e", "layout_title"): ("low", "required"), ("e", "pdf_info_title"): ("low", "required")}


def test_titles_are_compared_within_their_document(spark):
    from collections import Counter

    from doclake.operators import specs

    values = ["One Title of Some Length", "ONE TITLE OF SOME LENGTH!", "One Title of Same Length", "Élan vital", "elan vital", "***"]
    told = [(f"s{i % 4}", v) for i, v in enumerate(values)] + [("s0", values[0]), ("s0", values[5])]
    want = {}
    for s, v in told:
        want.setdefault((s, v), []).extend(t for t, w in told if t == s or exact.ratio(v, w) >= 0.9)
    got = dict(pair for pair in zip(told, exact.agreeing_sources(*zip(*told, strict=True), 0.9), strict=True) if pair[1] is not None)
    assert {k: Counter(v) for k, v in got.items()} == {k: Counter(v) for k, v in want.items()}
    found = spark.createDataFrame([("d", s, v) for s, v in told], "document_id string, source string, value string")
    rows = specs.title_specs(found, spark.createDataFrame([("d", values[0])], "document_id string, text string"))
    assert rows.count() == len(want)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # with the front texts; none of titles with titles


def test_column_keys_are_the_usual_keys(spark):
    rows = spark.createDataFrame([("A b_C-9!",), ("Straße Élan",), ("",), (None,), ("İK ſ",)], "t string")
    assert all(a == b for a, b in rows.select(text.column_key("t"), text.alnum_key(F.col("t"))).collect())
