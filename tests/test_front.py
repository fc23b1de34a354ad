"""Layout titles and XMP fields on hand-written pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.operators import front

LINES = [
    # masthead in page two's header, a banner in the title's size, a title over two lines with a broken word, body text
    ("a", 0, 1, "Journal of Invented Results", 24.0, 40.0), ("a", 1, 1, "Case Report", 18.0, 100.0), ("a", 2, 1, "Solubility of xyle-", 18.0, 120.0),
    ("a", 3, 1, "nol in Water", 18.0, 140.0), ("a", 4, 1, "b" * 400, 10.0, 300.0), ("a", 5, 2, "Journal of Invented Results 7", 9.0, 30.0),
    # two groups of one size: the upper wins; links and the lower part of the page are no titles
    ("b", 0, 1, "First candidate title", 16.0, 90.0), ("b", 1, 1, "Second candidate title", 16.0, 300.0), ("b", 2, 1, "https://example.org/long", 30.0, 50.0),
    ("b", 3, 1, "Something printed large below", 30.0, 700.0), ("b", 4, 1, "c" * 500, 10.0, 400.0),
    # contents entry and a short line only; one size only
    ("c", 0, 1, "1.2 Introduction of things", 20.0, 90.0), ("c", 1, 1, "Short", 20.0, 300.0), ("c", 2, 1, "d" * 500, 10.0, 400.0),
    ("d", 0, 1, "All lines have one size here", 10.0, 90.0), ("d", 1, 1, "   ", 30.0, 95.0),
]


def test_layout_titles(spark):
    rows = spark.createDataFrame(LINES, "artifact_id string, i int, p int, t string, s double, y double").withColumn("height", F.lit(None).cast("double"))
    got = {r["artifact_id"]: (r["title"], r["size"], r["body"], r["lines"]) for r in front.layout_titles(rows.repartition(5)).collect()}
    assert got == {"a": ("Solubility of xylenol in Water", 18.0, 10.0, 2), "b": ("First candidate title", 16.0, 10.0, 1)}
    assert front.layout_titles(rows.limit(0)).count() == 0


def test_xmp_fields(spark):
    packet = (
        "<dc:title><rdf:Alt><rdf:li xml:lang='x'>On A &amp; B</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>Ann  Lee</rdf:li>\n<rdf:li>Bo <b>Ek</b></rdf:li>"
        "<rdf:li> </rdf:li></rdf:Seq></dc:creator><prism:doi>10.5555/x</prism:doi><dc:identifier>doi:10.5555/y</dc:identifier><dc:identifier>none</dc:identifier>"
    )
    rows = spark.createDataFrame([(packet,), (None,), ("<dc:title>Plain</dc:title>",)], "x string").select(front.xmp_fields(F.col("x")).alias("f")).select("f.*")
    got = [(r["title"], r["authors"], r["dois"]) for r in rows.collect()]
    assert got == [("On A & B", ["Ann Lee", "Bo Ek"], ["10.5555/x", "doi:10.5555/y"]), (None, [], []), ("Plain", [], [])]
