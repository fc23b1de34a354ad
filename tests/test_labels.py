from __future__ import annotations

from pyspark.sql import functions as F

from doclake.functions import labels


def test_provenance_sentences(spark):
    rows = [
        (1, "user", "manual", "assigned", True, "Accepted by you, from stated by a person (stated by a person). Locked: no resolver may change it."),
        (2, "rule:safe", "crossref", "resolved", False, "Accepted by a batch rule, from Crossref (a record for the DOI) (returned by a provider)."),
        (3, None, "new_source", None, None, "Accepted by unknown, from new_source ()."),
        (4, "Ann", "filename_hint", "inferred", False, "Accepted by Ann, from the file name (deduced from other values)."),
    ]
    df = spark.createDataFrame(rows, "i int, b string, s string, o string, l boolean, want string")
    got = df.select("want", labels.provenance_sentence(F.col("b"), F.col("s"), F.col("o"), F.col("l")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got) and len(got) == 4


def test_unknown_names_show_as_themselves(spark):
    row = spark.range(1).select(labels.label(labels.FIELDS, F.lit("doi")), labels.label(labels.FIELDS, F.lit("shelf")), labels.label(labels.BADGES, F.lit("observed"))).first()
    assert tuple(row) == ("DOI", "shelf", "O")
