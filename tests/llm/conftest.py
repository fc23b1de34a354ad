from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, id string"
BASE = "the quick brown fox jumps over the lazy dog while seven other animals look on from behind the old garden wall near the river"
NEAR = BASE.replace("lazy", "sleepy")


def rows_of(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}", None if t is None else len(t), "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeats, ties and clashing column names."""
    texts = [BASE, BASE, BASE.upper(), NEAR, "", None, "   \n\t ", "word", "word", "123 456 !!", "long words " * 20_000, "é ü ß 日本語 😀", "a\nb\na\n\nc"]
    rows = rows_of(texts)
    rows += [rows[0], (None, BASE, None, None, None, None, None), (None, None, None, None, None, None, None), (99, "x", None, "s0", 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus_dir(spark, tmp_path_factory):
    """A small documents table with copies, near copies, shared lines and odd rows."""
    import random

    rng = random.Random(7)
    words = {lang: ["".join(rng.choice(s) for _ in range(rng.randint(2, 7))) for _ in range(300)] for lang, s in {"en": "etaoinshr", "de": "enirstuüß", "fr": "esaitnéèç"}.items()}
    rows, texts = [], []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        if i % 10 == 7 and i > 20:
            text = texts[i - 3 * rng.randint(1, 5)]
            text = text if i % 20 == 7 else text.replace(text.split()[5], "changed", 1)
        else:
            # frequent and rare words, as in any language
            text = "\n".join(" ".join(rng.choices(words[lang], [1 / (r + 1) for r in range(300)], k=rng.randint(8, 30))) for _ in range(rng.randint(2, 6)))
            if i % 4 == 0:
                text += "\nread more about our cookies here"
        texts.append(text)
        rows.append((i, text, lang, f"s{i % 5}", len(text), None, None))
    rows += [(900, None, None, None, None, None, None), (901, "", "en", "s1", 0, None, None), (902, "12 34", "en", "s1", 5, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path
