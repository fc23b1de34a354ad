"""Arrow UDFs where no native expression has the semantics: Unicode folds and sequence similarity."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_text(text: str | None) -> str:
    """NFKD without combining marks, case folded."""
    if text and text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).casefold()


def key_text(text: str | None) -> str:
    return re.sub(r"[\W_]+", "", fold_text(text))


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text)


@F.pandas_udf(T.StringType())
def alnum_key(texts: pd.Series) -> pd.Series:
    return texts.map(key_text)


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio of two titles by letters and digits; 0 if either is empty."""
    x, y = key_text(a), key_text(b)
    return SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0


def ratio_reaches(x: str, y: str, least: float) -> bool:
    """Whether the ratio of two keys (``key_text``) is at least ``least``; most pairs are told by equality, lengths or letters, which bound it."""
    if not x or not y:
        return least <= 0.0
    if x == y:
        return least <= 1.0
    if 2.0 * min(len(x), len(y)) / (len(x) + len(y)) < least:
        return False
    if 2.0 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)) < least:
        return False
    return SequenceMatcher(None, x, y, autojunk=False).ratio() >= least


def agreeing_sources(sources: Sequence[str], values: Sequence[str], least: float) -> list[list[str] | None]:
    """For each value the sources of the values that are like it: all of its own source, and those whose ``similarity`` to it is at least ``least``.

    A value that one source gives several times is answered at its first place, as often as it is given; its other places are null.
    """
    keys, told = {v: key_text(v) for v in values}, list(zip(sources, values, strict=True))
    given, alike, out = Counter(told), {}, []
    for source, value in told:
        times = given.pop((source, value), 0)
        if times and value not in alike:
            alike[value] = {v for v in keys if ratio_reaches(keys[value], keys[v], least)}
        out.append([s for s, v in told if s == source or v in alike[value]] * times if times else None)
    return out


def agreeing(least: float):
    """``agreeing_sources`` as an Arrow UDF of two arrays; null where they are."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def told(sources: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else agreeing_sources(list(s), list(v), least) for s, v in zip(sources, values, strict=True)], dtype=object)

    return told


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)
