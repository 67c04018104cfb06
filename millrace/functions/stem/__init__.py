"""Stemmers after the published Snowball descriptions, and ``stem`` as a Column function and a table operator.

A word is stemmed as it is (lower-case it first).  An unknown language is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.batches import in_slices
from millrace.functions.stem import english as _en, germanic as _ge, others as _ot, romance as _ro, turkish as _tr

#: Name, and the codes that stand for it (fixed values).
LANGUAGES = {
    "danish": "da dan", "dutch": "nl dut nld", "english": "en eng", "finnish": "fi fin", "french": "fr fre fra", "german": "de ger deu", "hungarian": "hu hun", "italian": "it ita",
    "norwegian": "no nor", "porter": "", "portuguese": "pt por", "romanian": "ro rum ron", "russian": "ru rus", "spanish": "es esl spa", "swedish": "sv swe", "turkish": "tr tur",
}
_STEMMERS: dict[str, Callable[[str], str]] = {
    "danish": _ge.danish, "dutch": _ge.dutch, "english": _en.english, "finnish": _ot.finnish, "french": _ro.french, "german": _ge.german, "hungarian": _ot.hungarian, "italian": _ro.italian,
    "norwegian": _ge.norwegian, "porter": _en.porter, "portuguese": _ro.portuguese, "romanian": _ro.romanian, "russian": _ot.russian, "spanish": _ro.spanish, "swedish": _ge.swedish, "turkish": _tr.turkish,
}
_NAMES = {a: name for name, codes in LANGUAGES.items() for a in (name, *codes.split())}


def algorithms() -> list[str]:
    return sorted(_STEMMERS)


def stemmer(language: str) -> Callable[[str], str]:
    """The stemmer by name or code, exact and case-sensitive."""
    if language not in _NAMES:
        raise ValueError(f"unknown language {language}")
    return _STEMMERS[_NAMES[language]]


@lru_cache(maxsize=1 << 18)  # rare words would drive out the others: 2^16 missed 1.8 times as often
def stem_word(word: str, language: str) -> str:
    return stemmer(language)(word)


def stem(word: Column, language: str) -> Column:
    """The stems of a column; null stays null."""
    stemmer(language)  # an unknown one fails here

    @F.pandas_udf(T.StringType())
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: stem_word(w, language), na_action="ignore")

    return run(word)


@F.pandas_udf(T.StringType())
def _stem_each(words: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([w if w is None or k not in _NAMES else stem_word(w, k) for w, k in zip(words, languages)], dtype=object)


def stemmed(rows: DataFrame, word: str = "term", language: str = "lang", to: str = "stem") -> DataFrame:
    """``rows`` with the stem of each word; languages without a stemmer leave it as it is.

    Words are stemmed once each: distinct words go to Python and come back by a join, whose hot
    words adaptive execution splits.
    """
    once = rows.select(F.col(word).alias("__w"), F.col(language).alias("__l")).where("__w is not null").distinct()
    once = once.withColumn(to, _stem_each("__w", "__l"))
    same = F.col(word).eqNullSafe(F.col("__w")) & F.col(language).eqNullSafe(F.col("__l"))
    return rows.join(once, same, "left").drop("__w", "__l")


def stem_counts(rows: DataFrame) -> DataFrame:
    """(lang, stem, df) of ``rows(lang, words)``, arrays of different words: how many rows have the stem.

    A slice of rows is counted where it is, so counts shuffle and not words; a (lang, stem) comes
    once for each slice that has it and is to be summed.
    """

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for lang, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            known = lang in _NAMES
            counts.update({(lang, stem_word(w, lang) if known else w) for w in words or ()})
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "stem", "df"]
        )

    return rows.select("lang", "words").mapInArrow(in_slices(make), "lang string, stem string, df long")
