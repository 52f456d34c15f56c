"""Problem 5: one consistent form for text that looks the same but differs in its characters.

Method: compatibility normalisation (NFKC, composed), mapped white space, removal of default-ignorable characters,
look-alike letters folded inside mixed-script words, full case folding for the comparison key. The work is done once
per distinct value of an Arrow batch, and only on values that a JVM-side regular expression cannot clear.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Greek and Cyrillic letters that are drawn like a Latin letter.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c",
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ԁ": "d",
}

#: Character classes of the kinds of change, written so that Java and Python read them alike.
FULLWIDTH = r"０-９Ａ-Ｚａ-ｚ"
LIGATURE = r"ĲĳǄ-ǌǱ-ǳﬀ-ﬆﬓ-ﬗ"
SPACE = r"   -     　"
INVISIBLE = r"­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￻"
GREEK_CYRILLIC = r"Ͱ-Ͽἀ-῿Ѐ-ԯⷠ-ⷿꙀ-ꚟ"
#: A superset of all cases that the JVM can test without Python.
SUSPECT = f"[{FULLWIDTH}{LIGATURE}{SPACE}{INVISIBLE}{GREEK_CYRILLIC}]|\\p{{M}}|\\p{{Cf}}"

KINDS = ("full_width", "ligature", "combining_mark", "invisible", "space", "mixed_script")
_FULLWIDTH, _LIGATURE, _SPACE = (re.compile(f"[{x}]") for x in (FULLWIDTH, LIGATURE, SPACE))
_GREEK_CYRILLIC = re.compile(f"[{GREEK_CYRILLIC}]")
_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"[^\S\n\r\t]+")


def _invisible(char: str) -> bool:
    return unicodedata.category(char) == "Cf" or bool(_INVISIBLE.match(char))


_INVISIBLE = re.compile(f"[{INVISIBLE}]")


def _latin(char: str) -> bool:
    return char.isascii() and char.isalpha() or not char.isascii() and unicodedata.name(char, "").startswith(("LATIN ", "FULLWIDTH LATIN "))


def _greek_or_cyrillic(char: str) -> bool:
    return bool(_GREEK_CYRILLIC.match(char)) and unicodedata.category(char)[0] == "L"


def _mixed_words(text: str) -> list[re.Match]:
    return [m for m in _WORD.finditer(text) if _GREEK_CYRILLIC.search(m[0]) and any(map(_greek_or_cyrillic, m[0])) and any(map(_latin, m[0]))]


def changes(text: str) -> list[str]:
    """Kinds of characters that keep ``text`` from being in the consistent form, in the order of ``KINDS``."""
    odd = {c for c in text if not c.isascii()}
    found = [
        any(_FULLWIDTH.match(c) for c in odd),
        any(_LIGATURE.match(c) for c in odd),
        any(unicodedata.category(c)[0] == "M" and not _INVISIBLE.match(c) for c in odd),
        any(map(_invisible, odd)),
        any(_SPACE.match(c) for c in odd),
        bool(_mixed_words(text)),
    ]
    return [kind for kind, hit in zip(KINDS, found) if hit]


def consistent(text: str) -> str:
    """The composed, compatibility-normalised form; line breaks and tabs stay, other spaces become one plain space."""
    if text.isascii():
        return _BLANK.sub(" ", text)
    text = "".join(c for c in text if not _invisible(c))
    text = unicodedata.normalize("NFKC", text)
    for m in reversed(_mixed_words(text)):
        text = text[: m.start()] + "".join(LOOKALIKES.get(c, c) for c in m[0]) + text[m.end() :]
    return _BLANK.sub(" ", unicodedata.normalize("NFC", text))


def comparison_key(text: str) -> str:
    """Full case folding of the consistent form, folded again as folding can break the composed form."""
    return unicodedata.normalize("NFKC", consistent(text).casefold())


_RESULT = T.StructType([T.StructField("normalized", T.StringType()), T.StructField("match_key", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


@F.pandas_udf(_RESULT)
def _normalize_suspects(values: pd.Series) -> pd.DataFrame:
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    done = [(consistent(x), comparison_key(x), changes(x)) for x in distinct] + [(None, None, None)]
    return pd.DataFrame([done[i] for i in codes], columns=["normalized", "match_key", "kinds"])


def normalize_values(df: DataFrame, value: str | Column, *, keep: Iterable[str] = ()) -> DataFrame:
    """``keep`` columns plus ``normalized``, ``match_key`` and ``kinds`` (empty array: already consistent) of ``value``.

    Null stays null in all three columns; an empty text stays empty. Values that the JVM-side test clears never reach
    Python, yet get the same three columns (for them the key is the lower-cased text with NFKC-neutral characters).
    """
    value = F.col(value) if isinstance(value, str) else value
    base = df.select(*keep, value.alias("__value"))
    plain = F.col("__value").rlike(r"\A[\x21-\x7e \n\r\t]*\z") & ~F.col("__value").contains("  ")
    cleared = ~F.col("__value").rlike(SUSPECT) & plain
    # two branches of one union would scan twice; a conditional argument keeps one scan and hands Python only nulls instead
    given = base.withColumn("__given", F.when(~cleared, F.col("__value"))).withColumn("__r", _normalize_suspects("__given"))
    return given.select(
        *keep,
        F.col("__value").alias("value"),
        F.when(F.col("__given").isNull(), F.col("__value")).otherwise(F.col("__r.normalized")).alias("normalized"),
        F.when(F.col("__given").isNull(), F.lower("__value")).otherwise(F.col("__r.match_key")).alias("match_key"),
        F.when(F.col("__value").isNotNull(), F.coalesce(F.col("__r.kinds"), F.array().cast("array<string>"))).alias("kinds"),
    )


def text_values(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """The values of problem 5 with their place: (field, row_id, pos, value)."""
    texts = chunks.select(F.lit("chunks.text").alias("field"), F.col("chunk_id").alias("row_id"), F.lit(0).alias("pos"), F.col("text").alias("value"))
    keys = answers.select(F.lit("answers_for_ragas.answer_keys").alias("field"), F.col("answer_id").alias("row_id"), F.posexplode("answer_keys").alias("pos", "value"))
    return texts.unionByName(keys)


def inconsistent_values(values: DataFrame) -> DataFrame:
    """Changed values only, with ``normalized``, ``match_key`` and ``kinds``; the JVM test keeps the rest from Python."""
    suspects = values.where(F.col("value").rlike(SUSPECT)).withColumn("__r", _normalize_suspects("value"))
    return suspects.select("*", "__r.normalized", "__r.match_key", "__r.kinds").drop("__r").where(F.size("kinds") > 0)
