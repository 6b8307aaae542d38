"""Transliteration to ASCII from Unicode data alone.

Latin letters lose their marks; letters of Indic scripts are read from their character names (a consonant
carries an a unless a vowel sign or a virama follows); other characters are read from their names where
those end in a letter, else dropped. Only rows with non-ASCII text reach Python.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INDIC = re.compile(r"^(?:DEVANAGARI|BENGALI|GURMUKHI|GUJARATI|ORIYA|TAMIL|TELUGU|KANNADA|MALAYALAM|SINHALA) (LETTER|VOWEL SIGN|SIGN|DIGIT) (.+)$")
# Letters that do not decompose into a base letter and marks.
_SPECIAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "þ": "th", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}
_DIGITS = {n: str(i) for i, n in enumerate("ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE".split())}


@lru_cache(maxsize=65_536)
def _one(ch: str) -> tuple[str, str]:
    """(text, kind) of a character; kind is consonant, vowel sign, virama or other."""
    if ch < "\x80":
        return ch, "other"
    if ch in _SPECIAL:
        return _SPECIAL[ch], "other"
    base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
    if base and all(c < "\x80" for c in base):
        return base, "other"
    name = unicodedata.name(ch, "")
    if m := _INDIC.match(name):
        kind, word = m[1], m[2].split()[0].lower()
        if kind == "DIGIT":
            return _DIGITS.get(m[2], ""), "other"
        if kind == "SIGN":
            return {"virama": ("", "virama"), "anusvara": ("m", "other"), "candrabindu": ("n", "other"), "visarga": ("h", "other")}.get(word, ("", "other"))
        word = {"aa": "a", "ii": "i", "uu": "u", "ee": "e", "oo": "o"}.get(word, word)
        if kind == "VOWEL SIGN":
            return word, "vowel sign"
        return (word[:-1], "consonant") if len(word) > 1 and word.endswith("a") and word[0] not in "aeiou" else (word, "other")
    tail = name.rsplit(" LETTER ", 1)[-1].split()[-1].lower() if " LETTER " in name else ""
    return (tail if tail.isascii() and tail.isalpha() else ""), "other"


def to_ascii(text: str) -> str:
    if text.isascii():
        return text
    out, open_ = [], False
    for ch in text:
        got, kind = _one(ch)
        if open_ and kind not in ("vowel sign", "virama") and ch.isalpha():
            out.append("a")
        # A word's last consonant is read without its a.
        open_ = kind == "consonant"
        out.append(got)
    return "".join(out)


@F.pandas_udf(T.StringType())
def _ascii_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else to_ascii(v))


def ascii_text(c: Column) -> Column:
    """ASCII text of a column; rows that are ASCII already do not change."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _ascii_udf(c)).otherwise(c)
