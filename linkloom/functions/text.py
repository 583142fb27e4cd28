"""Spelling in ASCII and other expressions over string columns; all but other scripts' letters stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .rules import literal_map


@lru_cache(1)
def _latin() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    found = [(chr(c), base) for c in range(0xC0, 0x250) if len(base := unicodedata.normalize("NFKD", chr(c))[0]) == 1 and base.isascii() and base.isalpha()]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def _spell(text: str) -> str:
    """Letters of other scripts by their Unicode names: DEVANAGARI LETTER KA is ka; a vowel sign replaces the a."""
    out = ""
    for c in unicodedata.normalize("NFKC", text):
        name = unicodedata.name(c, "")
        if c.isascii():
            out += c
        elif "VOWEL SIGN" in name or "VIRAMA" in name:
            out = out.removesuffix("a") + ("" if "VIRAMA" in name else name.rsplit(" ", 1)[1].lower())
        elif "ANUSVARA" in name:
            out += "n"
        elif "LETTER" in name:
            out += name.split("LETTER ", 1)[1].split(" ", 1)[0].lower()
        elif "DIGIT" in name:
            out += str(unicodedata.digit(c, ""))
    return out


@lru_cache(1)
def _spell_udf():
    @F.pandas_udf("string")
    def spell(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _spell(x))

    return spell


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def transliterate(c: Column, dictionary: dict[str, str] | None = None, other_scripts: bool = True) -> Column:
    """ASCII spelling. Words of a small `dictionary` first (it becomes part of the plan; operators.normalize joins large
    ones), then accented Latin letters, then (a pandas UDF, only where letters are left) other scripts."""
    out = c
    if dictionary:
        m = literal_map(dictionary)
        out = F.array_join(F.transform(F.split(F.trim(F.regexp_replace(out, r"\s+", " ")), " "), lambda w: F.coalesce(F.try_element_at(m, w), w)), " ")
    out = F.translate(reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), T.LATIN_SPECIAL.items(), out), *_latin())
    if other_scripts:
        out = F.when(is_ascii(out), out).otherwise(_spell_udf()(F.when(~is_ascii(out), out)))
    return F.when(is_ascii(c), c).otherwise(out)


def chosen(c: Column, words: tuple[str, ...], inside: bool = True) -> Column:
    """The words of a text that are (or are not) among some."""
    s = F.array(*map(F.lit, words))
    return F.array_join(F.filter(F.split(c, " "), lambda t: (t != "") & (F.array_contains(s, t) if inside else ~F.array_contains(s, t))), " ")


def web_domain(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, T.WEB, 1), F.lit(""))
