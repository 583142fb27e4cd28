"""Cleaning as data: a text is cleaned by a list of steps, which one interpreter turns into columns and another into SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


@dataclass(frozen=True)
class Sub:
    """Every match of a pattern is replaced; $1 and so on stand for groups."""

    pattern: str
    by: str


@dataclass(frozen=True)
class Squeeze:
    """A run of one of these letters becomes the letter."""

    letters: str


@dataclass(frozen=True)
class Trim:
    """Spaces at both ends go."""


@dataclass(frozen=True)
class Words:
    """Words are replaced by what a table has for them; empty ones go."""

    table: str


@dataclass(frozen=True)
class Parts:
    """What fills a whole part between commas is replaced by its code."""

    table: str


TABLES = {"name": T.NAME_MAP, "address": T.ADDR_MAP, "region": T.REGIONS}
ONE_SPACE = (Sub(r"\s+", " "), Trim())
QUOTES = Sub("['’`]", "")
#: A digit between letters stands for a letter (neighbouring matches overlap, so twice), and so does one at a word's end.
DIGITS = tuple(Sub(p, by) for d, x in T.DIGIT_LETTERS.items() for p, by in ((f"([a-z]){d}([a-z])", f"$1{x}$2"),) * 2 + ((rf"([a-z]{{2}}){d}\b", f"$1{x}"),))
NAME = (Sub(r"\bm/s\b", " m/s "), QUOTES, Sub("&", " & "), *DIGITS, Sub("[^a-z0-9&/ ]", " "), Sub("/", " "), Sub(r"\bm s\b", "m/s"), *ONE_SPACE, Words("name"))
#: How a name sounds: 'kwik phix' and 'quiik fiks' are both 'kvk fks'.
SOUND = (Sub("ph", "f"), Sub("x", "ks"), Sub("w", "v"), Sub("[cq]", "k"), Sub("z", "j"), Sub("[aeiouhy]", ""), Squeeze("bdfgjklmnprstv"), *ONE_SPACE)
ADDRESS = (Sub(r"\bn\s*deg\b|\bdeg\b|#", " "), Sub(r"\bno\.", " no "), QUOTES, *ONE_SPACE, Parts("region"), Sub("[^a-z0-9 ]", " "), *ONE_SPACE, Words("address"))


def part_pattern(table: str) -> str:
    return r"(^|,)\s*(" + "|".join(sorted(TABLES[table], key=lambda n: (-len(n), n))) + r")\s*(,|$)"


def literal_map(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])


def map_words(c: Column, words: dict[str, str]) -> Column:
    """Whole words replaced, empty ones dropped."""
    m = literal_map(words)
    return F.array_join(F.filter(F.transform(F.split(c, " "), lambda t: F.coalesce(F.try_element_at(m, t), t)), lambda t: t != ""), " ")


def _coded(c: Column, table: str) -> Column:
    # Neighbouring parts share a comma, so two passes mark them all.
    marked = F.regexp_replace(F.regexp_replace(c, part_pattern(table), "$1 <<$2>> $3"), part_pattern(table), "$1 <<$2>> $3")
    codes = literal_map(TABLES[table])
    of = F.transform(F.split(marked, "<<|>>"), lambda p, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(codes, p), p)).otherwise(p))
    return F.when(marked.contains("<<"), F.array_join(of, "")).otherwise(c)


def apply(c: Column, steps: tuple) -> Column:
    """The column after all steps."""
    for s in steps:
        match s:
            case Sub(pattern, by):
                c = F.regexp_replace(c, pattern, by)
            case Squeeze(letters):
                c = F.regexp_replace(c, rf"([{letters}])\1+", "$1")
            case Trim():
                c = F.trim(c)
            case Words(table):
                c = map_words(c, TABLES[table])
            case Parts(table):
                c = _coded(c, table)
    return c


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(e: str, pattern: str, by: str) -> str:
    return f"regexp_replace({e}, {_quoted(pattern)}, {_quoted(by.replace('$', chr(92)))}, 'g')"


def sql(e: str, steps: tuple) -> str:
    """The same as DuckDB SQL."""
    for s in steps:
        match s:
            case Sub(pattern, by):
                e = _replaced(e, pattern, by)
            case Squeeze(letters):
                for x in letters:
                    e = _replaced(e, f"{x}+", x)
            case Trim():
                e = f"trim({e})"
            case Words(table):
                cases = " ".join(f"when {_quoted(a)} then {_quoted(b)}" for a, b in TABLES[table].items())
                e = f"array_to_string(list_filter(list_transform(string_split({e}, ' '), lambda t: case t {cases} else t end), lambda t: t <> ''), ' ')"
            case Parts(table):
                for _ in range(2):
                    e = _replaced(e, part_pattern(table), "$1 <<$2>> $3")
                for name, code in TABLES[table].items():
                    e = f"replace({e}, '<<{name}>>', '{code}')"
    return e
