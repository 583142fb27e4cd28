"""Removal of lines that repeat an earlier line, exactly or but for a few edits, by deletion neighbourhoods.

A line of at least MIN_CHARS characters with a word in it goes if an equal line, or one at edit distance EDITS or less (a
character inserted, deleted or replaced; 1 unless `edits` says otherwise), stands earlier; lines are ordered by document id (null last) and line number. An earlier
line counts even if it goes itself. All else stays, in order.

Method. Of the distinct lines, two at distance 1 agree but for one character, so they share a variant with that
character deleted. Variants are emitted as hashed keys, from coarse to fine: first the variants that lack a third of the
line, then, of lines that share one with another line, those that lack an eighth of that third, and so on, last those
that lack one character. Every stage keeps all lines that share a key, so no pair is lost, and lines without a partner
cost six keys rather than one per character. Two lines of equal length that share (variant, place) differ at most there,
and a variant that is itself a line is at distance 1 from every line it was deleted from; so the earliest line of a key
decides and pairs within a key are never built. The edit distance to that line is verified on the texts.

That is for the bound of one edit; for a bound of `edits` above it, the same two steps are plainer. Lines are first kept if
one of the edits + 1 parts of the longer line of a pair stands in another line, shifted by up to `edits` characters. They
then emit every variant that lacks up to `edits` characters, each either replaced (its gap is part of the key) or extra;
lines that share a key with s gaps are within s plus the extras of both, so the earliest line for each number of extras
decides here, too. A line of n characters that passes the first step emits some (2n)^edits / edits! keys, so bounds
above 1 are for short lines. A bound of 0 removes only equal lines.

Equal lines are told by a 64-bit hash, and of the lines that share a variant's hashed key only the earliest is verified;
either hash can collide (README has the figures).

Defined cases: a null text stays null, an empty one empty; rows with equal id and text are one document, and so are
decided alike; rows that share an id with different texts keep their own lines, neither being earlier than the other's
line of the same number (a tie); ids that are no integers are ordered by their spelling; very long texts and lines are
handled whole; an empty table gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_CHARS = 16
EDITS = 1
PARTS, FINER = 3, 8
#: Longest segment whose single characters are deleted without further subdivision.
LEAF = 32


def _cols(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col).alias("__rk"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("\0"))).alias("__th")]


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """__rk, __th, at (order of the line), no, line, n, h for each line that may go."""
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).cast("decimal(19,0)") if whole else F.struct(F.col(id_col).isNull().alias("nil"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    d = docs.select(*_cols(docs, id_col, text_col), order.alias("__o"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    d = d.withColumn("n", F.length("line")).where((F.col("n") >= min_chars) & F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    if whole:  # one number, as its minimum is found by hashing
        at = (F.col("__o") * F.lit(10**10).cast("decimal(11,0)") + F.col("no").cast("decimal(10,0)")).cast("decimal(31,0)")
    else:
        at = F.struct(F.col("__o.nil").alias("nil"), F.col("__o.id").alias("id"), F.col("no").alias("no"))
    return d.select("__rk", "__th", at.alias("at"), "no", "line", "n", F.xxhash64("line").alias("h"))


def _part(line: str, own: str, full: str, j: str, parts: int) -> tuple[str, str, str]:
    """SQL: what stands before part j of `full` characters, what stands after it (from the right), and the length of
    the part in a line of `own` characters (full, or full - 1 if this is the shorter line of a pair)."""
    start, end = f"cast(floor({j} * ({full}) / {parts}) as int)", f"cast(floor(({j} + 1) * ({full}) / {parts}) as int)"
    return f"left({line}, {start})", f"right({line}, ({full}) - {end})", f"({own}) - ({start}) - (({full}) - {end})"


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of keys (each line once per key) whose key another line has, too."""
    return keys.join(keys.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")


def _texts(lines: DataFrame, near: DataFrame) -> DataFrame:
    """h, at, line: one line of each h of near, that at its earliest place."""
    some = common.marked(lines, "h", common.bitmap(near.select("h").distinct(), "h")).where("__maybe").select("h", "at", "line")
    # Not a semi join: the optimizer would move that below the bitmap and shuffle every line.
    return common.materialise(some.join(near.select("h", "at").distinct(), ["h", "at"]).dropDuplicates(["h", "at"]), "lines")


def _verified(seen: DataFrame, some: DataFrame, edits: int) -> DataFrame:
    """h of the rows (h, by) whose line is within the bound of that at `by`."""
    other = some.select(F.col("at").alias("by"), F.col("line").alias("earlier"))
    return seen.join(some.select("h", "line"), "h").join(other, "by").where(F.levenshtein("line", "earlier", edits) >= 0).select("h").distinct()


def _dominated(lines: DataFrame, first: DataFrame) -> DataFrame:
    """h of the distinct lines that have an earlier line at distance 1. first: h, at, keys."""
    keys = first.select("h", F.posexplode("keys").alias("x", "key"))
    near = common.materialise(_shared(keys).select("h", "x", "key").join(first.select("h", "at"), "h"), "near")
    some = _texts(lines, near)
    seg = some.join(near.select("h", "x", "key"), "h").withColumns({"full": F.expr(f"length(line) + cast(floor(x / {PARTS}) as int)"), "j": F.col("x") % PARTS})
    _, _, size = _part("line", "length(line)", "full", "j", PARTS)
    start, end = f"cast(floor(j * full / {PARTS}) as int)", f"cast(floor((j + 1) * full / {PARTS}) as int)"
    seg = seg.select("h", "at", "key", F.expr(f"{end} - {start}").alias("full"), F.expr(f"substring(line, {start} + 1, {size})").alias("seg"))
    longest = seg.agg(F.max("full")).first()[0] or 0
    for _ in range(max(0, math.ceil(math.log(max(longest, 1) / LEAF, FINER)))):
        seg = _finer(seg)
    cut = F.expr("""concat(transform(if(length(seg) = full, sequence(1, greatest(full, 1)), array()), p -> named_struct('kind', 0, 'k', xxhash64(key, p, left(seg, p - 1), substring(seg, p + 1)))),
        transform(if(length(seg) = full, array_distinct(transform(sequence(1, greatest(full, 1)), p -> concat(left(seg, p - 1), substring(seg, p + 1)))), array(seg)),
            v -> named_struct('kind', if(length(seg) = full, 1, 2), 'k', xxhash64(key, -1, v))))""")
    rows = seg.select("h", "at", F.explode(cut).alias("c")).select("h", "at", "c.kind", "c.k")
    low = rows.groupBy("k").agg(*[F.min(F.when(F.col("kind") == i, F.col("at"))).alias(f"m{i}") for i in range(3)])
    seen = rows.join(low, "k").withColumn("by", F.when(F.col("kind") == 0, F.col("m0")).when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1")))
    return _verified(seen.where("by < at").select("h", "by").distinct(), some, 1)


def _dominated_within(lines: DataFrame, first: DataFrame, edits: int) -> DataFrame:
    """h of the distinct lines that have an earlier line within a bound above 1. first: h, at, keys."""
    keys = first.select("h", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
    near = common.materialise(_shared(keys).select("h").distinct().join(first.select("h", "at"), "h"), "near")
    some = _texts(lines, near)
    # p: the next place that may be cut, from left to right, so that every choice of places is made once; 0 cuts no more.
    rows = some.select("h", "at", F.col("line").alias("v"), F.array().cast("array<int>").alias("gaps"), F.lit(0).alias("extra"), F.lit(1).alias("p"))
    for _ in range(edits):
        rows = rows.withColumn("p", F.explode(F.expr("if(p <= length(v), concat(array(0), sequence(p, length(v))), array(0))")))
        rows = rows.withColumn("add", F.explode(F.expr("if(p = 0, array(0), array(0, 1))")))
        rows = rows.select("h", "at", F.expr("if(p = 0, v, concat(left(v, p - 1), substring(v, p + 1)))").alias("v"), F.expr("if(p = 0 or add = 1, gaps, concat(gaps, array(p)))").alias("gaps"),
                           (F.col("extra") + F.col("add")).alias("extra"), F.expr("if(p = 0, length(v) + 1, p)").alias("p"))
    rows = rows.select("h", "at", "extra", F.size("gaps").alias("gone"), F.xxhash64("v", "gaps").alias("k"))
    low = rows.groupBy("k").agg(*[F.min(F.when(F.col("extra") == i, F.col("at"))).alias(f"m{i}") for i in range(edits + 1)])
    by = F.least(*[F.when(F.col("gone") + F.col("extra") + i <= edits, F.col(f"m{i}")) for i in range(edits + 1)])
    return _verified(rows.join(low, "k").withColumn("by", by).where("by < at").select("h", "by").distinct(), some, edits)


def _coarse(edits: int) -> list[Column]:
    """Hashed keys of a line; any two lines within the bound share one. For one edit, what a line keeps without a third of
    it; above, the parts of the line and what may stand for a longer line's parts."""
    if edits == 1:
        keys = []
        for x in range(2 * PARTS):
            before, after, _ = _part("line", "n", f"n + {x // PARTS}", str(x % PARTS), PARTS)
            keys.append(f"xxhash64(n + {x // PARTS}, {x % PARTS}, {before}, {after})")
        return [F.expr(k) for k in keys]
    out = []
    for j in range(edits + 1):
        for more in range(edits + 1):
            start, end = (f"cast(floor({j + i} * (n + {more}) / {edits + 1}) as int)" for i in (0, 1))
            for shift in range(-edits, edits + 1):
                key = f"xxhash64(n + {more}, {j}, substring(line, {start} + {shift} + 1, {end} - {start}))"
                out.append(F.expr(f"if({start} + {shift} >= 0 and {end} + {shift} <= n, {key}, null)"))
    return out


def _finer(seg: DataFrame) -> DataFrame:
    before, after, size = _part("seg", "length(seg)", "full", "j", FINER)
    x = seg.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(FINER - 1))))
    start, end = f"cast(floor(j * full / {FINER}) as int)", f"cast(floor((j + 1) * full / {FINER}) as int)"
    x = x.where(f"{end} > {start} and {size} >= 0")
    x = x.select("h", "at", F.expr(f"xxhash64(key, j, {before}, {after})").alias("key"), F.expr(f"{end} - {start}").alias("full"), F.expr(f"substring(seg, {start} + 1, {size})").alias("seg"))
    return common.materialise(_shared(x), "finer")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """__rk, __th, gone: for each document that loses lines, their numbers from 0."""
    if edits < 0:
        raise ValueError("edits is 0 or more")
    lines = _lines(docs, id_col, text_col, min_chars)
    keys = _coarse(edits) if edits else []
    # first(keys) would aggregate by sorting, so the keys are kept as columns.
    cols = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    first = lines.select("h", "at", *cols).groupBy("h").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("times"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(len(cols))])
    first = common.materialise(first.select("h", "at", "times", F.array(*[f"k{i}" for i in range(len(cols))]).alias("keys")), "first")
    texts = lines.select("h", "at", "line")
    gone = common.materialise(_dominated(texts, first) if edits == 1 else _dominated_within(texts, first, edits) if edits else first.select("h").where("false"), "dominated")
    # Lines that stand once and have no earlier partner stay; a bitmap keeps them out of the shuffle.
    state = first.select("h", F.col("at").alias("first"), "times").join(gone.withColumn("out", F.lit(True)), "h", "left").where("times > 1 or out")
    state = common.materialise(state.drop("times"), "state")
    some = common.marked(lines.select("h", "__rk", "__th", "at", "no"), "h", common.bitmap(state, "h")).where("__maybe").drop("__maybe")
    every = some.join(state, "h").where("at <> first or out")
    return every.groupBy("__rk", "__th").agg(F.collect_set("no").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, count_cols: bool = False, edits: int = EDITS) -> DataFrame:
    """docs with the text that is left; with count_cols also n_lines (all, before) and n_removed."""
    gone = common.materialise(removed_lines(docs, id_col, text_col, min_chars, edits), "gone")
    text = F.col(f"__row.`{text_col}`")
    d = common.marked(common.whole_rows(docs, *_cols(docs, id_col, text_col)), "__th", common.bitmap(gone, "__th"))
    # Documents that surely lose nothing are not shuffled.
    same = d.where("not __maybe").select("__row", F.lit(None).cast("array<int>").alias("gone"))
    j = d.where("__maybe").join(gone, ["__rk", "__th"], "left").select("__row", "gone").unionByName(same)
    j = j.select("__row", F.col("gone").alias("__gone"), F.split(text, "\n").alias("__ls"))
    # __ls is used twice and so is computed once, before the lambda that looks lines up in it.
    j = j.withColumn("__left", F.when(F.col("__gone").isNull(), text).otherwise(F.expr("array_join(transform(array_except(sequence(0, size(__ls) - 1), __gone), i -> get(__ls, i)), '\n')")))
    counts = [F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(n) for c, n in (("__ls", "n_lines"), ("__gone", "n_removed"))] if count_cols else []
    return j.select(*[F.col("__left").alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in docs.columns], *counts)


ORACLE = rf"""
with l as (select doc_id, no - 1 as no, ls[no] as line from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as no from documents)
  ),
c as (select *, row_number() over (order by doc_id, no) as pl from l where length(line) >= {MIN_CHARS} and regexp_matches(line, '[^\x20\x09-\x0D]')),
f as (select line, min(pl) as pl, length(line) as n from c group by line),
hk as (select line, pl, n, f.n + d as full, s, case when s = 0 then line[1:((f.n + d) // 2)] else line[f.n - ((f.n + d) - (f.n + d) // 2) + 1:] end as half from f, (values (0), (1)) t(d), (values (0), (1)) u(s)),
dom as (select distinct a.line from hk a join hk b on a.full = b.full and a.s = b.s and a.half = b.half and b.pl < a.pl and levenshtein(a.line, b.line) <= 1),
gone as (select c.doc_id, c.no from c join f using (line) where c.pl <> f.pl or c.line in (select line from dom)),
t as (select l.doc_id, string_agg(line, chr(10) order by l.no) filter (where gone.no is null) as text, count(*) as n_lines, count(gone.no) as n_removed
  from l left join gone using (doc_id, no) group by l.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(t.text, '') end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed from documents d left join t using (doc_id)"""
