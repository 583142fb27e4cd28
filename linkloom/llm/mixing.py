"""Sampling a mixture whose token shares meet source, language and topic targets at once.

The tokens (words) of every cell (source, language, topic) are raked by iterative proportional fitting: a document of a
cell is kept with probability min(1, a product of one factor for each dimension), and each sweep scales the factors of
one dimension after the other so that its values get their target shares.

A target is a share given by value, or else tempered: a value with T tokens gets a share in proportion to T ** tau, but
never more than ROOM of its T, and what it cannot give is spread over the others by the same rule. So a value with few
tokens gives nearly all of them and does not shrink the sample, which has `keep` of all tokens. Given shares are kept as
they are (values without one get none; shares of values that don't occur are spread over the others), and the sample is as
small as they ask for: at most ROOM of the size at which a value would be used up.

Sweeps go on until every value's expected share is within TOLERANCE of its target (relative). Where cells are exhausted before, a smaller sample is tried. Where targets contradict
one another (a source with one language, say, and other shares for the two), no sample meets them all: sweeps stop when
they no longer help, and a warning says by how much the nearest sample found misses. `shares` tells target and achieved
share by value.

Counting is one pass over the texts, in its own rows; only cells are raked, after aggregation. Up to ONE_TASK cells lie
in one partition, where windows need no exchange; above that, every sum by value is an aggregation and a join.

Topics are a column of the documents, or any expression (`dims`); without one, `form` tells four forms of text apart by
fixed marks, which is no model of what a text is about.

Defined cases: null source, language or topic is the value ''; a null or empty text has no tokens: its probability is
its cell's, and 0 in a cell without tokens; very long texts are counted whole, in their row; a null id is drawn like the
id -1; ids that are no integers are drawn by their spelling; rows with equal ids (ties and repeated rows) are kept or
dropped together if they share a cell; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

KEEP = 0.8
TAU = {"source": 0.7, "lang": 0.85, "topic": 0.85}
#: Share of its tokens that a value gives at most; nearer to all of them, sweeps converge slowly.
ROOM = 0.95
TOLERANCE = 0.005
#: Sweeps before the first look at the shares, between two looks (which write the cells and so bound a plan), and at most.
SWEEPS, SWEEPS_A_PLAN, MOST_SWEEPS = 16, 4, 64
#: Sizes tried, each four fifths of the one before.
ATTEMPTS = 4
#: Cells that one task rakes.
ONE_TASK = 100_000


def form(text: Column) -> Column:
    """The form of a text by fixed marks, the first that holds: tables, licences, contacts, else prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.contains("License") | t.contains("Copyright"), "licence").when(t.contains("@"), "contact").otherwise("prose")


def draw(id_col: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("-1"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _summed(c: DataFrame, d: str, name: str, what: Column, one: bool) -> DataFrame:
    """c with the sum of `what` over each value of d."""
    if one:
        return c.withColumn(name, F.sum(what).over(Window.partitionBy(d)))
    per, _ = common.lookup(common.materialise(c.groupBy(d).agg(F.sum(what).alias(name)), "per"))
    return common.materialise(c.join(per, d), "summed")


def _aimed(cells: DataFrame, dims: list[str], tau: dict, targets: dict | None, keep: float) -> tuple[DataFrame, float, float]:
    """cells with t_<dim>, the target share of the cell's value; all tokens; the tokens to sample."""
    every = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    total, values = keep * every, {}
    for d in dims:
        if targets and d in targets:
            table = F.create_map(*[x for k, v in sorted(targets[d].items()) for x in (F.lit(k), F.lit(float(v)))])
            mass = F.coalesce(F.try_element_at(table, F.col(d)), F.lit(0.0))
        else:
            mass = F.pow(F.col("a"), F.lit(tau[d]))
        v = values[d] = common.materialise(cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("a")).withColumn("m", mass), "values")
        if targets and d in targets:
            every_m = v.agg(F.sum("m")).first()[0] or 0.0
            total = min(total, ROOM * (v.where("m > 0").agg(F.min(F.col("a") / F.col("m"))).first()[0] or 0.0) * every_m)
    for d, v in values.items():
        full, rest, factor = 0.0, v.agg(F.sum("m")).first()[0] or 0.0, -1.0
        while (total - ROOM * full) / (rest or 1.0) != factor and rest > 0:
            factor = (total - ROOM * full) / rest
            is_full = F.lit(factor) * F.col("m") >= F.lit(ROOM) * F.col("a")
            full, rest = (x or 0.0 for x in v.agg(F.sum(F.when(is_full, F.col("a"))), F.sum(F.when(~is_full, F.col("m")))).first())
        share = F.least(F.lit(ROOM) * F.col("a"), F.lit(factor) * F.col("m")) / F.lit(total or 1.0)
        per, _ = common.lookup(common.materialise(v.select(d, share.alias(f"t_{d}")), "aims"))
        cells = cells.join(per, d)
    return cells.select(*dims, "tokens", *[f"t_{d}" for d in dims]), every, total


def rake(cells: DataFrame, dims: list[str], tau: dict, keep: float, targets: dict | None = None, tolerance: float = TOLERANCE, one_task: int = ONE_TASK) -> DataFrame:
    """cells (dims, tokens; each once) with t_<dim>, the target shares, and p, the probability of the cell's documents."""
    cells = common.materialise(cells, "cells")
    one = cells.count() <= one_task
    aimed, every, total = _aimed(cells, dims, tau, targets, keep)
    aimed = common.materialise(aimed, "shares")
    got = lambda: F.col("tokens") * F.least(F.lit(1.0), F.col("f"))
    for attempt in range(1, ATTEMPTS + 1):
        c, before = aimed.withColumn("f", F.lit(total / every if every else 0.0)), math.inf
        for sweep in range(1, MOST_SWEEPS + 1):
            c = c.coalesce(1) if one else c
            for d in dims:
                c = _summed(c, d, "__got", got(), one)
                c = c.withColumn("f", F.when(F.col("__got") > 0, F.col("f") * (F.lit(total) * F.col(f"t_{d}") / F.col("__got"))).otherwise(0.0)).drop("__got")
            if sweep % SWEEPS_A_PLAN:
                continue
            c = common.materialise(c, f"sweep{sweep}")
            if sweep >= SWEEPS:
                now = _error(c.withColumn("p", F.least(F.lit(1.0), "f")), dims, total, one)
                if now <= tolerance or now > 0.8 * before:
                    break
                before = now
        # Only where cells are exhausted does a smaller sample come nearer to the targets.
        if now <= tolerance or attempt == ATTEMPTS or c.where("f > 1").isEmpty():
            break
        total *= 0.8
    if now > tolerance:
        warnings.warn(f"no sample of these cells meets all targets; the nearest found misses one by {now:.1%}", stacklevel=2)
    return c.select(*dims, "tokens", *[f"t_{d}" for d in dims], F.least(F.lit(1.0), "f").alias("p"))


def _error(raked: DataFrame, dims: list[str], total: float, one: bool) -> float:
    """The largest relative distance of a value's expected tokens from its target."""
    worst = 0.0
    for d in dims:
        per = (raked.coalesce(1) if one else raked).groupBy(d).agg(F.sum(F.col("tokens") * F.col("p")).alias("w"), F.first(f"t_{d}").alias("t"))
        e = per.where("t > 0").agg(F.max(F.abs(F.col("w") / (F.col("t") * F.lit(total)) - 1))).first()[0]
        worst = max(worst, e or 0.0)
    return worst


def shares(raked: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, value, target, got): target and expected share of each value in the sample."""
    every = raked.agg(F.sum(F.col("tokens") * F.col("p"))).first()[0] or 0.0
    out = None
    for d in dims:
        one = raked.groupBy(F.col(d).alias("value")).agg(F.first(f"t_{d}").alias("target"), F.sum(F.col("tokens") * F.col("p")).alias("w"))
        one = one.select(F.lit(d).alias("dim"), "value", "target", F.when(F.lit(every) > 0, F.col("w") / F.lit(every or 1.0)).otherwise(0.0).alias("got"))
        out = one if out is None else out.unionByName(one)
    return out


def _dims(docs: DataFrame, dims: dict | None, text_col: str) -> list[Column]:
    topic = F.col("topic") if "topic" in docs.columns else form(F.col(text_col))
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    return [F.coalesce(v.cast("string"), F.lit("")).alias(k) for k, v in dims.items()]


def _cells(rows: DataFrame, dims: list[str]) -> DataFrame:
    return rows.groupBy(*dims).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))


def n_tokens(text: Column) -> Column:
    return F.size(common.words(text)).cast("long").alias("n_tokens")


def _odds(cells: DataFrame, dims: list[str], tau: dict, keep: float, targets: dict | None) -> DataFrame:
    """(dims, p) with p rounded to six digits, broadcast if it is small."""
    p = rake(cells, dims, tau, keep, targets).select(*dims, F.round("p", 6).alias("p"))
    return common.lookup(common.materialise(p, "odds"))[0]


def probabilities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: dict | None = None, tau: dict = TAU,
                  keep: float = KEEP, targets: dict | None = None) -> DataFrame:
    """One row per row of docs: __id, __th, the dims, n_tokens, p, sampled. dims: name -> Column, source, lang and topic if None."""
    names = list(dims or TAU)
    rows = common.materialise(docs.select(*common.row_key(docs, id_col, text_col), *_dims(docs, dims, text_col), n_tokens(F.col(text_col))), "rows")
    out = rows.join(_odds(_cells(rows, names), names, tau, keep, targets), names)
    return out.select("__id", "__th", *names, "n_tokens", "p", (draw(F.col("__id")) < F.col("p")).alias("sampled"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: dict | None = None, tau: dict = TAU,
           keep: float = KEEP, targets: dict | None = None) -> DataFrame:
    """The rows of docs that are drawn, with all their columns: a pass that counts, and one that filters; no text is
    shuffled where the cells are few enough to be broadcast."""
    names, cols = list(dims or TAU), _dims(docs, dims, text_col)
    odds = _odds(_cells(docs.select(*cols, n_tokens(F.col(text_col))), names), names, tau, keep, targets)
    rows = common.whole_rows(docs, *cols, draw(F.col(id_col)).alias("__draw"))
    return rows.join(odds, names).where(F.col("__draw") < F.col("p")).select("__row.*")


def oracle(tau: dict = TAU, keep: float = KEEP, sweeps: int = SWEEPS, rounds: int = 8, docs: str = "documents") -> str:
    """The same as DuckDB SQL, for tables on which the first look finds the shares within the tolerance. rounds: those in
    which values turn out to be used up."""
    dims = list(TAU)
    made, last = [], "c0"
    for k in range(sweeps):
        for d in dims:
            got = f"sum(tokens * least(1.0, f)) over (partition by {d})"
            made.append(f"s{k}{d} as materialized (select * replace (case when {got} > 0 then f * (total * t_{d} / {got}) else 0 end as f) from {last})")
            last = f"s{k}{d}"
    aims = []
    for d in dims:
        aims.append(f"v_{d} as materialized (select {d}, a, pow(a, {tau[d]}) as m from (select {d}, cast(sum(tokens) as double) as a from c group by all))")
        aims.append(f"l_{d}0 as materialized (select total / (select sum(m) from v_{d}) as l from tot)")
        for k in range(rounds):
            full = f"(select l from l_{d}{k}) * m >= {ROOM} * a"
            aims.append(f"l_{d}{k + 1} as materialized (select (total - {ROOM} * coalesce((select sum(a) from v_{d} where {full}), 0)) / (select sum(m) from v_{d} where not {full}) as l from tot)")
        aims.append(f"t_{d} as materialized (select {d}, least({ROOM} * a, (select l from l_{d}{rounds}) * m) / (select total from tot) as t_{d} from v_{d})")
    joins = " ".join(f"join t_{d} using ({d})" for d in dims)
    return rf"""
with r as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang,
  case when contains(coalesce(text, ''), ' | ') then 'table' when contains(text, 'License') or contains(text, 'Copyright') then 'licence' when contains(text, '@') then 'contact' else 'prose' end as topic,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens from {docs}),
c as (select source, lang, topic, cast(sum(n_tokens) as bigint) as tokens from r group by all),
tot as materialized (select cast({keep} as double) * sum(tokens) as total from c),
{", ".join(aims)},
c0 as materialized (select source, lang, topic, tokens, {", ".join(f"t_{d}" for d in dims)}, total, total / (select sum(tokens) from c) as f from c {joins}, tot),
{", ".join(made)},
p as (select r.*, round(least(1.0, f), 6) as p from r join {last} using (source, lang, topic))
select doc_id, source, lang, topic, n_tokens, p, cast('0x' || md5(cast(coalesce(doc_id, -1) as varchar))[1:12] as bigint) / 281474976710656.0 < p as sampled from p"""
