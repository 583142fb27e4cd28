"""Preference pairs: the common beginning of two conversations once, and two completions with a loss mask each.

A pair is a chosen and a rejected conversation. The turns that both begin with (equal role and text) are rendered once,
as the prompt; the rest of each is a completion, whose mask has one character for each of its characters: 1 where an
assistant turn's text and end mark stand, else 0.

Defined cases: turns are ordered by turn number (null first), then role, then text, so repeated turn numbers have a
fixed order; a null role is 'unknown', a null text empty; turns without a conversation id are ignored; a conversation
without a partner gives no row; equal conversations give empty completions; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    head = lambda t: F.repeat(F.lit("0"), F.length(t["role"]) + len(OPEN) + len(CLOSE))
    body = lambda t: F.repeat(F.when(t["role"] == TRAINED, "1").otherwise("0"), F.length(t["text"]) + len(END))
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t))), "")


def preferences(turns: DataFrame, pair: Column, chosen: Column, conv_col: str = "conv_id") -> DataFrame:
    """turns has conv_col, turn, role, text; pair and chosen say of a turn's conversation which pair it is in, and on which side.

    One shuffle, by pair: a row of the result holds both conversations in any case."""
    t = turns.select(pair.alias("pair_id"), chosen.alias("side"), F.col(conv_col).alias("conv"), F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    t = t.where("pair_id is not null and conv is not null and side is not null")
    side = lambda on: F.sort_array(F.collect_list(F.when(F.col("side") == on, F.col("t"))))
    p = t.groupBy("pair_id").agg(F.min(F.when(F.col("side"), F.col("conv"))).alias("chosen_id"), F.min(F.when(~F.col("side"), F.col("conv"))).alias("rejected_id"), side(True).alias("c"), side(False).alias("r"))
    p = p.where("size(c) > 0 and size(r) > 0")
    p = p.withColumn("least", F.least(F.size("c"), F.size("r")))
    p = p.withColumn("same", F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.col("least")), lambda i: (i < F.col("least")) & ((F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"])))), F.col("least")))
    cut = lambda x: F.slice(x, F.col("same") + 1, F.size(x))
    p = p.select("pair_id", "chosen_id", "rejected_id", F.col("same").cast("long").alias("n_prompt_turns"), F.slice("c", F.lit(1), F.col("same")).alias("p"), cut("c").alias("c"), cut("r").alias("r"))
    return p.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _render(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))


ORACLE = """
with t as (select conv_id // 2 as pair_id, conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as size from t),
c as (select * from n where conv_id % 2 = 0), r as (select * from n where conv_id % 2 = 1),
duo as (select a.pair_id, a.conv_id as chosen_id, b.conv_id as rejected_id, a.size as cs, b.size as rs from (select distinct pair_id, conv_id, size from c) a join (select distinct pair_id, conv_id, size from r) b using (pair_id)),
diff as (select pair_id, min(i) - 1 as same from c join r using (pair_id, i) where c.role <> r.role or c.text <> r.text group by pair_id),
p as (select duo.*, coalesce(same, least(cs, rs)) as same from duo left join diff using (pair_id)),
x as (select pair_id, conv_id, i, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as s,
  repeat('0', length(role) + 5) || repeat(case when role = 'assistant' then '1' else '0' end, length(text) + 8) as m from n)
select pair_id, chosen_id, rejected_id, cast(same as bigint) as n_prompt_turns,
  coalesce((select string_agg(s, '' order by i) from x where conv_id = chosen_id and i <= same), '') as prompt,
  coalesce((select string_agg(s, '' order by i) from x where conv_id = chosen_id and i > same), '') as chosen,
  coalesce((select string_agg(m, '' order by i) from x where conv_id = chosen_id and i > same), '') as chosen_mask,
  coalesce((select string_agg(s, '' order by i) from x where conv_id = rejected_id and i > same), '') as rejected,
  coalesce((select string_agg(m, '' order by i) from x where conv_id = rejected_id and i > same), '') as rejected_mask
from p"""
