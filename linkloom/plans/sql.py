"""The SQL that says what the registered queries must return: common table expressions by name."""

from __future__ import annotations

from ..functions import rules as R
from ..functions import tables as T
from ..functions.text import _latin

SPACE = r"[\x20\x09-\x0D]+"


def translit(c: str) -> str:
    e = c
    for a, b in T.LATIN_SPECIAL.items():
        e = f"replace({e}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"translate({e}, '{_latin()[0]}', '{_latin()[1]}')"


def chosen(c: str, words: tuple[str, ...], inside: bool = True) -> str:
    s = ", ".join(f"'{w}'" for w in words)
    return f"array_to_string(list_filter(string_split({c}, ' '), lambda t: t <> '' and t {'' if inside else 'not '}in ({s})), ' ')"


def clean_ctes(source: str) -> str:
    """CTE `ent`: the rows of CTE `source` (business_name, business_address and others) with the clean columns."""
    core = chosen("name_clean", T.LEGAL + T.FILLER, False)
    return f"""
e1 as materialized (select *, trim(lower({translit("business_name")})) as n0, lower(coalesce({translit("business_address")}, '')) as a0 from {source}),
e2 as (select *, nullif(regexp_extract(n0, '{T.WEB}', 1), '') as web from e1),
e3 as materialized (select *, {R.sql("coalesce(web, n0)", R.NAME)} as name_clean, {R.sql("a0", R.ADDRESS)} as addr_clean, web is not null as is_web, regexp_matches(business_name, '[^\\x00-\\x{{024F}}]') as name_nonlatin from e2),
e4 as (select *, {chosen("name_clean", T.LEGAL)} as legal_form, coalesce(nullif({core}, ''), name_clean) as name_core, regexp_extract_all(addr_clean, '\\d+') as nums from e3),
ent as materialized (select * exclude (n0, a0, web, nums), replace(name_core, ' ', '') as name_compact, {R.sql("name_core", R.SOUND)} as name_skel,
  list_filter(nums, lambda x, i: list_position(nums, x) = i) as addr_numbers, regexp_extract_all(addr_clean, '\\b\\d{{5,6}}\\b')[-1] as postcode,
  len(list_filter(string_split(addr_clean, ' '), lambda t: t in ({", ".join(f"'{w}'" for w in T.LANDMARK)}))) > 0 as is_landmark, addr_clean = '' as addr_missing from e4)"""


#: Records from documents: the first five words are the name, the next eight the address.
RECORDS = rf"""
raw as (select doc_id, lang, text, string_split(trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')), ' ') as ws from documents),
rec as (select doc_id as rid, cast(1 + doc_id % 3 as int) as src, 'E' || doc_id as entity_id, coalesce(lang, 'UNKNOWN') as country, array_to_string(ws[1:5], ' ') as business_name, array_to_string(ws[6:13], ' ') as business_address, text from raw)"""
ENT = "with" + RECORDS + "," + clean_ctes("rec")
S = ",\ns1 as (select * from ent where src = 1), s23 as (select * from ent where src <> 1)"
TRUTH = ",\ntruth as (select a.rid as s1_rid, b.src, b.rid as cand_rid from (select country, text, min(rid) as rid from s1 group by all) a join s23 b on a.country = b.country and a.text = b.text)"
WORDS = "list_filter(list_distinct(string_split({c}, ' ')), lambda t: length(t) >= 3 and not regexp_matches(t, '^\\d+$'))"
DF = f""",
wd as materialized (select country, w, count(*) as df from (select country, unnest(list_concat({WORDS.format(c="name_core")}, {WORDS.format(c="addr_clean")})) as w from s23) group by all)"""


def rarest(col: str, prefix: str) -> str:
    return f""",
{prefix}x as (select src, rid, w, row_number() over (partition by src, rid order by coalesce(df, 0), w) as i from (select src, rid, country, unnest({WORDS.format(c=col)}) as w from ent) left join wd using (country, w)),
{prefix} as materialized (select src, rid, max(w) filter (where i = 1) as {prefix}1, max(w) filter (where i = 2) as {prefix}2 from {prefix}x where i <= 2 group by all)"""


RAREST = rarest("name_core", "rn") + rarest("addr_clean", "ra")
KEYS = """,
keys as materialized (select src, rid, country, case when length(name_compact) >= 4 then name_compact end as k_name,
  case when length(replace(name_skel, ' ', '')) >= 3 then replace(name_skel, ' ', '') end as k_skel, rn1 as k_rn1, rn2 as k_rn2, rn1 || '|' || ra1 as k_rn1_ra1,
  case when length(string_split(name_skel, ' ')[1]) >= 2 then string_split(name_skel, ' ')[1] || '|' || addr_numbers[1] end as k_skel1_num,
  addr_numbers[1] || '|' || ra1 as k_num_ra1, least(ra1, ra2) || '|' || greatest(ra1, ra2) as k_ra12
  from ent left join rn using (src, rid) left join ra using (src, rid))"""


def candidates(name: str, keys: str, pairs: list[tuple[str, str]], max_block: int) -> str:
    l = " union all ".join(f"select country, {i} as channel, {a} as k, rid as s1_rid from {keys} where src = 1 and {a} is not null" for i, (a, _) in enumerate(pairs))  # noqa: E741
    r = " union all ".join(f"select country, {i} as channel, {b} as k, src, rid as cand_rid from {keys} where src <> 1 and {b} is not null" for i, (_, b) in enumerate(pairs))
    return f""",
{name}_l as ({l}), {name}_r as (select *, count(*) over (partition by country, channel, k) as size from ({r})),
{name} as materialized (select distinct s1_rid, src, cand_rid from {name}_l join (select * from {name}_r where size <= {max_block}) using (country, channel, k))"""


ALL_KEYS = ["k_name", "k_skel", "k_rn1", "k_rn2", "k_rn1_ra1", "k_skel1_num", "k_num_ra1", "k_ra12"]
KEY_PAIRS = [(k, k) for k in ALL_KEYS] + [("k_rn1", "k_rn2"), ("k_rn2", "k_rn1")]
SIMPLE = """,
sk as materialized (select src, rid, country, case when length(name_compact) >= 4 then name_compact end as k_name,
  case when addr_numbers[1] is not null and length(string_split(name_core, ' ')[1]) >= 3 then addr_numbers[1] || '|' || string_split(name_core, ' ')[1] end as k_num_word,
  case when len(string_split(name_core, ' ')) >= 2 then array_to_string(string_split(name_core, ' ')[1:2], ' ') end as k_two_words from ent)"""
SIMPLE_PAIRS = [(k, k) for k in ("k_name", "k_num_word", "k_two_words")]
BASE = ENT + S + DF + RAREST + KEYS + candidates("cand", "keys", KEY_PAIRS, 50)
#: A number from 0.001 to 1 that ids fix, where a query needs a score and no model.
P = "((s1_rid * 7919 + cand_rid * 104729 + src * 31) % 1000 + 1) / 1000.0"
SCORED = BASE + f",\nsc as materialized (select *, {P} as score from cand)"
BOTH = """,
pr as (select c.*, {cols} from cand c join s1 on s1.rid = c.s1_rid join s23 on s23.src = c.src and s23.rid = c.cand_rid)"""


def paired(*cols: str) -> str:
    return BOTH.format(cols=", ".join(f"s1.{c} as {c}_1, s23.{c} as {c}_2" for c in cols))


OWNER = ",\nown as materialized (select * exclude (i) from (select *, row_number() over (partition by src, cand_rid order by score desc, s1_rid) as i from sc) where i = 1)"


def f05(matched: str) -> str:
    return f""",
fn as (select s1_rid, count(t) as n_truth, count(m) as n_pred, count(*) filter (where t is not null and m is not null) as hit from
  (select distinct s1_rid, src, cand_rid, 1 as t from truth) full join (select distinct s1_rid, src, cand_rid, 1 as m from {matched}) using (s1_rid, src, cand_rid) group by s1_rid),
f as (select s1.rid as s1_rid, coalesce(n_truth, 0) as n_truth, coalesce(n_pred, 0) as n_pred, coalesce(hit, 0) as hit from s1 left join fn on fn.s1_rid = s1.rid),
ff as (select *, case when n_truth = 0 and n_pred = 0 then 1.0 when hit = 0 then 0.0 else 1.25 * hit / (0.25 * n_truth + n_pred) end as f05 from f)"""


def vectors(min_df: int = 2) -> str:
    return f""",
tm as (select country, src, rid, 'n' as field, unnest(list_transform(range(1, length(name_compact) - 2), lambda i: name_compact[i:i + 3])) as term from ent
  union all select country, src, rid, 'a', unnest(list_filter(string_split(addr_clean, ' '), lambda t: t <> '')) from ent),
tf as (select country, src, rid, field, term, count(*) as tf from tm group by all),
dfs as (select country, field, term, count(*) as df from tf group by all having count(*) >= {min_df}),
cn as (select country, count(*) as n from ent group by all),
wt as (select tf.*, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as w from tf join dfs using (country, field, term) join cn using (country)),
vec as materialized (select country, src, rid, field, term, w / sqrt(sum(w * w) over (partition by src, rid, field)) as w from wt)"""


def search(max_postings: int, depth: int, k: int, kn: int, ka: int, ke: int) -> str:
    dot = "select a.rid as s1_rid, b.src, b.rid as cand_rid, sum(case when field = 'n' then a.w * b.w else 0 end) as cos_name, sum(case when field = 'a' then a.w * b.w else 0 end) as cos_addr from {a} a join {b} b using (country, field, term) group by all"
    top = lambda src, by, n: f"select s1_rid, src, cand_rid from (select *, row_number() over (partition by s1_rid order by round({by}, 9) desc, src, cand_rid) as i from {src}) where i <= {n}"
    return f""",
q as (select * from vec where src = 1), p as materialized (select * from vec where src <> 1),
qr as (select * from q where (country, field, term) not in (select country, field, term from p group by all having count(*) > {max_postings})),
prb as ({dot.format(a="qr", b="p")}), pr1 as ({top("prb", "(cos_name + cos_addr) / 2", depth)}),
full_ as materialized ({dot.format(a="q", b="p")}),
s0 as materialized (select *, (cos_name + cos_addr) / 2 as cos_comb from full_ join pr1 using (s1_rid, src, cand_rid)),
pe as (select p.* from p join s23 using (src, rid) where field = 'n' and addr_missing),
qe as (select * from q where field = 'n' and (country, field, term) not in (select country, field, term from pe group by all having count(*) > {max_postings})),
em as ({dot.format(a="qe", b="pe")}),
fnd as ({top("s0", "cos_comb", k)} union {top("s0", "cos_name", kn)} union {top("s0", "cos_addr", ka)} union {top("em", "cos_name", ke)})
select s1_rid, src, cand_rid, round(cos_name, 6) as cos_name, round(cos_addr, 6) as cos_addr, round((cos_name + cos_addr) / 2, 6) as cos_comb from fnd join full_ using (s1_rid, src, cand_rid)"""


def drawn(seed: int, c: str) -> str:
    """A number of 48 bits that a seed and a value fix."""
    return f"cast('0x' || md5('{seed}|' || cast({c} as varchar))[1:12] as bigint)"


def lcs(name: str, pairs: str) -> str:
    """CTE `name`: a, b, n, the longest common subsequence of each distinct pair of `pairs` (a query with a and b; a of at
    most 125 characters), by bits: places of each character of a, then one step for each character of b."""
    mask = "list_sum(list_transform(range(1, length(a) + 1), lambda i: case when a[i] = c then pow(2, i - 1)::hugeint else 0::hugeint end))::hugeint"
    return f""",
{name}_p as materialized (select distinct a, b from ({pairs})),
{name}_m as materialized (select a, map_from_entries(list_transform(list_distinct(string_split(a, '')), lambda c: (c, {mask}))) as m, pow(2, length(a))::hugeint - 1 as every from (select distinct a from {name}_p)),
{name} as materialized (select a, b, length(a) - bit_count(list_reduce(list_prepend(every, list_transform(string_split(b, ''), lambda c: coalesce(m[c], 0::hugeint))), lambda s, u: ((s + (s & u)) | (s - (s & u))) & every)) as n
  from {name}_p join {name}_m using (a) where a <> '' and b <> '')"""


_WORDS = "list_filter(string_split({c}, ' '), lambda t: t <> '')"


def _sorted(c: str) -> str:
    return f"array_to_string(list_sort({_WORDS.format(c=c)}), ' ')"


def similarity(name: str, scorer: str, pairs: str) -> str:
    """CTE `name`: a, b, v, a similarity of the distinct pairs of `pairs`."""
    percent = "case when length({a}) + length({b}) = 0 then 100.0 else 200.0 * coalesce(n, 0) / (length({a}) + length({b})) end"
    base = f",\n{name}_d as materialized (select distinct a, b from ({pairs}))"
    if scorer == "jaro_winkler":
        return base + f",\n{name} as (select a, b, case when a = '' or b = '' then cast(a = b as int) else jaro_winkler_similarity(a, b) end as v from {name}_d)"
    if scorer in ("ratio", "token_sort"):
        x, y = ("a", "b") if scorer == "ratio" else (_sorted("a"), _sorted("b"))
        return base + f",\n{name}_s as (select a, b, {x} as x, {y} as y from {name}_d)" + lcs(f"{name}_l", f"select x as a, y as b from {name}_s") + f""",
{name} as (select s.a, s.b, {percent.format(a="x", b="y")} as v from {name}_s s left join {name}_l l on l.a = x and l.b = y)"""
    if scorer == "token_set":
        words = lambda c: f"list_distinct({_WORDS.format(c=c)})"
        part = lambda e: f"array_to_string(list_sort({e}), ' ')"
        only = lambda x, y: part(f"list_filter({words(x)}, lambda t: not list_contains({words(y)}, t))")
        return base + f""",
{name}_s as (select a, b, {part(f"list_filter({words('a')}, lambda t: list_contains({words('b')}, t))")} as s, {only("a", "b")} as x, {only("b", "a")} as y from {name}_d)""" + lcs(f"{name}_l", f"select x as a, y as b from {name}_s") + f""",
{name}_z as (select s.*, coalesce(n, 0) as n, cast(s <> '' as int) as gap, length(s) as ls, length(x) as la, length(y) as lb from {name}_s s left join {name}_l l on l.a = x and l.b = y),
{name} as (select a, b, case when ls + la = 0 or ls + lb = 0 then 0.0 when gap = 1 and (la = 0 or lb = 0) then 100.0 else greatest(100 - 100.0 * (la + lb - 2 * n) / (2 * (ls + gap) + la + lb),
  case when gap = 1 then 100 - 100.0 * (gap + la) / (2 * ls + gap + la) end, case when gap = 1 then 100 - 100.0 * (gap + lb) / (2 * ls + gap + lb) end) end as v from {name}_z)"""
    turned = f"select a, b, case when length(a) <= length(b) then a else b end as x, case when length(a) <= length(b) then b else a end as y from {name}_d union all select a, b, b, a from {name}_d where length(a) = length(b)"
    return base + f""",
{name}_t as (select * from ({turned}) where x <> ''),
{name}_w as materialized (select a, b, x, y[greatest(i, 1):least(i + length(x) - 1, length(y))] as w from (select *, unnest(range(2 - length(x), length(y) + 1)) as i from {name}_t))""" + lcs(f"{name}_l", f"select x as a, w as b from {name}_w") + f""",
{name}_b as (select w.a, w.b, max({percent.format(a="x", b="w")}) as v from {name}_w w left join {name}_l l on l.a = x and l.b = w group by all),
{name} as (select d.a, d.b, case when d.a = '' or d.b = '' then (case when d.a = d.b then 100.0 else 0.0 end) else v end as v from {name}_d d left join {name}_b using (a, b))"""


def similarities(wanted: dict[str, tuple[str, str, str]], source: str = "pr") -> str:
    """CTE `sim`: the rows of `source` with similarities, name -> (column, column, scorer)."""
    ctes = "".join(similarity(f"s_{n}", scorer, f"select {a} as a, {b} as b from {source}") for n, (a, b, scorer) in wanted.items())
    joins = " ".join(f"join s_{n} on s_{n}.a = {source}.{a} and s_{n}.b = {source}.{b}" for n, (a, b, _) in wanted.items())
    return ctes + f",\nsim as materialized (select {source}.*, {', '.join(f's_{n}.v as {n}' for n in wanted)} from {source} {joins})"


def scored(names: list[str], k: int = 40) -> str:
    """CTE `sc`: the best k scored pairs of each record, from `cand`."""
    sims = similarities({f"v_{c}": (f"{c}_1", f"{c}_2", "token_set") for c in (*names, "addr_clean")})
    name = f"greatest({', '.join(f'v_{c}' for c in names)})"
    return paired(*names, "addr_clean") + sims + f""",
sv as (select s1_rid, src, cand_rid, round(case when addr_clean_2 = '' then {name} else 0.6 * {name} + 0.4 * v_addr_clean end, 9) as score from sim),
sc as materialized (select * exclude (i) from (select *, row_number() over (partition by s1_rid order by score desc, src, cand_rid) as i from sv) where i <= {k})"""


def grid(thresholds: list[float]) -> str:
    """CTE `grid`: threshold, macro_f05, from `own`, `truth` and `s1`."""
    return f""",
th as (select unnest({thresholds}) as threshold), g as (select threshold, own.* from th join own on score >= threshold),
gp as (select threshold, g.s1_rid, count(*) as n_pred, count(t) as hit from g left join (select distinct *, 1 as t from truth) using (s1_rid, src, cand_rid) group by all),
nt as (select s1_rid, count(*) as n_truth from (select distinct * from truth) group by all),
al as (select e.threshold, e.rid as s1_rid, coalesce(n_truth, 0) as n_truth, coalesce(n_pred, 0) as n_pred, coalesce(hit, 0) as hit from (select rid, threshold from s1 cross join th) e left join nt on nt.s1_rid = e.rid left join gp on gp.s1_rid = e.rid and gp.threshold = e.threshold),
grid as (select threshold::double as threshold, round(avg(case when n_truth = 0 and n_pred = 0 then 1.0 when hit = 0 then 0.0 else 1.25 * hit / (0.25 * n_truth + n_pred) end), 6) as macro_f05 from al group by all)"""
