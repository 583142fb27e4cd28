"""Quality rules whose cutoffs carry a proven bound on the share of good documents that they reject.

Every rule is a score of a document (integers, higher is worse) and a ladder of cutoffs, fixed beforehand and ordered
from the mildest to the strictest. The verdict rejects what any rule rejects, so the verdict is what is certified: the
ladders are climbed in turn, a rung of one rule at a time, and every step of that climb is a set of cutoffs, one for each
rule. In each stratum the labelled documents of good quality that the base rule passes are a holdout: of n, k score
above a cutoff of the step. A step is certified if a true rejection rate of ALPHA or more would give k or fewer with
probability at most DELTA / strata: the exact binomial (Clopper-Pearson) bound, with a Bonferroni correction over the
strata. Steps are tested in their fixed order and testing stops at the first failure, which needs no correction of its
own. So with probability 1 - DELTA, in every stratum at once, the rules reject at most ALPHA of the good documents that
pass the base rule (whose own rejections are given, not chosen). A stratum too small to certify any step rejects nothing.

Defined cases: a null text has no words (base_failed), and so has an empty one; a null stratum value is a stratum of its
own; null labels are ignored; a document labelled more than once counts as good if all its labels are; labels of unknown
documents and null ids are ignored; repeated rows of a document each get the same verdict and count once in the holdout;
equal scores (ties with a cutoff) pass; empty tables give empty results, and without labels only the base rule rejects;
very long texts are handled whole, within their row; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ALPHA = 0.02
DELTA = 0.05
#: rule -> (score as SQL over the counts, cutoffs from the mildest to the strictest)
RULES = {
    "symbols": ("cast(floor(1000 * n_symbols / greatest(word_chars, 1)) as int)", [400, 300, 200, 150, 100, 70, 50, 30]),
    "lines": ("cast(floor(1000 * n_dup_lines / greatest(n_lines, 1)) as int)", [950, 900, 800, 700, 600, 500, 400, 300]),
    "repeats": ("cast(floor(1000 * n_repeat_words / greatest(n_words, 1)) as int)", [450, 400, 350, 300, 250, 200]),
    "length": ("cast(floor(100 * word_chars / greatest(n_words, 1)) as int)", [1500, 1200, 1000, 900, 800, 750, 700, 650]),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]




def text_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the counts of COUNTS and n_lines in place of the text, each text handled within its own row.

    n_repeat_words: each 3-word window is a long of its hash above and its position below. After a sort, windows of equal
    hash are neighbours, and neighbours are compared word by word. A window whose neighbour has its hash but other words
    (in texts of millions of words a few do) is compared with all of that hash, so the count is exact."""
    keep = [c for c in df.columns if c != text_col]
    d = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t"), common.words(F.col(text_col)).alias("__w"))
    d = d.select(
        *keep, "__w",
        F.expr("cast(size(__w) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(__w, '')) as bigint)").alias("word_chars"),
        F.expr(r"cast(length(__t) - length(regexp_replace(__t, '[#*$%&|<>]+', '')) as bigint)").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
        F.expr("shiftleft(1L, greatest(1, cast(ceil(log2(size(__w) + 1)) as int))) - 1L").alias("__m"),
    )
    d = d.select(
        *keep, "__w", "__m", "n_words", "word_chars", "n_symbols",
        F.expr("cast(size(__l) as bigint)").alias("n_lines"),
        F.expr("cast(size(__l) - size(array_distinct(__l)) as bigint)").alias("n_dup_lines"),
        F.expr("""sort_array(transform(slice(__w, 1, greatest(size(__w) - 2, 0)),
            (w, i) -> (xxhash64(w, get(__w, i + 1), get(__w, i + 2)) & ~__m) | cast(i as bigint)))""").alias("__p"),
    )
    alike, word = "({o} & ~__m) = (x & ~__m)", "get(__w, cast({o} & __m as int) + {k}) = get(__w, cast(x & __m as int) + {k})"
    same = "(" + " and ".join([alike, *(word.replace("{k}", str(k)) for k in range(3))]) + ")"
    before, after = "get(__p, i - 1)", "get(__p, i + 1)"
    repeats = f"""{same.format(o=before)} or {same.format(o=after)} or
        ((coalesce({alike.format(o=before)}, false) or coalesce({alike.format(o=after)}, false)) and exists(__p, o -> o <> x and {same.format(o="o")}))"""
    d = d.withColumn("__s", F.expr(f"sort_array(transform(filter(__p, (x, i) -> coalesce({repeats}, false)), x -> x & __m))"))
    n = "aggregate(transform(__s, (s, i) -> least(3L, s - coalesce(get(__s, i - 1), -3L))), 0L, (a, b) -> a + b)"
    return d.select(*keep, "n_lines", *COUNTS[:-1], F.expr(n).alias("n_repeat_words"))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum(col: Column) -> Column:
    """A stratum's name; null has one that no value has."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def steps(rules: dict = RULES) -> list[dict]:
    """The climb: after each step the cutoff of every rule, None where its ladder is not begun."""
    at, out = dict.fromkeys(rules), []
    for j in range(max(len(ladder) for _, ladder in rules.values())):
        for rule, (_, ladder) in rules.items():
            if j < len(ladder):
                at[rule] = ladder[j]
                out.append(dict(at))
    return out


def scored(counts: DataFrame, rules: dict = RULES) -> DataFrame:
    """counts with a column s_<rule> each."""
    return counts.select("*", *[F.expr(e).alias(f"s_{r}") for r, (e, _) in rules.items()])


def cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """good: one row per holdout document with its stratum and a column s_<rule> each.
    Returns stratum, n, step (how many are certified) and c_<rule>: one row per stratum."""
    climb = steps(rules)
    above = lambda at: F.count_if(F.coalesce(F.greatest(*[(F.col(f"s_{r}") > c).cast("int") for r, c in at.items() if c is not None], F.lit(0)), F.lit(0)) > 0)
    counts = common.materialise(good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[above(at).alias(f"k{i}") for i, at in enumerate(climb)]), "holdout")
    level = delta / max(counts.count(), 1)
    # The largest k that certifies: the binomial tail is summed upwards by the ratio of neighbouring terms, in logarithms.
    most = F.expr(f"""aggregate(sequence(0L, cast(ceil(n * {alpha!r}) as bigint)),
        named_struct('t', n * ln(1 - {alpha!r}), 'cdf', 0D, 'k', -1L),
        (a, i) -> named_struct('t', a.t + ln((n - i) / (i + 1D)) + ln({alpha!r} / (1 - {alpha!r})), 'cdf', a.cdf + exp(a.t),
            'k', if(a.cdf + exp(a.t) <= {level!r}, i, a.k))).k""")
    over = F.transform(F.array(*[f"k{i}" for i in range(len(climb))]), lambda k: k > F.col("most"))
    first = F.array_position(over, F.lit(True)).cast("int")
    out = counts.withColumn("most", most).withColumn("step", F.when(first > 0, first - 1).otherwise(len(climb)))
    ladder = lambda r: F.array(F.lit(None).cast("int"), *[F.lit(at[r]).cast("int") for at in climb])
    return out.select("stratum", "n", "step", *[F.get(ladder(r), F.col("step")).alias(f"c_{r}") for r in rules])


def certified(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """The cutoffs that labels certify for documents with their counts (__id, __th, stratum, ...; materialised)."""
    good = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("q")).where("q = 1").select("__id")
    held = scored(feats, rules).where(~base_failed()).join(good, "__id", "left_semi").dropDuplicates(["__id", "__th"])
    return common.lookup(common.materialise(cutoffs(held, alpha, delta, rules), "cutoffs"))[0]


def judged(feats: DataFrame, cut: DataFrame, rules: dict = RULES) -> DataFrame:
    """feats with base_failed and kept."""
    bad = F.greatest(*[F.coalesce(F.col(f"s_{r}") > F.col(f"c_{r}"), F.lit(False)).cast("int") for r in rules], F.lit(0)) > 0
    return scored(feats, rules).join(cut.drop("n", "step"), "stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~bad)


def _keyed(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> list[Column]:
    return [*common.row_key(docs, id_col, text_col), stratum(F.col(stratum_col)).alias("stratum"), F.col(text_col).alias("__text")]


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
             alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """One row per row of docs: __id, __th (see common.row_key), the counts, n_lines, stratum, base_failed and kept.

    The counts are computed once and written as a narrow table; texts are not shuffled."""
    feats = common.materialise(text_counts(docs.select(*_keyed(docs, id_col, text_col, stratum_col)), "__text"), "counts")
    out = judged(feats, certified(feats, labels, alpha, delta, rules), rules)
    return out.select("__id", "__th", "stratum", *COUNTS, "n_lines", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
              alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """docs without the rows that the rules reject; all columns stay as they are.

    Rows are written once beside their counts. The cutoffs read the narrow columns of that alone, and then one pass
    without a shuffle filters the rows."""
    rows = common.materialise(text_counts(common.whole_rows(docs, *_keyed(docs, id_col, text_col, stratum_col)), "__text"), "counted")
    cut = certified(rows.drop("__row"), labels, alpha, delta, rules)
    return judged(rows, cut, rules).where("kept").select("__row.*")


def oracle(alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> str:
    """The same verdicts as DuckDB SQL."""
    climb = " union all ".join(f"select {i} as step, " + ", ".join(f"cast({'null' if c is None else c} as int) as c_{r}" for r, c in at.items()) for i, at in enumerate(steps(rules), 1))
    scores = ", ".join(f"{e.replace('floor(', 'floor(1.0 * ')} as s_{r}" for r, (e, _) in rules.items())
    over = " or ".join(f"coalesce(s_{r} > c_{r}, false)" for r in rules)
    return rf"""
with w as (select doc_id, coalesce('=' || lang, '') as stratum, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, cast(sum(least(3, i - coalesce(p, -9))) as bigint) as n from (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from rep) group by doc_id),
l as (select doc_id, t, w, stratum, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from w),
c as (select l.doc_id, stratum, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  cast(len(l) as bigint) as n_lines, coalesce(cov.n, 0) as n_repeat_words from l left join cov using (doc_id)),
s as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {scores} from c),
good as (select * from s where not base_failed and doc_id in (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1)),
climb as ({climb}),
k as (select stratum, step, count(*) as n, count(*) filter (where {over}) as k from good, climb group by all),
lv as (select {delta} / count(distinct stratum) as level from good),
t as (select k.*, (select sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))) from (select unnest(range(k.k + 1)) as i)) <= level as ok from k, lv),
r as (select stratum, step, bool_and(ok) over (partition by stratum order by step) as ok from t),
cut as (select stratum, climb.* from (select stratum, max(step) as step from r where ok group by all) join climb using (step))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({over}) as kept from s left join cut using (stratum)"""
