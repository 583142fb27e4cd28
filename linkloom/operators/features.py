"""Scores and features of candidate pairs. Missing values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity

CONTEXT = ["score", "rank_in_s1", "gap_to_best_in_s1", "n_cands_s1", "rank_in_s1_src", "rank_in_cand", "gap_to_best_in_cand", "n_s1_for_cand"]
SIMILARITIES = {
    "name_token_set": ("name_core", "token_set"), "name_token_sort": ("name_core", "token_sort"), "name_ratio": ("name_core", "ratio"), "name_partial": ("name_core", "partial"),
    "skel_token_set": ("name_skel", "token_set"), "compact_ratio": ("name_compact", "ratio"), "compact_jw": ("name_compact", "jaro_winkler"),
    "addr_token_set": ("addr_clean", "token_set"), "addr_token_sort": ("addr_clean", "token_sort"), "addr_partial": ("addr_clean", "partial"),
}
PLAIN = ["num_first_equal", "num_jaccard", "num_prefix", "num_missing", "legal_equal", "legal_one_missing", "name_exact", "skel_exact", "len_name_1", "len_name_2", "web_2", "nonlatin_2", "addr_missing_2", "landmark_any"]
EXTRA = ["cos_name", "cos_addr", "cos_comb", "s1_name_count", "s23_name_count", "num_all_equal", "num_last_equal", "num_b_subset_a", "ce", "ce_gap", "ce_rank"]
STAGE2 = ["p1", "p1_rank", "p1_sum", "n_strong", "p1_best_other_src", "sim_name_other", "sim_addr_other", "p1_owner_gap"]
FEATURES_33 = ["src", *CONTEXT, *SIMILARITIES, *PLAIN]
FEATURES_44 = [*FEATURES_33, *EXTRA]
FEATURES_52 = [*FEATURES_44, *STAGE2]
PRUNE = ["src", "cos_name", "cos_addr", "cos_comb", *CONTEXT, "rank_comb_in_s1"]
RECORD = ["name_core", "name_skel", "name_compact", "addr_clean", "addr_numbers", "legal_form", "is_web", "name_nonlatin", "is_landmark", "addr_missing"]


def with_records(pairs: DataFrame, s1: DataFrame, s23: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """pairs with cols of both records as <col>_1 and <col>_2."""
    a = s1.select(F.col("rid").alias("s1_rid"), *[F.col(c).alias(f"{c}_1") for c in cols])
    b = s23.select("src", F.col("rid").alias("cand_rid"), *[F.col(c).alias(f"{c}_2") for c in cols])
    return pairs.join(a, "s1_rid", how).join(b, ["src", "cand_rid"], how)


def add_similarities(df: DataFrame, wanted: dict[str, tuple[str, str, str]]) -> DataFrame:
    """df with similarities, name -> (column, column, scorer), by one Arrow pass; nothing is shuffled."""
    d = df.withColumn("__s", similarity.scores(wanted))
    return d.withColumns({n: F.col(f"__s.{n}") for n in wanted}).drop("__s")


def top_per_s1(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("s1_rid").orderBy(F.desc("score"), "src", "cand_rid")
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k).drop("_i")


def simple_score(pairs: DataFrame, s1: DataFrame, s23: DataFrame, max_cands: int = 40) -> DataFrame:
    """score: 0.6 of the name's and 0.4 of the address's token-set similarity, the name's alone if the candidate has no address;
    rounded to nine digits, so that equal scores are ties however they were added up."""
    return _score(pairs, s1, s23, max_cands, ["name_core"])


def rule_score(pairs: DataFrame, s1: DataFrame, s23: DataFrame, max_cands: int = 40) -> DataFrame:
    """As simple_score, with the better of the name's and its skeleton's similarity."""
    return _score(pairs, s1, s23, max_cands, ["name_core", "name_skel"])


def _score(pairs: DataFrame, s1: DataFrame, s23: DataFrame, max_cands: int, names: list[str]) -> DataFrame:
    p = with_records(pairs.select("s1_rid", "src", "cand_rid"), s1, s23, [*names, "addr_clean"])
    p = add_similarities(p, {f"_s_{c}": (f"{c}_1", f"{c}_2", "token_set") for c in (*names, "addr_clean")})
    name = F.greatest(*[F.col(f"_s_{c}") for c in names]) if len(names) > 1 else F.col(f"_s_{names[0]}")
    p = p.select("s1_rid", "src", "cand_rid", F.round(F.when(F.col("addr_clean_2") == "", name).otherwise(0.6 * name + 0.4 * F.col("_s_addr_clean")), 9).alias("score"))
    return top_per_s1(p, max_cands)


#: Groups within which a pair is compared, and the order of equal scores there.
WITHIN = {"s1": (["s1_rid"], ["src", "cand_rid"]), "s1_src": (["s1_rid", "src"], ["cand_rid"]), "cand": (["src", "cand_rid"], ["s1_rid"])}
#: feature -> (kind, group)
CONTEXT_OF = {
    "rank_in_s1": ("rank", "s1"), "gap_to_best_in_s1": ("gap", "s1"), "n_cands_s1": ("count", "s1"), "rank_in_s1_src": ("rank", "s1_src"),
    "rank_in_cand": ("rank", "cand"), "gap_to_best_in_cand": ("gap", "cand"), "n_s1_for_cand": ("count", "cand"),
}


def context(df: DataFrame) -> DataFrame:
    """Ranks, gaps and counts of scored pairs within their record of source 1 and within their candidate."""

    def feature(kind: str, group: str) -> Column:
        by, ties = WITHIN[group]
        w = Window.partitionBy(*by)
        if kind == "rank":
            return F.row_number().over(w.orderBy(F.desc("score"), *ties)).cast("long")
        return F.count(F.lit(1)).over(w) if kind == "count" else F.max("score").over(w) - F.col("score")

    return df.withColumns({name: feature(*of) for name, of in CONTEXT_OF.items()})


def _flag(c: Column) -> Column:
    return c.cast("double")


def plain_features(p: DataFrame) -> dict[str, Column]:
    """The features of a pair with its records' columns that need no string similarity."""
    x, y = F.col("addr_numbers_1"), F.col("addr_numbers_2")
    both = (F.size(x) > 0) & (F.size(y) > 0)
    prefix = F.exists(x, lambda u: F.exists(y, lambda v: (u != v) & (F.startswith(u, v) | F.startswith(v, u))))
    l1, l2 = F.col("legal_form_1"), F.col("legal_form_2")
    return {
        "num_first_equal": F.when(both, _flag(F.get(x, F.lit(0)) == F.get(y, F.lit(0)))),
        "num_jaccard": F.when(both, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))),
        "num_prefix": F.when(both, _flag(prefix)),
        "num_missing": F.when(both, 0.0).otherwise(1.0),
        "legal_equal": F.when((l1 != "") & (l2 != ""), _flag(l1 == l2)),
        "legal_one_missing": _flag((l1 == "") != (l2 == "")),
        "name_exact": _flag(F.col("name_core_1") == F.col("name_core_2")),
        "skel_exact": _flag(F.col("name_skel_1") == F.col("name_skel_2")),
        "len_name_1": F.length("name_core_1").cast("double"),
        "len_name_2": F.length("name_core_2").cast("double"),
        "web_2": _flag(F.col("is_web_2")),
        "nonlatin_2": _flag(F.col("name_nonlatin_2")),
        "addr_missing_2": _flag(F.col("addr_missing_2")),
        "landmark_any": _flag(F.col("is_landmark_1") | F.col("is_landmark_2")),
    }


def pair_features(pairs: DataFrame, s1: DataFrame, s23: DataFrame) -> DataFrame:
    """pairs with all columns they have, ten similarities and fourteen plain features."""
    keep = pairs.columns
    p = with_records(pairs, s1, s23, RECORD)
    p = add_similarities(p, {out: (f"{col}_1", f"{col}_2", scorer) for out, (col, scorer) in SIMILARITIES.items()})
    sims = [(F.when(~F.col("addr_missing_2"), F.col(o)) if o.startswith("addr") else F.col(o)).alias(o) for o in SIMILARITIES]
    return p.select(*keep, *sims, *[c.alias(n) for n, c in plain_features(p).items()])


def name_counts(records: DataFrame, out: str) -> DataFrame:
    """(country, name_compact, out): records with a name per million of its country."""
    c = records.groupBy("country", "name_compact").agg(F.count(F.lit(1)).alias("n"))
    return c.join(records.groupBy("country").agg(F.count(F.lit(1)).alias("all")), "country").select("country", "name_compact", (F.col("n") * 1e6 / F.col("all")).alias(out))


def extra_features(pairs: DataFrame, s1: DataFrame, s23: DataFrame) -> DataFrame:
    """pairs with the names' rates and three more features of the address numbers."""
    keep = pairs.columns
    p = with_records(pairs, s1, s23, ["country", "name_compact", "addr_numbers"], "left")
    for i, (recs, out) in enumerate(((s1, "s1_name_count"), (s23, "s23_name_count")), 1):
        n = name_counts(recs, out).select(F.col("country").alias(f"country_{i}"), F.col("name_compact").alias(f"name_compact_{i}"), out)
        p = p.join(n, [f"country_{i}", f"name_compact_{i}"], "left")
    x, y = F.col("addr_numbers_1"), F.col("addr_numbers_2")
    both = (F.size(x) > 0) & (F.size(y) > 0)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return p.select(
        *keep, F.coalesce("s1_name_count", F.lit(0.0)).alias("s1_name_count"), F.coalesce("s23_name_count", F.lit(0.0)).alias("s23_name_count"),
        F.when(both, _flag(F.array_sort(x) == F.array_sort(y))).alias("num_all_equal"), F.when(both, _flag(last(x) == last(y))).alias("num_last_equal"),
        F.when(both, _flag(F.size(F.array_except(y, x)) == 0)).alias("num_b_subset_a"),
    )


def add_ce(df: DataFrame, ce: DataFrame | None) -> DataFrame:
    """df with ce, its gap to the best of the record of source 1 (0 or less) and its rank; null where there is none."""
    d = df.join(ce.select("s1_rid", "src", "cand_rid", "ce"), ["s1_rid", "src", "cand_rid"], "left") if ce is not None else df.withColumn("ce", F.lit(None).cast("double"))
    w = Window.partitionBy("s1_rid")
    rank = F.row_number().over(w.orderBy(F.desc_nulls_last("ce"), "src", "cand_rid")).cast("double")
    return d.withColumns({"ce_gap": F.col("ce") - F.max("ce").over(w), "ce_rank": F.when(F.col("ce").isNotNull(), rank)})


def stage2_windows(df: DataFrame) -> DataFrame:
    """df (with p1) with the four window features and the best candidate of the same record in the other source."""
    w, c = Window.partitionBy("s1_rid"), Window.partitionBy("src", "cand_rid")
    d = df.withColumns(
        {
            "p1_rank": F.row_number().over(w.orderBy(F.desc("p1"), "src", "cand_rid")).cast("double"), "p1_sum": F.sum("p1").over(w),
            "n_strong": F.count_if(F.col("p1") > 0.5).over(w).cast("double"), "p1_owner_gap": F.max("p1").over(c) - F.col("p1"), "_other": 5 - F.col("src"),
        }
    )
    first = F.row_number().over(Window.partitionBy("s1_rid", "src").orderBy(F.desc("p1"), "cand_rid"))
    best = df.select("s1_rid", "src", "cand_rid", "p1").withColumn("_i", first).where("_i = 1")
    best = best.select("s1_rid", F.col("src").alias("_other"), F.col("cand_rid").alias("other_rid"), F.col("p1").alias("p1_best_other_src"))
    return d.join(best, ["s1_rid", "_other"], "left").withColumnRenamed("_other", "other_src")


def stage2(df: DataFrame, s23: DataFrame) -> DataFrame:
    """df (with p1) with the eight features of the second stage."""
    d = stage2_windows(df)
    rec = s23.select("src", "rid", "name_core", "addr_clean")
    d = d.join(rec.select("src", F.col("rid").alias("cand_rid"), F.col("name_core").alias("_na"), F.col("addr_clean").alias("_aa")), ["src", "cand_rid"], "left")
    d = d.join(rec.select(F.col("src").alias("other_src"), F.col("rid").alias("other_rid"), F.col("name_core").alias("_nb"), F.col("addr_clean").alias("_ab")), ["other_src", "other_rid"], "left")
    d = add_similarities(d, {"sim_name_other": ("_na", "_nb", "token_set"), "sim_addr_other": ("_aa", "_ab", "token_set")})
    d = d.withColumns({c: F.when(F.col("_nb").isNotNull(), F.col(c)) for c in ("sim_name_other", "sim_addr_other")})
    return d.drop("_na", "_aa", "_nb", "_ab", "other_src", "other_rid")
