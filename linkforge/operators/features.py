"""Feature vectors of candidate pairs, as named columns in the order that models take them."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.functions import similarity as S
from linkforge.functions import text as X
from linkforge.operators.retrieve import ROUTES, Pairs, route_bit

CAP = 300
CORE = ["name_token_sort", "name_jaccard", "name_exact", "addr_token_sort", "num_overlap", "country_equal", "name_addr_conflict", "name_partial", "addr_jaccard"]
#: Fixed: names of features in the order that models take them.
COMPETITION = ["rank_frac", "log_score", "score_ratio_to_top", "n_cands", "name_s_rank", "name_s_gap_to_best_other", "n_cands_name_ge_09", "addr_s_rank", "s1_addr_missing", "t_addr_missing", "num_conflict", "same_source_count_name_ge_09"]
EXTRA = ["name_jw", "name_token_set", "addr_token_set", "addr_partial", "first_num_equal", "long_num_shared", "long_num_conflict", "name_len_ratio", "addr_len_ratio", "name_tok_contain_s1", "name_tok_contain_t"]
FEATURES_32 = CORE + COMPETITION + [f"route_{r}" for r in ROUTES]
FEATURES_43 = FEATURES_32 + EXTRA
FEATURES_A = ["name_jaccard", "name_jaro", "name_token_sort", "name_partial", "addr_jaccard", "addr_jaro", "addr_token_sort", "num_overlap", "country_equal", "name_len_ratio", "addr_len_ratio"]
FEATURES_B = [
    "name_exact", "addr_exact", "name_jaro", "name_ratio", "name_token_sort", "name_token_set", "name_partial", "name_jaccard", "name_contain_ab", "name_contain_ba",
    "addr_jaro", "addr_ratio", "addr_token_sort", "addr_jaccard", "num_overlap", "num_conflict", "country_equal", "country_missing", "name_missing", "addr_missing",
    "name_len_diff", "addr_len_diff", "retrieval_score", "retrieval_rank", "agree",
]


def pairs(cands: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with both records' normal forms: na, aa, ca and nb, ab, cb, and the target's source."""
    a = s1.select("s1", F.col("name_norm").alias("na"), F.col("addr_norm").alias("aa"), F.col("country_key").alias("ca"))
    b = targets.select("id", "source", F.col("name_norm").alias("nb"), F.col("addr_norm").alias("ab"), F.col("country_key").alias("cb"))
    return cands.join(a, "s1").join(b, "id")


def _float(cols: dict[str, Column]) -> dict[str, Column]:
    return {k: c.cast("float") for k, c in cols.items()}


def _both(a: str, b: str) -> Column:
    return ((F.col(a) != "") & (F.col(a) == F.col(b))).cast("double")


#: Edit measures of the 9 features, and of the further ones: asked for together, they leave the JVM once.
CORE_EDITS = {"name_token_sort": (S.TOKEN_SORT, "na", "nb"), "addr_token_sort": (S.TOKEN_SORT, "aa", "ab"), "name_partial": (S.PARTIAL, "na", "nb")}
EXTRA_EDITS = {"name_jw": (S.JARO, "na", "nb"), "name_token_set": (S.TOKEN_SET, "na", "nb"), "addr_token_set": (S.TOKEN_SET, "aa", "ab"), "addr_partial": (S.PARTIAL, "aa", "ab")}

EDITS_B = {
    "name_token_sort": (S.TOKEN_SORT, "na", "nb"), "addr_token_sort": (S.TOKEN_SORT, "aa", "ab"), "name_jaro": (S.JARO, "na", "nb"), "name_ratio": (S.RATIO, "na", "nb"),
    "name_token_set": (S.TOKEN_SET_B, "na", "nb"), "name_partial": (S.PARTIAL_A, "na", "nb"), "addr_jaro": (S.JARO, "aa", "ab"), "addr_ratio": (S.RATIO, "aa", "ab"),
}


def _measured(df: DataFrame, edits: dict) -> DataFrame:
    """df with those edit measures that it lacks."""
    return df.withColumns({k: f(a, b) for k, (f, a, b) in edits.items() if k not in df.columns})


def core_features(df: DataFrame) -> DataFrame:
    """The 9 features; similarities are doubles while the conflict is told, then all become floats."""
    c = F.col
    df = _measured(df, CORE_EDITS).withColumns({
        "name_jaccard": S.jaccard(X.sig_tokens(c("na")), X.sig_tokens(c("nb"))),
        "name_exact": _both("na", "nb"),
        "num_overlap": S.number_overlap(X.nums(c("aa")), X.nums(c("ab"))),
        "country_equal": S.same_label(c("ca"), c("cb")),
        "name_addr_conflict": S.contradiction(c("name_token_sort"), c("addr_token_sort")),
        "addr_jaccard": S.jaccard(X.sig_tokens(c("aa")), X.sig_tokens(c("ab"))),
    })
    return df.withColumns(_float({k: c(k) for k in CORE}))


def competition_features(df: DataFrame, name_s: str = "name_token_sort", addr_s: str = "addr_token_sort") -> DataFrame:
    """How a candidate stands among its s1's others; ranks are stable on the retrieval rank."""
    c, of = F.col, Window.partitionBy("s1")
    rank0 = lambda by: (F.row_number().over(of.orderBy(F.desc(by), "rank")) - 1) / CAP
    strong = (c(name_s) >= F.lit(0.9).cast("float")).cast("int")
    nums_a, nums_b = X.nums(c("aa")), X.nums(c("ab"))
    in_order = of.orderBy(F.desc(name_s), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, second = F.max(name_s).over(of), F.nth_value(name_s, 2).over(in_order)
    n = F.count(F.lit(1)).over(of)
    best_other = F.when(c(name_s) >= best, F.when(n > 1, second).otherwise(F.lit(0.0))).otherwise(best)
    score = c("score").cast("float")
    cols = {
        "rank_frac": (c("rank") - 1) / CAP,
        "log_score": F.log1p(score),
        "score_ratio_to_top": score / F.greatest(F.max(score).over(of), F.lit(1e-6).cast("float")),
        "n_cands": n / CAP,
        "name_s_rank": rank0(name_s),
        "name_s_gap_to_best_other": c(name_s) - best_other,
        "n_cands_name_ge_09": F.sum(strong).over(of),
        "addr_s_rank": rank0(addr_s),
        "s1_addr_missing": (F.trim("aa") == "").cast("int"),
        "t_addr_missing": (F.trim("ab") == "").cast("int"),
        "num_conflict": S.number_conflict(nums_a, nums_b),
        "same_source_count_name_ge_09": F.sum(strong).over(Window.partitionBy("s1", c("source") == "S2")),
    }
    cols |= {f"route_{r}": F.array_contains("routes", r).cast("int") for r in ROUTES}
    return df.withColumns(_float(cols))


def extra_features(df: DataFrame) -> DataFrame:
    c = F.col
    a, b = X.nums(c("aa")), X.nums(c("ab"))
    long_a, long_b = (F.filter(x, lambda n: F.length(n) >= 5) for x in (a, b))
    ta, tb = X.sig_tokens(c("na")), X.sig_tokens(c("nb"))
    return _measured(df, EXTRA_EDITS).withColumns(_float({
        **{k: c(k) for k in EXTRA_EDITS},
        "first_num_equal": F.coalesce((F.get(a, F.lit(0)) == F.get(b, F.lit(0))).cast("double"), F.lit(0.0)),
        "long_num_shared": F.arrays_overlap(long_a, long_b).cast("double"),
        "long_num_conflict": S.number_conflict(long_a, long_b),
        "name_len_ratio": S.length_ratio(c("na"), c("nb")), "addr_len_ratio": S.length_ratio(c("aa"), c("ab")),
        "name_tok_contain_s1": S.containment(ta, tb), "name_tok_contain_t": S.containment(tb, ta),
    }))


def features_43(df: DataFrame) -> DataFrame:
    return extra_features(competition_features(core_features(_measured(df, CORE_EDITS | EXTRA_EDITS))))


def told_43(p: Pairs) -> dict[str, np.ndarray]:
    """features_43 of all of some S1 records' candidates, where they arise: texts are compared once for each distinct pair, and nothing is exchanged."""
    out = {k: p.measured(*f.of, a, b) for k, (f, a, b) in (CORE_EDITS | EXTRA_EDITS).items()}

    def some(a: str) -> np.ndarray:
        d, of = p.texts[a]
        return pc.not_equal(d, "").to_numpy(zero_copy_only=False)[of]

    def equal(a: str, b: str) -> np.ndarray:
        """Both not empty and the same."""
        (d, x), (e, y) = p.texts[a], p.texts[b]
        at = pc.index_in(d, value_set=e).fill_null(-1).to_numpy()
        return (at[x] == y) & some(a)

    def sizes(a: str, b: str, rule) -> tuple[np.ndarray, ...]:
        left, right, i, j, of = p.distinct(a, b)
        return *S.set_sizes([rule(t) for t in left], [rule(t) for t in right], i, j), of

    share = lambda part, whole: np.where(whole > 0, part / np.maximum(whole, 1), 0.0)
    both, na, nb, of = sizes("na", "nb", X.sig_tokens_of)
    out |= {"name_jaccard": share(both, na + nb - both)[of], "name_tok_contain_s1": share(both, na)[of], "name_tok_contain_t": share(both, nb)[of]}
    both, na, nb, of = sizes("aa", "ab", X.sig_tokens_of)
    out["addr_jaccard"] = share(both, na + nb - both)[of]
    numbers = {t: X.nums_of(t) for side in p.distinct("aa", "ab")[:2] for t in side}
    both, na, nb, of = sizes("aa", "ab", numbers.get)
    out["num_overlap"] = np.where((na > 0) & (nb > 0), share(both, na + nb - both), 0.0)[of]
    out["num_conflict"] = ((na > 0) & (nb > 0) & (both == 0))[of]
    both, na, nb, of = sizes("aa", "ab", lambda t: [n for n in numbers[t] if len(n) >= 5])
    out |= {"long_num_shared": (both > 0)[of], "long_num_conflict": ((na > 0) & (nb > 0) & (both == 0))[of]}
    both, na, nb, of = sizes("aa", "ab", lambda t: numbers[t][:1])
    out["first_num_equal"] = (both > 0)[of]
    for k, a, b in (("name_len_ratio", "na", "nb"), ("addr_len_ratio", "aa", "ab")):
        (d, x), (e, y) = p.texts[a], p.texts[b]
        n, m = pc.utf8_length(d).to_numpy()[x], pc.utf8_length(e).to_numpy()[y]
        out[k] = share(np.minimum(n, m), np.maximum(n, m))
    blank = lambda d, of: pc.equal(pc.utf8_trim(d, " "), "").to_numpy(zero_copy_only=False)[of]
    out |= {"name_exact": equal("na", "nb"), "country_equal": equal("ca", "cb"), "s1_addr_missing": blank(*p.texts["aa"]), "t_addr_missing": blank(*p.texts["ab"])}
    name, addr = out["name_token_sort"], out["addr_token_sort"]
    out["name_addr_conflict"] = (name >= 0.85) & (addr > 0) & (addr < 0.45)
    # How a candidate stands among its s1's others: rows are by s1 and rank.
    heads = np.flatnonzero(np.r_[True, p.s[1:] != p.s[:-1]])
    many = np.diff(np.r_[heads, len(p.s)])
    of = np.repeat(np.arange(len(heads)), many)
    name, addr, score = (x.astype(np.float32) for x in (name, addr, p.score))

    def ordered(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions by s1, then falling; each row's place among its s1's."""
        order, place = np.lexsort((-by, of)), np.empty(len(by), np.int64)
        place[order] = np.arange(len(by)) - heads[of]
        return order, place

    order, name_place = ordered(name)
    best = name[order[heads]].astype(np.float64)
    second = np.where(many > 1, name[order[np.minimum(heads + 1, len(order) - 1)]].astype(np.float64), 0.0)
    strong = (name >= np.float32(0.9)).astype(np.int64)
    source, code = p.texts["source"]
    pool = 2 * of + pc.equal(source, "S2").to_numpy(zero_copy_only=False)[code]
    top = np.maximum(np.maximum.reduceat(score, heads), np.float32(1e-6))[of]
    out |= {
        "rank_frac": (p.rank - 1) / CAP, "log_score": np.log1p(score.astype(np.float64)), "score_ratio_to_top": score.astype(np.float64) / top, "n_cands": (many / CAP)[of],
        "name_s_rank": name_place / CAP, "name_s_gap_to_best_other": name - np.where(name >= best[of], second[of], best[of]), "n_cands_name_ge_09": np.add.reduceat(strong, heads)[of],
        "addr_s_rank": ordered(addr)[1] / CAP, "same_source_count_name_ge_09": np.bincount(pool, strong, 2 * len(heads))[pool],
    }
    out |= {f"route_{r}": (p.bits & route_bit(r)) != 0 for r in ROUTES}
    return {k: out[k].astype(np.float32) for k in FEATURES_43}


def features_a(df: DataFrame) -> DataFrame:
    """The first generation's 11 features; two empty sides are alike."""
    c = F.col
    return df.withColumns(_float({
        "name_jaccard": S.jaccard(X.words(c("na")), X.words(c("nb")), 1.0), "name_jaro": S.JARO_A("na", "nb"), "name_token_sort": S.TOKEN_SORT_A("na", "nb"), "name_partial": S.PARTIAL_A("na", "nb"),
        "addr_jaccard": S.jaccard(X.words(c("aa")), X.words(c("ab")), 1.0), "addr_jaro": S.JARO_A("aa", "ab"), "addr_token_sort": S.TOKEN_SORT_A("aa", "ab"),
        "num_overlap": S.number_overlap(X.numeric_tokens(c("aa")), X.numeric_tokens(c("ab")), need_both=False), "country_equal": S.same_label(c("ca"), c("cb")),
        "name_len_ratio": S.length_ratio(c("na"), c("nb"), 1.0), "addr_len_ratio": S.length_ratio(c("aa"), c("ab"), 1.0),
    }))


def features_b(df: DataFrame) -> DataFrame:
    """The second generation's 25 features; the retrieval score is 1 / (1 + rank)."""
    c = F.col
    ta, tb, ra, rb = (X.significant_tokens(c(x)) for x in ("na", "nb", "aa", "ab"))
    na, nb = X.numeric_tokens(c("aa")), X.numeric_tokens(c("ab"))
    missing = lambda x, y: ((c(x) == "") | (c(y) == "")).cast("double")
    df = _measured(df, EDITS_B).withColumns({
        "name_exact": _both("na", "nb"), "addr_exact": _both("aa", "ab"), "name_jaccard": S.jaccard(ta, tb), "name_contain_ab": S.containment(ta, tb), "name_contain_ba": S.containment(tb, ta),
        "addr_jaccard": S.jaccard(ra, rb), "num_overlap": S.number_overlap(na, nb), "num_conflict": S.number_conflict(na, nb),
        "country_equal": S.same_label(c("ca"), c("cb")), "country_missing": missing("ca", "cb"), "name_missing": missing("na", "nb"), "addr_missing": missing("aa", "ab"),
        "name_len_diff": S.length_difference(c("na"), c("nb")), "addr_len_diff": S.length_difference(c("aa"), c("ab")),
        "retrieval_score": 1 / (F.lit(1.0) + c("rank") - 1), "retrieval_rank": (c("rank") - 1).cast("double"), "agree": S.agreement(c("name_token_sort"), c("addr_token_sort")),
    })
    return df.withColumns(_float({k: c(k) for k in FEATURES_B}))
