"""Pairwise similarities. Set measures are expressions; edit measures are Arrow UDFs over pairs of strings.

Conventions on empty input differ between generations, so each measure states its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from linkforge.functions import edit as E


def _single(measure: Callable) -> Callable[[str, str], float]:
    """A batch measure for one pair."""
    at = np.zeros(1, dtype=np.int64)
    return lambda a, b: float(measure([a], [b], at, at)[0])


ratio, token_sort_ratio, token_set_ratio, partial_ratio = map(_single, (E.ratio, E.token_sort_ratio, E.token_set_ratio, E.partial_ratio))
jaro_winkler = _single(E.jaro_winkler)


def distinct_pairs(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of positions (y below n): the distinct ones' two positions, and which of them each pair is."""
    pairs, of = np.unique(x * max(n, 1) + y, return_inverse=True)
    return *np.divmod(pairs, max(n, 1)), of


def measured(measure: Callable, scale: float, both_empty: float | None, left: list[str], right: list[str], i: np.ndarray, j: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A batch measure of distinct pairs, for each pair that is one of them; both_empty overrides the value of two empty strings."""
    found = measure(left, right, i, j) / scale
    if both_empty is not None:
        empty = np.array([not s for s in left], dtype=bool)[i] & np.array([not s for s in right], dtype=bool)[j]
        found = np.where(empty, both_empty, found)
    return found[of]


def pair_udf(measure: Callable, scale: float = 1.0, both_empty: float | None = None):
    """An Arrow UDF of two string columns by a batch measure; both_empty overrides the value of two empty strings.

    Each distinct pair of a batch is measured once: joins repeat them.
    """

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        (x, left), (y, right) = pd.factorize(a.fillna("")), pd.factorize(b.fillna(""))
        left, right = list(left), list(right)
        return pd.Series(measured(measure, scale, both_empty, left, right, *distinct_pairs(x.astype(np.int64), y.astype(np.int64), len(right))), dtype="float64")

    run.of = (measure, scale, both_empty)
    return run


TOKEN_SORT = pair_udf(E.token_sort_ratio, 100.0, 0.0)
TOKEN_SET = pair_udf(E.token_set_ratio, 100.0, 0.0)
PARTIAL = pair_udf(E.partial_ratio, 100.0, 0.0)
RATIO = pair_udf(E.ratio, 100.0)
JARO = pair_udf(E.jaro_winkler, 1.0, 0.0)
#: First generation: two empty strings are alike.
TOKEN_SORT_A, PARTIAL_A, JARO_A = pair_udf(E.token_sort_ratio, 100.0), pair_udf(E.partial_ratio, 100.0), pair_udf(E.jaro_winkler, 1.0, 1.0)
#: Second generation: two empty strings are unlike as token sets, alike in parts.
TOKEN_SET_B = pair_udf(E.token_set_ratio, 100.0)


def _count(a: Column) -> Column:
    return F.size(a)


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of arrays as sets; both_empty is 1 in the first generation."""
    union = _count(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(_count(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct elements in b; 0 for an empty a."""
    own = _count(F.array_distinct(a))
    return F.when(own == 0, F.lit(0.0)).otherwise(_count(F.array_intersect(a, b)) / own)


def number_overlap(a: Column, b: Column, need_both: bool = True) -> Column:
    """Jaccard of numbers; 0 unless both (first generation: either) have some."""
    some = (_count(a) > 0) & (_count(b) > 0) if need_both else (_count(a) > 0) | (_count(b) > 0)
    return F.when(some, jaccard(a, b)).otherwise(F.lit(0.0))


def number_conflict(a: Column, b: Column) -> Column:
    return ((_count(a) > 0) & (_count(b) > 0) & ~F.arrays_overlap(a, b)).cast("double")


def length_ratio(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(both_empty)).otherwise(F.least(F.length(a), F.length(b)) / longer)


def length_difference(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def same_label(a: Column, b: Column) -> Column:
    return ((a != "") & (a == b)).cast("double")


def contradiction(name: Column, addr: Column) -> Column:
    return ((name >= 0.85) & (addr > 0) & (addr < 0.45)).cast("double")


def agreement(name: Column, addr: Column) -> Column:
    return F.when((name >= 0.85) & (addr >= 0.85), 1.0).when((name >= 0.85) & (addr > 0) & (addr < 0.5), -1.0).otherwise(0.0)


def set_sizes(left: list[list[str]], right: list[list[str]], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of lists as sets: how many elements both, the first and the second have."""
    known: dict[str, int] = {}

    def coded(side: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        sets = [sorted({known.setdefault(t, len(known)) for t in x}) for x in side]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        return np.array([t for x in sets for t in x], dtype=np.int64), sizes

    (a, n), (b, m) = coded(left), coded(right)
    wide = max(len(known), 1)
    # In the order of the second lists and their elements.
    have = np.repeat(np.arange(len(right)), m) * wide + b
    begin = np.concatenate([[0], np.cumsum(n)])
    both = np.zeros(len(i), np.int64)
    if len(have):
        # The first sets' elements by their place in the set; larger sets come first, so that each place has fewer pairs than the one before.
        order = np.argsort(-n[i], kind="stable")
        sizes = n[i][order]
        for k in range(int(sizes.max(initial=0))):
            at = order[: np.searchsorted(-sizes, -k, "left")]
            asked = j[at] * wide + a[begin[i[at]] + k]
            both[at] += have[np.minimum(np.searchsorted(have, asked), len(have) - 1)] == asked
    return both, n[i], m[j]


def register(spark) -> None:
    """The edit measures by name, for SQL: ratio, token_sort_ratio, token_set_ratio, partial_ratio (0 to 1) and jaro_winkler."""
    for name, measure in {"ratio": RATIO, "token_sort_ratio": TOKEN_SORT, "token_set_ratio": TOKEN_SET, "partial_ratio": PARTIAL, "jaro_winkler": JARO}.items():
        spark.udf.register(name, measure)
