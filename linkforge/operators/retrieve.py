"""Candidate generation: keys of S1 joined to limited buckets, weights summed, the best few kept.

A variant is a set of routes with weights and limits, a country factor and a cap. The join is an equi-join on
(route, key); its volume is bounded by the limits, and AQE decides about broadcasts by measured sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.functions import similarity as S
from linkforge.functions import text as X
from linkforge.operators import index as I
from linkforge.operators.graph import stored

#: Texts of a block of S1 and of targets that tfidf_knn holds at a time; queries of a block at least, where few tasks would have work.
QUERY_BLOCK, TARGET_BLOCK, LEAST_BLOCK = 16_384, 1 << 19, 256
#: Bytes of products with a block's targets that are kept for names that queries repeat; names that are looked at one by one.
PRODUCT_BYTES, MOST_CELLS = 96 << 20, 8
#: S1 records of a place where candidates are told, and at least, where few tasks would have work; rows that are summed up at a time.
PLACE, LEAST_PLACE, CELLS = 2048, 64, 1 << 19
#: Rows of a batch of candidates that leaves Python.
ROWS = 1 << 14
#: Records' forms as pairs show them.
A_COLUMNS = {"na": "name", "aa": "addr", "ca": "country"}
B_COLUMNS = {"nb": "name", "ab": "addr", "cb": "country", "source": "source"}
PAIR_COLUMNS = (*A_COLUMNS, *B_COLUMNS)
ROUTES = ("name", "sig", "prefix", "token", "tok_intersect", "pair", "toknum", "num", "numtok", "numnum", "cpre8")


@dataclass(frozen=True)
class Variant:
    """What a generation of retrieval weighs, limits and keeps."""

    weights: dict[str, float]
    limits: dict[str, int]
    cap: int
    country: float
    balanced: bool = True
    idf: bool = True
    prefix: tuple[int, int] = (4, 4)
    per_add_country: bool = False
    rare: float | None = None  # token weight 2 / (1 + bucket / rare)
    tokens: str = "v2"
    neighbours: int = 0  # TF-IDF nearest targets, each adding twice its similarity
    forms: str = "v2"  # the generation whose normal forms the records have
    prefix_of: str = "name_norm"
    extra: tuple[str, ...] = field(default_factory=tuple)


_V2 = {"name": 8.0, "sig": 6.0, "prefix": 0.8, "num": 2.2}
_V2_LIMITS = {"name": 200, "sig": 200, "prefix": 60, "num": 80}
_PAIR, _PAIR_LIMITS = {"pair": 6.0, "toknum": 5.0}, {"pair": 200, "toknum": 100}
_AUX, _AUX_LIMITS = {"numtok": 4.0, "numnum": 4.0, "cpre8": 3.0}, {"numtok": 50, "numnum": 50, "cpre8": 100}


def _v4(*routes: str) -> Variant:
    return Variant(_V2 | _PAIR | {r: _AUX[r] for r in routes}, _V2_LIMITS | _PAIR_LIMITS | {r: _AUX_LIMITS[r] for r in routes}, 300, 0.55, extra=("pair", *routes))


#: Fixed: weights, limits, caps and country factors of each generation.
VARIANTS = {
    "a": Variant({"prefix": 1.0, "num": 1.5}, {"prefix": 200, "token": 200, "num": 200}, 80, 0.15, False, False, (3, 1), True, 50.0, "a", forms="a"),
    "b": Variant({"name": 5.0, "prefix": 1.0, "num": 1.8}, {"name": 40, "prefix": 40, "token": 40, "num": 40}, 60, 0.5, False, False, (3, 1), rare=40.0, tokens="a", neighbours=20, forms="b", prefix_of="name_key"),
    "v1": Variant({"name": 5.0, "prefix": 1.0, "token": 1.5, "num": 2.0}, {"name": 40, "prefix": 40, "token": 40, "num": 40}, 50, 0.5, False, False, (3, 1), tokens="v1", forms="v1"),
    "v2": Variant(_V2, _V2_LIMITS, 120, 0.55, balanced=False),
    "v3a": Variant(_V2, _V2_LIMITS, 120, 0.55),
    "v3b": _v4(),
    "v4a": _v4("numtok"),
    "v4b": _v4("cpre8"),
    "v4c": _v4("numnum"),
    "v4all": _v4("numtok", "numnum", "cpre8"),
}


def build_postings(targets: DataFrame, v: Variant) -> DataFrame:
    if v.tokens == "a":
        return (I.postings_a if v.per_add_country else I.postings_b)(targets)
    if v.tokens == "v1":
        return I.postings_v1(targets)
    out = I.postings_v2(targets)
    if v.extra:
        out = out.unionByName(I.postings_pair(targets))
    return out.unionByName(I.postings_aux(targets).filter(F.col("route").isin(*v.extra))) if len(v.extra) > 1 else out


def limit_postings(postings: DataFrame, v: Variant) -> DataFrame:
    return (I.limit_balanced if v.balanced else I.limit_plain)(postings, v.limits)


def _tokens(v: Variant) -> Column:
    name = F.col("name_norm")
    return {"a": F.filter(X.significant_tokens(name), lambda t: F.length(t) >= 3), "v1": X.sig_tokens_v1(name), "v2": X.sig_tokens(name)}[v.tokens]


def ranked_tokens(s1: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """s1, toks: its significant tokens with repeats as structs (order, pos, tok, df), rarest first; unseen ones count as n."""
    each = s1.select("s1", F.posexplode(X.sig_tokens(F.col("name_norm"))).alias("pos", "tok"))
    known = each.join(df.withColumnRenamed("key", "tok"), "tok", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = F.when(F.col("df") == 0, F.lit(n)).otherwise(F.col("df"))
    return known.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct(order.cast("long").alias("order"), "pos", "tok", F.greatest("df", F.lit(1)).alias("df")))).alias("toks"))


def query_keys(s1: DataFrame, v: Variant, postings: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """(s1, route, key, w, pos) of the plain routes, and of the sets that tok_intersect joins."""
    name, addr = F.col("name_norm"), F.col("addr_norm")
    # What several routes take is told once for each record.
    of = v.prefix_of if v.prefix_of in s1.columns else "name_norm"
    s1 = s1.select("s1", "name_norm", "addr_norm", F.when(name != "", X.prefix(F.col(of), *v.prefix)).alias("start"), X.nums(addr).alias("nums"), X.sorted_sig(name).alias("sig"), X.prefix(name, 8, 8).alias("eight"))
    key = lambda route, keys, w: F.transform(keys, lambda k: F.struct(F.lit(route).alias("route"), k.alias("key"), F.lit(w).cast("double").alias("w")))
    one = lambda route, k, w: key(route, F.array_compact(F.array(F.when(k != "", k))), w)
    parts = [one("name", name, v.weights["name"])] if "name" in v.weights else []
    parts.append(one("prefix", F.col("start"), v.weights["prefix"]))
    parts.append(key("num", F.col("nums"), v.weights["num"]))
    if "sig" in v.weights:
        parts.append(one("sig", F.col("sig"), v.weights["sig"]))
    numbers = F.array_distinct("nums")
    if "numtok" in v.weights:
        parts.append(key("numtok", I.products(F.slice(numbers, 1, 3), X.addr_tokens(addr)), v.weights["numtok"]))
    if "numnum" in v.weights:
        parts.append(key("numnum", I.unordered_pairs(F.slice(numbers, 1, 3), "#"), v.weights["numnum"]))
    if "cpre8" in v.weights:
        parts.append(one("cpre8", F.col("eight"), v.weights["cpre8"]))
    if v.tokens == "v1":
        parts.append(key("token", _tokens(v), v.weights["token"]))
    plain = s1.select("s1", F.explode(F.concat(*parts)).alias("k")).select("s1", "k.route", "k.key", "k.w")
    if v.rare is not None:
        sizes = postings.filter("route = 'token'").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        toks = s1.select("s1", F.explode(_tokens(v)).alias("key")).join(sizes, "key")
        plain = plain.unionByName(toks.select("s1", F.lit("token").alias("route"), "key", (F.lit(2.0) / (1 + F.col("n") / v.rare)).alias("w")))
    if not v.idf:
        return plain, None
    ranked = ranked_tokens(s1, I.token_df(postings), n)
    eight = ranked.select("s1", F.explode(F.slice("toks", 1, 8)).alias("t"))
    weight = 1.2 * F.greatest(F.log(F.lit(float(max(n, 2)))) - F.log(F.col("t.df").cast("double")), F.lit(0.5))
    out = plain.unionByName(eight.select("s1", F.lit("token").alias("route"), F.col("t.tok").alias("key"), weight.alias("w")))
    usable = F.filter(F.slice("toks", 1, 4), lambda t: t["df"] <= 5000)
    sets = ranked.filter(F.size("toks") >= 2).select("s1", usable.alias("sets")).filter(F.size("sets") >= 2)
    sets = sets.select("s1", F.size("sets").alias("n_sets"), F.posexplode("sets").alias("pos", "t")).select("s1", "n_sets", "pos", F.col("t.tok").alias("key"))
    if "pair" in v.weights:
        # Ties in frequency go by token, so that the six rarest are the same on every run.
        top = F.slice(F.transform(F.array_sort(F.array_distinct(F.transform("toks", lambda t: F.struct(t["order"].alias("o"), t["tok"].alias("tok"))))), lambda t: t["tok"]), 1, 6)
        pairs = ranked.select("s1", top.alias("top")).join(s1.select("s1", F.slice(numbers, 1, 4).alias("numbers")), "s1")
        both = F.concat(key("pair", I.unordered_pairs(F.col("top"), "|"), v.weights["pair"]), key("toknum", I.products(F.slice("top", 1, 4), F.col("numbers")), v.weights["toknum"]))
        out = out.unionByName(pairs.select("s1", F.explode(both).alias("k")).select("s1", "k.route", "k.key", "k.w"))
    return out, sets


#: Routes as bits, in the order of their names.
_NAMES = sorted((*ROUTES, "tfidf"))


def route_bit(route: str) -> int:
    return 1 << _NAMES.index(route)


def _forms(records: DataFrame, key: str) -> DataFrame:
    """What retrieval takes of records, written once: plans read it many times, and making it leaves the JVM."""
    cols = [key, "source", "ord", "name_norm", "addr_norm", "country_key", "name_key"]
    return stored(records.select(*(c for c in cols if c in records.columns)), "forms")


def _places(s1: DataFrame) -> tuple[DataFrame, int]:
    """(s1, place): S1 records by name in runs of PLACE, and about how many there are. Records of one place ask for much the same buckets."""
    ids = s1.groupBy("s1").agg(F.min("name_norm").alias("name_norm"))
    many, wide = ids.count(), 2 * s1.sparkSession.sparkContext.defaultParallelism
    size = min(PLACE, max(-(-many // wide), LEAST_PLACE))
    # Ranges are drawn from a sample, so they are told once and kept; few files hold them.
    runs = ids.repartitionByRange(max(min(wide, many // size), 1), "name_norm", "s1").sortWithinPartitions("name_norm", "s1").withColumn("n", F.monotonically_increasing_id())
    place = F.shiftright("n", 33) * F.lit(1 << 32) + F.floor(F.col("n").bitwiseAND((1 << 33) - 1) / size)
    return stored(runs.select("s1", place.cast("long").alias("place")), "places"), max(-(-many // size), 1)


#: What a row says by its kind: a key that an S1 asks, a bucket, an S1's own neighbours, an S1 record, a target record.
_ASKED, _BUCKET, _NEAR, _S1, _TARGET = range(5)
_ROW = {
    "s1": "string", "sc": "string", "route": "string", "key": "string", "w": "double", "bit": "int", "at": "int", "n_sets": "int", "found": "array<struct<id:string,tc:string>>",
    "name": "string", "addr": "string", "country": "string", "source": "string",
}


def candidates(s1: DataFrame, targets: DataFrame, v: Variant, cap: int | None = None, postings: DataFrame | None = None, kept: DataFrame | None = None, records: tuple[DataFrame, DataFrame] | None = None, edits: dict | None = None, tell: tuple[list[str], Callable] | None = None) -> DataFrame:
    """(s1, id, score, routes, rank) of s1(s1, name_norm, addr_norm, country_key) against prepared targets.

    Scores are rounded to 9 digits before ranking, since sums in another order may differ in the last bit;
    ties go to the lesser id. An s1 without keys and neighbours has no rows.
    A bucket, which limits bound, travels once to each place of S1 records where it is asked for; pairs arise there and stay there.

    records: both sides with the normal forms that pairs show (na, aa, ca and nb, ab, cb, and the target's source), unique ids;
    edits: edit measures of those by name, as (measure, first, second). Both are told where the pairs arise.
    tell: names of doubles and what tells them of Pairs, whole S1 at a time; with it, and records, pairs are (s1, id) and those.
    """
    s1, targets = _forms(s1, "s1"), _forms(targets, "id")
    postings = stored(build_postings(targets, v), "postings") if postings is None else postings
    kept = limit_postings(postings, v) if kept is None else kept
    keys, sets = query_keys(s1, v, postings, targets.count() if v.idf else 0)
    countries = targets.select("id", F.col("country_key").alias("tc"))
    buckets = kept.select("route", "key", "id").join(countries, "id").groupBy("route", "key").agg(F.collect_list(F.struct("id", "tc")).alias("found"))
    bit = F.element_at(F.create_map(*(F.lit(x) for r in _NAMES for x in (r, route_bit(r)))), F.col("route"))
    none = F.lit(0)
    asked = keys.select("s1", "route", "key", "w", bit.alias("bit"), none.alias("at"), none.alias("n_sets"))
    if sets is not None:
        asked = asked.unionByName(sets.select("s1", F.lit("token").alias("route"), "key", F.lit(0.0).alias("w"), none.alias("bit"), F.expr("shiftleft(1, pos)").alias("at"), "n_sets"))
    places, n = _places(s1)
    asked = stored(asked.join(s1.select("s1", F.col("country_key").alias("sc")), "s1").join(places, "s1"), "asked")

    def said(df: DataFrame, kind: int) -> DataFrame:
        return df.select("place", F.lit(kind).alias("kind"), *((F.col(k) if k in df.columns else F.lit(None)).cast(t).alias(k) for k, t in _ROW.items()))

    wanted = asked.select("place", "route", "key").distinct().join(buckets, ["route", "key"])
    rows = said(asked, _ASKED).unionByName(said(wanted, _BUCKET))
    known = wanted.select("place", F.explode("found.id").alias("id"))
    if v.neighbours:
        near = stored(tfidf_knn(s1, targets, v.neighbours).join(countries, "id"), "near")
        near = near.join(s1.select("s1", F.col("country_key").alias("sc")), "s1").join(places, "s1")
        rows = rows.unionByName(said(near.select("place", "s1", "sc", (2 * F.col("similarity")).alias("w"), F.lit(route_bit("tfidf")).alias("bit"), none.alias("at"), none.alias("n_sets"), F.array(F.struct("id", "tc")).alias("found")), _NEAR))
        known = known.unionByName(near.select("place", "id"))
    if records is not None:
        form = lambda df, *cols: df.select(*cols, F.col("name_norm").alias("name"), F.col("addr_norm").alias("addr"), F.col("country_key").alias("country"))
        rows = rows.unionByName(said(form(records[0], "s1").join(places, "s1"), _S1))
        rows = rows.unionByName(said(form(records[1], F.col("id").alias("s1"), "source").join(known.distinct().withColumnRenamed("id", "s1"), "s1"), _TARGET))
    measured = {k: (*f.of, a, b) for k, (f, a, b) in (edits or {}).items()}
    if tell:
        schema = "s1 string, id string" + "".join(f", {k} double" for k in tell[0])
        return rows.repartition(n, "place").groupBy("place").applyInArrow(_best(cap or v.cap, v.country, True, measured, tell[1]), schema)
    schema = "s1 string, id string, score double, bits int, rank int" + "".join(f", {c} string" for c in PAIR_COLUMNS if records) + "".join(f", {k} double" for k in measured)
    best = rows.repartition(n, "place").groupBy("place").applyInArrow(_best(cap or v.cap, v.country, records is not None, measured), schema)
    routes = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(route_bit(r)) != 0, r) for r in _NAMES)))
    return best.select("s1", "id", "score", routes.alias("routes"), "rank", *best.columns[5:])


def _best(cap: int, country: float, shown: bool, edits: dict, tell: Callable | None = None):
    """For applyInArrow over a place: sums of what its S1 records' buckets add to each target, and the best cap of each S1."""
    whole_bit = route_bit("tok_intersect")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(batches)
        kind = block.column("kind")
        part = lambda of: block.filter(pc.equal(kind, of)).combine_chunks()
        asked, buckets, near = part(_ASKED), part(_BUCKET), part(_NEAR)
        name = lambda t: pc.binary_join_element_wise(t.column("route"), t.column("key"), "\x1f")
        at_bucket = pc.index_in(name(asked), value_set=name(buckets))
        known = at_bucket.is_valid()
        asked = pa.concat_tables([asked.filter(known), near])
        bucket = np.concatenate([at_bucket.filter(known).to_numpy().astype(np.int64), len(buckets) + np.arange(len(near))])
        lists = pa.concat_tables([buckets, near]).column("found").combine_chunks()
        ptr = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        cells = lists.flatten()
        ids = cells.field("id").dictionary_encode()
        by_id = pc.array_sort_indices(ids.dictionary)
        place_of = np.empty(len(by_id), np.int64)
        place_of[by_id.to_numpy()] = np.arange(len(by_id))
        id_of, names = place_of[ids.indices.to_numpy()], ids.dictionary.take(by_id)
        who = asked.column("s1").combine_chunks().dictionary_encode()
        number, asking = who.indices.to_numpy().astype(np.int64), who.dictionary
        if shown:
            # S1 of one name follow each other, so that the texts of few pairs differ.
            a = part(_S1)
            by_name = pc.array_sort_indices(a.column("name").combine_chunks().take(pc.index_in(asking, value_set=a.column("s1"))))
            asking, turn = asking.take(by_name), np.empty(len(asking), np.int64)
            turn[by_name.to_numpy()] = np.arange(len(turn))
            number = turn[number]
        both = pa.concat_arrays([asked.column("sc").combine_chunks(), cells.field("tc")]).fill_null("").dictionary_encode()
        empty = pc.equal(both.dictionary, "").to_numpy(zero_copy_only=False)
        codes = both.indices.to_numpy()
        sc, tc = codes[: len(asked)], codes[len(asked) :]
        w, bit, at, sets = (asked.column(k).to_numpy() for k in ("w", "bit", "at", "n_sets"))
        order = np.argsort(number, kind="stable")
        upto = np.cumsum(ptr[bucket[order] + 1] - ptr[bucket[order]])
        ends = np.flatnonzero(np.r_[number[order][1:] != number[order][:-1], True]) + 1 if len(order) else []
        show = _shown(part(_S1), part(_TARGET), asking, names) if shown else None
        del block, kind
        begin = 0
        while begin < len(order):
            # As many whole S1 as sum up CELLS rows, one at least.
            base = upto[begin - 1] if begin else 0
            k = np.searchsorted(upto[np.asarray(ends) - 1], base + CELLS, "right")
            end = max(ends[k - 1] if k else 0, ends[np.searchsorted(ends, begin, "right")])
            of = order[begin:end]
            row, spot = _spread(ptr, bucket[of])
            begin = end
            if not len(row):
                continue
            row = of[row]
            pair = number[row] * len(names) + id_of[spot]
            by = np.argsort(pair, kind="stable")
            pair, row, spot = pair[by], row[by], spot[by]
            heads = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            bits, n_sets = np.bitwise_or.reduceat(bit[row], heads), np.maximum.reduceat(sets[row], heads)
            # tok_intersect: every one of the s1's sets has the target.
            whole = (n_sets > 0) & (np.bitwise_count(np.bitwise_or.reduceat(at[row], heads)) == n_sets)
            differ = np.logical_or.reduceat((sc[row] != tc[spot]) & ~empty[sc[row]] & ~empty[tc[spot]], heads)
            sums = np.add.reduceat(w[row], heads) + np.where(whole, 4.0, 0.0)
            score = np.round(np.where(differ, sums * country, sums), 9)
            bits = bits | np.where(whole, whole_bit, 0).astype(bits.dtype)
            some = np.flatnonzero(bits)
            s, i = np.divmod(pair[heads[some]], len(names))
            score, bits = score[some], bits[some]
            best = np.lexsort((i, -score, s))
            s = s[best]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
            rank = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)])) + 1
            top = rank <= cap
            s, i, score, bits, rank = s[top], i[best][top], score[best][top], bits[best][top], rank[top]
            pairs = show(s, i, score, bits, rank) if show else None
            if tell:
                columns = tell(pairs)
                for of in (slice(x, x + ROWS) for x in range(0, len(s), ROWS)):
                    yield pa.record_batch({"s1": asking.take(pa.array(s[of])), "id": names.take(pa.array(i[of]))} | {k: rounded(x[of]) for k, x in columns.items()})
                continue
            out = {"s1": asking.take(pa.array(s)), "id": names.take(pa.array(i)), "score": score, "bits": bits.astype(np.int32), "rank": rank.astype(np.int32)}
            yield from pa.table(out | pairs.forms() | {k: pairs.measured(*x) for k, x in edits.items()} if pairs else out).to_batches(ROWS)

    return run


def rounded(x: np.ndarray) -> np.ndarray:
    """Floats of 24 bits to 6 digits as doubles, halves away from zero: their millionfold is exact."""
    x = x.astype(np.float32).astype(np.float64)
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


@dataclass
class Pairs:
    """Pairs of all of some S1 records' candidates, by S1 and rank: numbers of the S1, scores, bits of routes, ranks, and texts of both records.

    texts: for each of PAIR_COLUMNS the distinct texts, and which of them each pair has.
    """

    s: np.ndarray
    score: np.ndarray
    bits: np.ndarray
    rank: np.ndarray
    texts: dict[str, tuple[pa.Array, np.ndarray]]

    def __post_init__(self) -> None:
        self.apart: dict[tuple[str, str], tuple] = {}

    def forms(self) -> dict[str, pa.Array]:
        return {to: d.take(pa.array(of)) for to, (d, of) in self.texts.items()}

    def distinct(self, p: str, q: str) -> tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Texts that the pairs have as p and q, the distinct pairs' two positions in them, and which of those each pair is."""
        if (p, q) not in self.apart:
            (a, x), (b, y) = self.texts[p], self.texts[q]
            # Only texts that these pairs have are handed on.
            (x, left), (y, right) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
            self.apart[p, q] = a.take(pa.array(x)).to_pylist(), b.take(pa.array(y)).to_pylist(), *S.distinct_pairs(left, right, len(y))
        return self.apart[p, q]

    def measured(self, measure: Callable, scale: float, both_empty: float | None, p: str, q: str) -> np.ndarray:
        """An edit measure of each distinct pair, for each pair."""
        return S.measured(measure, scale, both_empty, *self.distinct(p, q))


def _shown(a: pa.Table, b: pa.Table, who: pa.Array, names: pa.Array) -> Callable:
    """For pairs (s, i) of who and names: Pairs, with the forms of the records a and b."""
    spots = [pc.index_in(v, value_set=t.column("s1")).to_numpy(zero_copy_only=False) for v, t in ((who, a), (names, b))]
    texts = {to: (k, t.column(col).combine_chunks().dictionary_encode()) for k, (t, cols) in enumerate(((a, A_COLUMNS), (b, B_COLUMNS))) for to, col in cols.items()}
    coded = {to: (k, e.dictionary, e.indices.to_numpy(zero_copy_only=False)) for to, (k, e) in texts.items()}

    def show(s: np.ndarray, i: np.ndarray, score: np.ndarray, bits: np.ndarray, rank: np.ndarray) -> Pairs:
        rows = spots[0][s].astype(np.int64), spots[1][i].astype(np.int64)
        return Pairs(s, score, bits, rank, {to: (d, codes[rows[k]].astype(np.int64)) for to, (k, d, codes) in coded.items()})

    return show


def exact_matches(s1: DataFrame, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """(s1, id): equal names and equal addresses, or, where one address is missing, equal countries.

    Two equi-joins, on name and address and on name and country, so a frequent name alone pairs nothing. limit: only the
    first so many targets of a name, by source and ord, are looked at.
    """
    t = targets.filter("name_norm <> ''")
    if limit is not None:
        t = t.withColumn("__at", F.row_number().over(Window.partitionBy("name_norm").orderBy("source", "ord", "id"))).filter(F.col("__at") <= limit)
    t = t.select("id", "name_norm", F.col("addr_norm").alias("ta"), F.col("country_key").alias("tc"))
    a, b = s1.select("s1", "name_norm", "addr_norm", "country_key"), t
    with_addr = a.filter("addr_norm <> ''").join(b.filter("ta <> ''"), (a["name_norm"] == b["name_norm"]) & (F.col("addr_norm") == F.col("ta")))
    same = (a["name_norm"] == b["name_norm"]) & (F.col("country_key") == F.col("tc"))
    bare = a.filter("addr_norm = '' and country_key <> ''").join(b, same).select("s1", "id")
    half = a.filter("addr_norm <> '' and country_key <> ''").join(b.filter("ta = ''"), same).select("s1", "id")
    return with_addr.select("s1", "id").unionByName(bare).unionByName(half)


def exact_among(pairs: DataFrame) -> DataFrame:
    """(s1, id) of the candidate pairs (na, aa, ca, nb, ab, cb) that match exactly by the same rule."""
    c = F.col
    both = (c("aa") != "") & (c("ab") != "")
    same = (both & (c("aa") == c("ab"))) | (~both & (c("ca") != "") & (c("ca") == c("cb")))
    return pairs.filter((c("na") != "") & (c("na") == c("nb")) & same).select("s1", "id")


def tfidf_knn(s1: DataFrame, targets: DataFrame, k: int = 20, low: int = 3, high: int = 5) -> DataFrame:
    """(s1, id, similarity, rank): the k nearest targets by cosine of TF-IDF weighted character n-grams inside words.

    Texts, not vectors, meet in pairs of blocks, with the vectors of the words there. Equal texts have equal neighbours, so S1 records
    are looked up once for each text, and of targets with one text only the k least ids can be among the k nearest.
    """
    c = F.col
    words = lambda x: X.words(c(x))
    cut = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))

    def grams(word):
        w = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*(F.when(F.length(w) >= n, cut(w, n)).otherwise(F.when(F.lit(n == low), F.array(w)).otherwise(F.array().cast("array<string>"))) for n in range(low, high + 1)))

    text = lambda df, id_: df.select(c(id_).alias("doc"), F.array_join(words("name_norm"), " ").alias("a"), F.array_join(words("addr_norm"), " ").alias("b"))
    t, q = text(targets, "id"), text(s1, "s1")
    n = targets.count()
    every = t.select(F.array_distinct(F.flatten(F.transform(F.concat(words("a"), words("b")), grams))).alias("g"))
    idf = every.select(F.explode("g").alias("g")).groupBy("g").agg((F.log((1 + F.lit(n)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    first = F.row_number().over(Window.partitionBy("a", "b").orderBy("doc"))
    t = t.withColumn("at", first).filter(c("at") <= k).drop("at")
    asked = q.groupBy("a", "b").agg(F.min("doc").alias("doc"))
    many = asked.count()
    i = max(-(-many // QUERY_BLOCK), min(2 * s1.sparkSession.sparkContext.defaultParallelism, -(-many // LEAST_BLOCK)), 1)
    j = max(-(-n // TARGET_BLOCK), 1)

    def blocks(df: DataFrame, of: int) -> DataFrame:
        # An address is one block's, so that few addresses meet there; records without one are dealt by name.
        return df.withColumn("own", F.pmod(F.xxhash64("b", F.when(c("b") == "", c("a"))), F.lit(of)).cast("int"))

    t, asked = blocks(t, j), blocks(asked, i)
    spoken = lambda df: df.select("own", F.explode(F.array_distinct(F.concat(words("a"), words("b")))).alias("a")).distinct()
    said_t, said_q = spoken(t), spoken(asked)
    tf = said_t.select("a").unionByName(said_q.select("a")).distinct().select("a", F.explode(grams(c("a"))).alias("g")).groupBy("a", "g").agg(F.count(F.lit(1)).alias("tf"))
    vectors = tf.join(idf, "g").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("g", (c("tf") * c("idf")).alias("w")))).alias("v")).select("a", c("v.g").alias("g"), c("v.w").alias("w"))

    def dealt(df: DataFrame, kind: int, query: bool) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit((j if query else i) - 1)))
        at = [c("own").alias("i"), each.alias("j")] if query else [each.alias("i"), c("own").alias("j")]
        row = [c("doc"), c("a"), c("b"), F.lit(None).cast("array<string>").alias("g"), F.lit(None).cast("array<double>").alias("w")] if kind < 2 else [F.lit(None).cast("string").alias("doc"), c("a"), F.lit(None).cast("string").alias("b"), c("g"), c("w")]
        return df.select(*at, F.lit(kind).alias("kind"), *row)

    rows = dealt(t, 0, False).unionByName(dealt(asked, 1, True)).unionByName(dealt(said_t.join(vectors, "a"), 2, False)).unionByName(dealt(said_q.join(vectors, "a"), 2, True))
    near = rows.repartition(i * j, "i", "j").groupBy("i", "j").applyInArrow(_nearest(k, PRODUCT_BYTES, MOST_CELLS), "doc string, id string, similarity double")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("similarity"), "id"))
    best = near.withColumn("rank", rank).filter(c("rank") <= k)
    same = q.join(asked.select("a", "b", c("doc").alias("one")), ["a", "b"]).select(c("doc").alias("s1"), c("one").alias("doc"))
    return same.join(best, "doc").select("s1", "id", "similarity", "rank")


def _spread(ptr: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows `of` of a ragged table: which of them each element belongs to, and the elements' places."""
    sizes = ptr[of + 1] - ptr[of]
    row = np.repeat(np.arange(len(of)), sizes)
    return row, np.arange(len(row)) + np.repeat(ptr[of] - np.cumsum(sizes) + sizes, sizes)


class _Texts:
    """Distinct strings as bags of known words, and which string each record has."""

    def __init__(self, column, known: dict[str, int]):
        coded = column.combine_chunks().dictionary_encode()
        self.of = coded.indices.to_numpy()
        bags = [[known[w] for w in s.split(" ") if w in known] for s in coded.dictionary.to_pylist()]
        self.ptr = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
        self.words = np.array([w for b in bags for w in b], dtype=np.int64)
        self.row = np.repeat(np.arange(len(bags)), np.diff(self.ptr))

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def bag(self, at: int) -> np.ndarray:
        return self.words[self.ptr[at] : self.ptr[at + 1]]

    def sums(self, by_word: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, by_word[self.words], len(self))


def _nearest(k: int, most_bytes: int, most_cells: int):
    """For applyInArrow over a pair of blocks (targets, queries and the vectors of their words): each query's k nearest targets there that share a gram.

    A product is a name's part and an address's part, each told once for all targets that have it. Targets of one name are looked at
    together, the most promising names first, until no name left can hold a target as near as the k-th; after most_cells names, only
    targets of those addresses are looked at that can be as near beside the best name left.
    """

    def run(block: pa.Table) -> pa.Table:
        kind = block.column("kind")
        part = lambda of: block.filter(pc.equal(kind, of))
        t, q, spoken = part(0).sort_by("doc"), part(1).sort_by([("b", "ascending"), ("a", "ascending")]), part(2).sort_by("a")
        out = lambda s, i, x: pa.table({"doc": s, "id": i, "similarity": pa.array(x, pa.float64())})
        none = pa.array([], pa.string())
        if not (len(t) and len(q) and len(spoken)):
            return out(none, none, [])
        # A word comes from either side; its vector is the same.
        names = spoken.column("a").to_pylist()
        spoken = spoken.take([x for x in range(len(names)) if not x or names[x] != names[x - 1]]).combine_chunks()
        known = {w: x for x, w in enumerate(spoken.column("a").to_pylist())}
        lists = spoken.column("g").combine_chunks()
        word_ptr = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        gram, weight = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64), spoken.column("w").combine_chunks().flatten().to_numpy()
        word_of, n_grams = np.repeat(np.arange(len(known)), np.diff(word_ptr)), int(gram.max()) + 1
        ta, tb, qa, qb = _Texts(t.column("a"), known), _Texts(t.column("b"), known), _Texts(q.column("a"), known), _Texts(q.column("b"), known)

        def norms(a: _Texts, b: _Texts) -> np.ndarray:
            found = []
            for begin in range(0, len(a.of), 8192):
                of = slice(begin, begin + 8192)
                (r1, p1), (r2, p2) = _spread(a.ptr, a.of[of]), _spread(b.ptr, b.of[of])
                rows, at = np.concatenate([r1, r2]), np.concatenate([a.words[p1], b.words[p2]])
                spot, place = _spread(word_ptr, at)
                cells, back = np.unique(rows[spot] * n_grams + gram[place], return_inverse=True)
                sums = np.bincount(back, weight[place], len(cells))
                found.append(np.sqrt(np.bincount(cells // n_grams, sums * sums, len(a.of[of]))))
            return np.concatenate(found)

        def products(bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the words with all names and all addresses of the targets."""
            _, place = _spread(word_ptr, bag)
            dense = np.bincount(gram[place], weight[place], n_grams)
            by_word = np.bincount(word_of, dense[gram] * weight, len(known))
            return ta.sums(by_word), tb.sums(by_word)

        size_t, size_q = norms(ta, tb), norms(qa, qb)
        # Targets by name, then by id, which is their place in t.
        place = np.argsort(ta.of, kind="stable")
        place = place[size_t[place] > 0]
        if not len(place):
            return out(none, none, [])
        name_of, addr_of, inv = ta.of[place], tb.of[place], 1 / size_t[place]
        begins = np.flatnonzero(np.r_[True, name_of[1:] != name_of[:-1]])
        ends, cell_name = np.r_[begins[1:], len(place)], name_of[begins]
        most_inv = np.maximum.reduceat(inv, begins)
        by_addr = np.argsort(addr_of, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(addr_of[by_addr]) > 0])
        addr_ptr, cell_addr, most_inv_addr = np.r_[heads, len(by_addr)], addr_of[by_addr][heads], np.maximum.reduceat(inv[by_addr], heads)
        kept: dict[int, tuple] = {}
        most = max(most_bytes // (8 * (len(ta) + len(tb))), 1)
        asked, found, scores, last, of_addr = [], [], [], -1, None
        for x in range(len(q)):
            if not size_q[x]:
                continue
            if qb.of[x] != last:
                last, of_addr = qb.of[x], products(qb.bag(qb.of[x]))
            name = qa.of[x]
            if name not in kept:
                if len(kept) >= most:
                    kept.pop(next(iter(kept)))
                kept[name] = products(qa.bag(name))
            alpha, beta = kept[name][0] + of_addr[0], kept[name][1] + of_addr[1]
            # Slack for what rounding and another order of the same sums change.
            bound = (alpha[cell_name] + beta.max()) * most_inv / size_q[x] + 2e-9
            order = np.argsort(-bound, kind="stable")
            at, value, have, kth, done = [], [], 0, -1.0, 0
            for cell in order[:most_cells]:
                if have >= k and bound[cell] < kth:
                    break
                of = slice(begins[cell], ends[cell])
                raw = (alpha[cell_name[cell]] + beta[addr_of[of]]) * inv[of] / size_q[x]
                good = np.flatnonzero((raw > 0) & (raw >= kth - 2e-9))
                at.append(place[of][good])
                value.append(np.round(raw[good], 9))
                have, done = have + len(good), done + 1
                if have >= k:
                    together = np.concatenate(value)
                    kth = np.partition(together, len(together) - k)[len(together) - k]
            if done < len(order) and not (have >= k and bound[order[done]] < kth):
                # Of the other names, targets at addresses that still allow it.
                seen, rest = np.zeros(len(ta), dtype=bool), alpha[cell_name[order[done:]]].max()
                seen[cell_name[order[:done]]] = True
                spot = by_addr[_spread(addr_ptr, np.flatnonzero((rest + beta[cell_addr]) * most_inv_addr / size_q[x] + 2e-9 >= kth))[1]]
                spot = spot[~seen[name_of[spot]]]
                raw = (alpha[name_of[spot]] + beta[addr_of[spot]]) * inv[spot] / size_q[x]
                good = np.flatnonzero((raw > 0) & (raw >= kth - 2e-9))
                at.append(place[spot[good]])
                value.append(np.round(raw[good], 9))
            at, value = np.concatenate(at), np.concatenate(value)
            top = np.lexsort((at, -value))[:k]
            asked.append(np.full(len(top), x))
            found.append(at[top])
            scores.append(value[top])
        take = lambda of, x: of.column("doc").combine_chunks().take(pa.array(np.concatenate(x) if x else [], pa.int64()))
        return out(take(q, asked), take(t, found), np.concatenate(scores) if scores else [])

    return run
