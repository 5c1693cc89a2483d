"""Per-entity F0.5, blocking and threshold diagnostics, error taxonomies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.functions import text as X
from linkforge.operators.split import id_digest


def f05(tp: Column, fp: Column, fn: Column) -> Column:
    """5 tp / (5 tp + 4 fp + fn); 1 when there is nothing to find and nothing was found."""
    return F.when(tp + fp + fn == 0, F.lit(1.0)).otherwise(5 * tp / (5 * tp + 4 * fp + fn))


def per_entity(s1: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    """s1, n_true, tp, fp, fn, f05 for every row of s1(s1); truth and links are (s1, id)."""
    t, p = truth.select("s1", "id").distinct().withColumn("t", F.lit(1)), links.select("s1", "id").distinct().withColumn("p", F.lit(1))
    both = t.join(p, ["s1", "id"], "full").na.fill(0, ["t", "p"])
    counts = both.groupBy("s1").agg(F.sum("t").alias("n_true"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn"))
    out = s1.select("s1").join(counts, "s1", "left").na.fill(0)
    return out.withColumn("f05", f05(F.col("tp"), F.col("fp"), F.col("fn")))


def check_keys(s1: DataFrame, predicted: DataFrame) -> None:
    """Raises unless the two have the same s1 and at least one."""
    odd = s1.select("s1").exceptAll(predicted.select("s1")).union(predicted.select("s1").exceptAll(s1.select("s1"))).head(1)
    if odd or not s1.head(1):
        raise ValueError(f"keys differ: {odd[0]['s1']}" if odd else "no keys")


def evaluate(scores: DataFrame) -> DataFrame:
    """One row: macro F0.5, micro precision and recall (null without links), singleton accuracy, counts."""
    single = F.col("n_true") == 0
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.avg("f05").alias("macro_f05"),
        F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fp"))).alias("micro_precision"), F.try_divide(F.sum("tp"), F.sum("n_true")).alias("micro_recall"),
        F.avg(F.when(single, (F.col("fp") == 0).cast("double"))).alias("singleton_accuracy"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
    )


def blocking_recall(truth: DataFrame, cands: DataFrame) -> DataFrame:
    """Retained true links over true links; 1 if there are none."""
    kept = truth.select("s1", "id").distinct().join(cands.select("s1", "id", F.lit(1).alias("hit")).distinct(), ["s1", "id"], "left")
    return kept.agg(F.coalesce(F.try_divide(F.sum(F.coalesce("hit", F.lit(0))), F.count(F.lit(1))), F.lit(1.0)).alias("blocking_recall"))


def nearest_rank(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank, halves to even, from counts of each value: the values' histogram is what is ordered."""
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("v"))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda p: F.bround((F.col("n") - 1) * p) + 1
    return ranked.agg(*(F.min(F.when(F.col("upto") >= at(p), F.col("v"))).cast("double").alias(name) for name, p in shares.items()))


def candidate_diagnostics(s1: DataFrame, truth: DataFrame, cands: DataFrame, n_targets: int) -> DataFrame:
    """One row of recall, coverage, candidate counts, reduction ratio and oracle F0.5."""
    hits = truth.select("s1", "id").distinct().join(cands.select("s1", "id", F.lit(1).alias("hit")).distinct(), ["s1", "id"], "left").na.fill(0, ["hit"])
    per = hits.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"), F.sum("hit").alias("hit"), *(F.sum(F.when(F.col("id").startswith(f"S{k}-"), x)).alias(f"{name}{k}") for k in (2, 3) for name, x in (("t", F.lit(1)), ("h", F.col("hit")))))
    sizes = cands.groupBy("s1").agg(F.countDistinct("id").alias("n"))
    rows = s1.select("s1").join(per, "s1", "left").join(sizes, "s1", "left").na.fill(0)
    oracle = f05(F.col("hit"), F.lit(0), F.col("n_true") - F.col("hit"))
    total = rows.agg(
        F.try_divide(F.sum("hit"), F.sum("n_true")).alias("micro_candidate_recall"), F.try_divide(F.sum("h2"), F.sum("t2")).alias("s2_recall"), F.try_divide(F.sum("h3"), F.sum("t3")).alias("s3_recall"),
        F.try_divide(F.sum(((F.col("n_true") > 0) & (F.col("hit") == F.col("n_true"))).cast("int")), F.sum((F.col("n_true") > 0).cast("int"))).alias("full_set_coverage"),
        F.avg("n").alias("avg_candidates"), F.max("n").cast("double").alias("max_candidates"), F.avg((F.col("n") == 0).cast("int")).alias("zero_candidate_frac"),
        (1 - F.sum("n") / (F.count(F.lit(1)) * max(n_targets, 1))).alias("reduction_ratio"), F.avg(oracle).alias("oracle_macro_f05"),
        F.sum("n_true").alias("true_matches_total"), F.sum("hit").alias("true_matches_retrieved"),
    )
    return total.crossJoin(nearest_rank(rows, "n", {"median_candidates": 0.5, "p95_candidates": 0.95, "p99_candidates": 0.99}))  # one row each


def cap_sweep(s1: DataFrame, truth: DataFrame, cands: DataFrame, caps: list[int]) -> DataFrame:
    """cap, micro and macro recall, oracle F0.5 and candidates by source, from one join: a link counts from its rank on."""
    hits = truth.select("s1", "id").distinct().join(cands.select("s1", "id", "rank"), ["s1", "id"], "left")
    per = hits.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"), *(F.sum((F.coalesce(F.col("rank"), F.lit(1 << 30)) <= k).cast("int")).alias(f"hit_{k}") for k in caps))
    sizes = cands.groupBy("s1").agg(*(F.sum(((F.col("rank") <= k) & F.col("id").startswith(f"S{j}-")).cast("int")).alias(f"n{j}_{k}") for k in caps for j in (2, 3)))
    rows = s1.select("s1").join(per, "s1", "left").join(sizes, "s1", "left").na.fill(0)
    each = rows.select("n_true", F.explode(F.array(*(F.struct(F.lit(k).alias("cap"), F.col(f"hit_{k}").alias("hit"), F.col(f"n2_{k}").alias("n2"), F.col(f"n3_{k}").alias("n3")) for k in caps))).alias("x")).select("n_true", "x.*")
    return each.groupBy("cap").agg(
        F.try_divide(F.sum("hit"), F.sum("n_true")).alias("micro_recall"), F.avg(F.when(F.col("n_true") > 0, F.col("hit") / F.col("n_true"))).alias("macro_recall"),
        F.avg(f05(F.col("hit"), F.lit(0), F.col("n_true") - F.col("hit"))).alias("oracle_macro_f05"), F.avg("n2").alias("avg_s2"), F.avg("n3").alias("avg_s3"),
    )


def threshold_curve(s1: DataFrame, truth: DataFrame, scored: DataFrame, grid: list[float]) -> DataFrame:
    """threshold, macro F0.5 for scored(s1, id, prob); each pair is read once for the whole grid."""
    n_true = truth.select("s1", "id").distinct().groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    marked = scored.select("s1", "id", "prob").join(truth.select("s1", "id", F.lit(1).alias("t")).distinct(), ["s1", "id"], "left").na.fill(0, ["t"])
    per = marked.groupBy("s1").agg(*(F.sum(((F.col("prob") >= g) & (F.col("t") == k)).cast("int")).alias(f"{name}{i}") for i, g in enumerate(grid) for name, k in (("tp", 1), ("fp", 0))))
    rows = s1.select("s1").join(n_true, "s1", "left").join(per, "s1", "left").na.fill(0)
    each = rows.select("n_true", F.explode(F.array(*(F.struct(F.lit(g).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, g in enumerate(grid)))).alias("x")).select("n_true", "x.*")
    return each.groupBy("threshold").agg(F.avg(f05(F.col("tp"), F.col("fp"), F.col("n_true") - F.col("tp"))).alias("macro_f05"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The first threshold of the best macro F0.5."""
    return curve.orderBy(F.desc("macro_f05"), "threshold").limit(1)


def joint_curve(s1: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: list[float], gates: list[float], rels: list[float]) -> DataFrame:
    """threshold, gate, rel, macro F0.5 of every combination for scored(s1, id, prob).

    A pair is joined to its s1's best probability once. What a combination accepts of an s1 is what lies at or above
    max(threshold, rel * best) if best reaches the gate: counts by threshold and rel are taken in one aggregation, gates follow.
    """
    best = scored.groupBy("s1").agg(F.max("prob").alias("best"))
    marked = scored.select("s1", "id", "prob").join(truth.select("s1", "id", F.lit(1).alias("t")).distinct(), ["s1", "id"], "left").na.fill(0, ["t"]).join(best, "s1")
    asked = [(t, r) for t in thresholds for r in rels]
    inside = lambda t, r, k: F.sum(((F.col("prob") >= t) & (F.col("prob") >= r * F.col("best")) & (F.col("t") == k)).cast("int"))
    per = marked.groupBy("s1").agg(F.first("best").alias("best"), *(inside(t, r, k).alias(f"{name}{i}") for i, (t, r) in enumerate(asked) for name, k in (("tp", 1), ("fp", 0))))
    n_true = truth.select("s1", "id").distinct().groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    rows = s1.select("s1").join(n_true, "s1", "left").join(per, "s1", "left").na.fill(0)
    cell = lambda i, t, r, g: F.struct(F.lit(t).alias("threshold"), F.lit(g).alias("gate"), F.lit(r).alias("rel"), *(F.when(F.col("best") >= g, F.col(f"{k}{i}")).otherwise(0).alias(k) for k in ("tp", "fp")))
    each = rows.select("n_true", F.explode(F.array(*(cell(i, t, r, g) for i, (t, r) in enumerate(asked) for g in gates))).alias("x")).select("n_true", "x.*")
    return each.groupBy("threshold", "gate", "rel").agg(F.avg(f05(F.col("tp"), F.col("fp"), F.col("n_true") - F.col("tp"))).alias("macro_f05"))


def best_setting(curve: DataFrame) -> DataFrame:
    """The first of the best combinations, in the order threshold, gate, rel."""
    return curve.orderBy(F.desc("macro_f05"), "threshold", "gate", "rel").limit(1)


def route_attribution(truth: DataFrame, cands: DataFrame) -> DataFrame:
    """route, true links it found, and those it alone found."""
    found = truth.select("s1", "id").distinct().join(cands, ["s1", "id"])
    return found.select(F.explode("routes").alias("route"), (F.size("routes") == 1).cast("int").alias("sole")).groupBy("route").agg(F.count(F.lit(1)).alias("hits"), F.sum("sole").alias("sole_hits"))


#: Fixed: why a true link is missing, in the order in which it is asked.
MISSES = ("1_target_absent_from_index", "2_no_shared_retrieval_key", "3_shared_key_not_queried", "4_discarded_by_route_limit", "5_in_pool_below_final_cap")


def miss_attribution(truth: DataFrame, cands: DataFrame, pool: DataFrame, targets: DataFrame, postings: DataFrame, all_keys: DataFrame, queried: DataFrame) -> DataFrame:
    """s1, id, category of the true links that cands lacks.

    pool: candidates without a cap; all_keys: every key (s1, route, key) that the index's rules give s1; queried: those asked.
    """
    missing = truth.select("s1", "id").distinct().join(cands.select("s1", "id"), ["s1", "id"], "left_anti")
    of_missing = missing.join(postings.select("id", "route", "key").distinct(), "id")
    shared = of_missing.join(all_keys.select("s1", "route", "key").distinct(), ["s1", "route", "key"])
    asked = shared.join(queried.select("s1", "route", "key").distinct(), ["s1", "route", "key"], "left_semi")
    flag = lambda df, name: df.select("s1", "id", F.lit(1).alias(name)).distinct()
    out = missing.join(targets.select("id", F.lit(1).alias("there")), "id", "left")
    for df, name in ((pool, "pooled"), (shared, "shared"), (asked, "asked")):
        out = out.join(flag(df, name), ["s1", "id"], "left")
    category = F.when(F.col("there").isNull(), MISSES[0]).when(F.col("pooled").isNotNull(), MISSES[4]).when(F.col("shared").isNull(), MISSES[1]).when(F.col("asked").isNotNull(), MISSES[3]).otherwise(MISSES[2])
    return out.select("s1", "id", category.alias("category"))


def miss_report(s1: DataFrame, truth: DataFrame, cands: DataFrame, misses: DataFrame) -> DataFrame:
    """category, misses by source, and the oracle F0.5 that finding them would gain."""
    per = per_entity(s1, truth, truth.join(cands.select("s1", "id").distinct(), ["s1", "id"], "left_semi"))
    n = s1.count()
    back = misses.groupBy("s1", "category").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("id").startswith("S2-").cast("int")).alias("s2"))
    gain = f05(F.col("tp") + F.col("k"), F.lit(0), F.col("fn") - F.col("k")) - F.col("f05")
    return back.join(per, "s1").groupBy("category").agg(F.sum("k").alias("misses"), F.sum("s2").alias("s2"), (F.sum("k") - F.sum("s2")).alias("s3"), (F.sum(gain) / n).alias("oracle_gain"))


#: Targets and S1 records of one key's block.
MISS_TARGETS, MISS_S1 = 2048, 2048


def miss_counts(s1: DataFrame, targets: DataFrame, found: DataFrame, cap: int, postings: DataFrame, all_keys: DataFrame, queried: DataFrame) -> DataFrame:
    """s1, n_true, tp and, by category, k and s2 (how many of them S2 has), where the true links are those of equal truth_key.

    The same categories as miss_attribution's, without a row for each link: s1 and targets have truth_key, found holds the true links in the
    pool with their rank. A key's S1 and targets meet in blocks, where a set of targets is a row of bits; nothing is left out.
    """
    c = F.col
    sizes = targets.groupBy("truth_key").agg(F.count(F.lit(1)).alias("nt")).join(s1.groupBy("truth_key").agg(F.count(F.lit(1)).alias("ns")), "truth_key")
    sizes = sizes.select("truth_key", F.ceil(c("ns") / MISS_S1).cast("int").alias("i"), F.ceil(c("nt") / MISS_TARGETS).cast("int").alias("j"))
    keys = lambda df, of, name: df.groupBy(of).agg(F.collect_set(F.concat_ws("\x1f", "route", "key")).alias(name))
    of_s1 = s1.select("s1", "truth_key").join(keys(all_keys, "s1", "keys"), "s1", "left").join(keys(queried, "s1", "asked"), "s1", "left")
    of_s1 = of_s1.join(found.groupBy("s1").agg(F.collect_list("id").alias("pool"), F.collect_list(F.when(c("rank") <= cap, c("id"))).alias("cands")), "s1", "left")
    of_t = targets.select("id", "truth_key").join(keys(postings, "id", "keys"), "id", "left")
    own = lambda x, n: F.pmod(F.xxhash64(x), c(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), c(n) - 1))
    n = max(-(-targets.count() // MISS_TARGETS), min(s1.count(), 2 * s1.sparkSession.sparkContext.defaultParallelism), 1)
    block = F.pmod(F.xxhash64("truth_key", "bi", "bj"), F.lit(n)).cast("int").alias("block")
    key = F.concat_ws("\x1f", "truth_key", "bi", "bj").alias("truth")
    none = F.lit(None).cast("array<string>")
    a = of_s1.join(sizes, "truth_key").withColumn("bi", own("s1", "i")).withColumn("bj", each("j")).select(block, key, c("s1").alias("id"), F.lit(True).alias("first"), "keys", "asked", "pool", "cands")
    b = of_t.join(sizes, "truth_key").withColumn("bj", own("id", "j")).withColumn("bi", each("i")).select(block, key, "id", F.lit(False).alias("first"), "keys", none.alias("asked"), none.alias("pool"), none.alias("cands"))
    schema = "s1 string, n_true long, tp long" + "".join(f", k{x} long, s2_{x} long" for x in range(1, 5))
    return a.unionByName(b).repartition(n, "block").groupBy("block").applyInArrow(_missed, schema).groupBy("s1").agg(*(F.sum(x.split()[0]).alias(x.split()[0]) for x in schema.split(", ")[1:]))


def _missed(block: pa.Table) -> pa.Table:
    first = block.column("first")
    a, b = block.filter(first).combine_chunks(), block.filter(pc.invert(first)).combine_chunks()
    text = lambda t, col: t.column(col).combine_chunks()

    def members(t: pa.Table, col: str) -> tuple[np.ndarray, pa.Array]:
        """Whose each element is, and the element after its row's truth."""
        lists = text(t, col)
        row = np.repeat(np.arange(len(t)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        return row, pc.binary_join_element_wise(text(t, "truth").take(pa.array(row)), lists.flatten(), "\x1e")

    wide = max(-(-len(b) // 8), 1)

    def sets(of: np.ndarray, names: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Rows of bits by name, the last one empty: which targets have it."""
        coded = names.dictionary_encode()
        bits = np.zeros((len(coded.dictionary) + 1, wide), np.uint8)
        np.bitwise_or.at(bits, (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), of // 8), (1 << (of % 8)).astype(np.uint8))
        return coded.dictionary, bits

    every = np.arange(len(b))
    by_truth, by_key = sets(every, text(b, "truth")), sets(*members(b, "keys"))
    by_id = sets(every, pc.binary_join_element_wise(text(b, "truth"), text(b, "id"), "\x1e"))
    s2 = np.packbits(pc.starts_with(text(b, "id"), "S2-").to_numpy(zero_copy_only=False), bitorder="little") if len(b) else np.zeros(wide, np.uint8)
    asks = {"keys": by_key, "asked": by_key, "pool": by_id, "cands": by_id}
    said = {col: members(a, col) for col in asks}
    spots = {col: (row, pc.fill_null(pc.index_in(names, value_set=asks[col][0]), len(asks[col][0])).to_numpy(zero_copy_only=False).astype(np.int64)) for col, (row, names) in said.items()}
    truth_at = pc.fill_null(pc.index_in(text(a, "truth"), value_set=by_truth[0]), len(by_truth[0])).to_numpy(zero_copy_only=False).astype(np.int64)
    out: list[np.ndarray] = []
    step = max((8 << 20) // (16 * wide), 1)
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    for begin in range(0, len(a), step):
        end = min(begin + step, len(a))
        true = by_truth[1][truth_at[begin:end]]

        def have(col: str, begin=begin, end=end, true=true) -> np.ndarray:
            row, spot = spots[col]
            lo, hi = np.searchsorted(row, [begin, end])
            # Each row begins with the empty set, so that none is left out.
            rows, at = np.r_[np.arange(end - begin), row[lo:hi] - begin], np.r_[np.full(end - begin, len(asks[col][0])), spot[lo:hi]]
            order = np.argsort(rows, kind="stable")
            return np.bitwise_or.reduceat(asks[col][1][at[order]], np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0]), axis=0) & true

        shared, asked, pool, cands = (have(col) for col in asks)
        rest = true & ~cands & ~pool
        parts = (rest & ~shared, rest & shared & ~asked, rest & shared & asked, true & ~cands & pool)
        out.append(np.stack([count(true), count(true & cands), *(count(x) for p in parts for x in (p, p & s2))]))
    cells = np.concatenate(out, axis=1) if out else np.zeros((10, 0), np.int64)
    names = ["n_true", "tp", *(f"{k}{x}" for x in range(1, 5) for k in ("k", "s2_"))]
    return pa.table({"s1": text(a, "id"), **dict(zip(names, cells, strict=True))})


def miss_summary(n: int, counts: DataFrame) -> DataFrame:
    """miss_report of miss_counts, for n S1 records."""
    c = F.col
    fn = c("n_true") - c("tp")
    each = F.explode(F.array(*(F.struct(F.lit(MISSES[x]).alias("category"), c(f"k{x}").alias("k"), c(f"s2_{x}").alias("s2")) for x in range(1, 5)))).alias("x")
    rows = counts.select("n_true", "tp", fn.alias("fn"), each).select("n_true", "tp", "fn", "x.*").filter("k > 0")
    gain = f05(c("tp") + c("k"), F.lit(0), c("fn") - c("k")) - f05(c("tp"), F.lit(0), c("fn"))
    return rows.groupBy("category").agg(F.sum("k").alias("misses"), F.sum("s2").alias("s2"), (F.sum("k") - F.sum("s2")).alias("s3"), (F.sum(gain) / n).alias("oracle_gain"))


def slices(truth: DataFrame, cands: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """dim, bucket, truth_links, retrieved, recall by source, country, target's script, ambiguity and multiplicity: GROUPING SETS of one pass."""
    links = truth.select("s1", "id").distinct()
    same = targets.filter("name_norm <> ''").groupBy("name_norm").agg(F.count(F.lit(1)).alias("same"))
    named = s1.select("s1", "country", "name_norm").join(same, "name_norm", "left").na.fill(0, ["same"])
    many = links.groupBy("s1").agg(F.count(F.lit(1)).alias("many"))
    rows = links.join(cands.select("s1", "id", F.lit(1).alias("hit")).distinct(), ["s1", "id"], "left").na.fill(0, ["hit"]).join(named, "s1").join(many, "s1").join(targets.select("id", "business_name"), "id", "left")
    dims = {"source": F.substring("id", 1, 2), "country": F.col("country"), "target_script": X.script_class("business_name"), "s1_name_ambiguity": X.ambiguity_bucket(F.col("same")), "s1_match_multiplicity": X.multiplicity_bucket(F.col("many"))}
    cols = rows.select("hit", *(c.alias(k) for k, c in dims.items()))
    grouped = cols.groupingSets([[F.col(k)] for k in dims], *(F.col(k) for k in dims)).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("truth_links"), F.sum("hit").alias("retrieved"))
    bits = {k: (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i)) for i, k in enumerate(dims)}
    dim, bucket = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, b in bits.items():
        dim, bucket = F.when(F.col("g") == b, k).otherwise(dim), F.when(F.col("g") == b, F.col(k)).otherwise(bucket)
    return grouped.select(dim.alias("dim"), bucket.alias("bucket"), "truth_links", "retrieved", (F.col("retrieved") / F.col("truth_links")).alias("recall"))


def error_taxonomy(scores: DataFrame, truth: DataFrame, cands: DataFrame, links: DataFrame) -> DataFrame:
    """category, n: false links of singletons and others, links lost in blocking or by the threshold, partly matched entities."""
    lost = truth.select("s1", "id").distinct().join(links.select("s1", "id"), ["s1", "id"], "left_anti")
    lost = lost.join(cands.select("s1", "id", F.lit(1).alias("had")).distinct(), ["s1", "id"], "left")
    by_link = lost.select(F.when(F.col("had").isNull(), "fn_blocking").otherwise("fn_threshold").alias("category"), F.lit(1).alias("n"))
    c = F.col
    by_entity = scores.select(F.explode(F.array(
        F.struct(F.lit("singleton_fp").alias("category"), F.when(c("n_true") == 0, c("fp")).otherwise(0).alias("n")),
        F.struct(F.lit("fp").alias("category"), F.when(c("n_true") > 0, c("fp")).otherwise(0).alias("n")),
        F.struct(F.lit("partial_miss").alias("category"), ((c("tp") > 0) & (c("fn") > 0)).cast("int").alias("n")),
    )).alias("x")).select("x.*")
    return by_link.unionByName(by_entity).groupBy("category").agg(F.sum("n").alias("n")).filter("n > 0")


def loss_report(scores: DataFrame, oracle: DataFrame) -> DataFrame:
    """One row: total loss, retrieval's and the matcher's part, and what no false links or all retrieved truths would gain."""
    j = scores.join(oracle.select("s1", F.col("f05").alias("o"), F.col("tp").alias("otp"), F.col("fn").alias("ofn")), "s1")
    c = F.col
    clean, full = f05(c("tp"), F.lit(0), c("fn")), f05(c("otp"), c("fp"), c("ofn"))
    return j.agg(
        F.avg("f05").alias("macro_f05"), F.avg("o").alias("candidate_oracle"), (1 - F.avg("f05")).alias("loss_total"), (1 - F.avg("o")).alias("loss_retrieval"), (F.avg("o") - F.avg("f05")).alias("loss_matcher"),
        (F.avg(clean) - F.avg("f05")).alias("gain_without_false"), (F.avg(full) - F.avg("f05")).alias("gain_with_all_retrieved"),
    )


def loss_by_country(s1: DataFrame, scores: DataFrame, oracle: DataFrame) -> DataFrame:
    """country, n, macro F0.5 and candidate oracle."""
    j = s1.select("s1", "country").join(scores.select("s1", "f05"), "s1").join(oracle.select("s1", F.col("f05").alias("o")), "s1")
    return j.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("macro_f05"), F.avg("o").alias("candidate_oracle"))


def singleton_losses(scores: DataFrame) -> DataFrame:
    """One row: singletons, those with false links, and their share of the macro loss."""
    single = F.col("n_true") == 0
    return scores.agg(F.sum(single.cast("int")).alias("singletons"), F.sum((single & (F.col("fp") > 0)).cast("int")).alias("false_merge"), (F.sum(F.when(single, 1 - F.col("f05")).otherwise(0.0)) / F.count(F.lit(1))).alias("macro_loss_share"))


def rejected_quantiles(truth: DataFrame, scored: DataFrame, threshold: float, shares=(0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact quantiles of the probabilities of true candidates below the threshold."""
    return truth.select("s1", "id").distinct().join(scored, ["s1", "id"]).filter(F.col("prob") < threshold).agg(F.percentile("prob", list(shares)).alias("quantiles"), F.count(F.lit(1)).alias("n"))


def paired_bootstrap(deltas: DataFrame, rounds: int = 1000, seed: int = 42) -> dict[str, float]:
    """Mean of delta over entities with a 95 % interval.

    Resampling means needs only how often each distinct delta occurs, a table of few rows (F0.5 differences of small
    counts) whatever the number of entities; each round is one multinomial draw over it.
    """
    rows = deltas.groupBy(F.round("delta", 12).alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy("d").limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("too many distinct deltas")
    d, c = np.array([r["d"] for r in rows], dtype=float), np.array([r["c"] for r in rows], dtype=np.int64)
    if not len(d):
        return {"mean": 0.0, "low": 0.0, "high": 0.0, "better": 0, "worse": 0}
    n = int(c.sum())
    means = np.random.default_rng(seed).multinomial(n, c / n, size=rounds) @ d / n
    return {"mean": float(c @ d / n), "low": float(np.quantile(means, 0.025)), "high": float(np.quantile(means, 0.975)), "better": int(c[d > 0].sum()), "worse": int(c[d < 0].sum())}


def score_outputs(s1: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    """part, n, macro_f05: overall, by country, and by target source."""
    whole = per_entity(s1, truth, links).join(s1.select("s1", "country"), "s1")
    out = whole.agg(F.lit("overall").alias("part"), F.count(F.lit(1)).alias("n"), F.avg("f05").alias("macro_f05"))
    out = out.unionByName(whole.groupBy(F.concat(F.lit("country:"), "country").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("macro_f05")))
    for k in ("S2", "S3"):
        own = F.col("id").startswith(f"{k}-")
        out = out.unionByName(per_entity(s1, truth.filter(own), links.filter(own)).agg(F.lit(f"source:{k}").alias("part"), F.count(F.lit(1)).alias("n"), F.avg("f05").alias("macro_f05")))
    return out


def field_stats(records: DataFrame, columns: list[str]) -> DataFrame:
    """field, rows, empties, length mean / p50 / p95 (linear), token mean, shares with non-ASCII, digits and punctuation."""
    each = records.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("v")) for c in columns))).alias("x")).select("x.*")
    v = F.col("v")
    return each.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.trim(v) == "").cast("int")).alias("empty"), F.avg(F.length(v)).alias("len_mean"), F.percentile(F.length(v), 0.5).alias("len_p50"), F.percentile(F.length(v), 0.95).alias("len_p95"),
        F.avg(F.size(X.words(v))).alias("tokens_mean"), F.avg(v.rlike(r"[^\x00-\x7F]").cast("int")).alias("non_ascii_rate"), F.avg(v.rlike(r"[0-9]").cast("int")).alias("digit_rate"), F.avg(v.rlike(r"[^\p{L}\p{N}_\s]").cast("int")).alias("punct_rate"),
        F.avg(F.size(X.numeric_tokens(v))).alias("digit_tokens_mean"),
    )


def source_report(records: DataFrame) -> DataFrame:
    """source, records, unique and duplicate ids, countries."""
    return records.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct("entity_id").alias("n_unique_ids"), (F.count(F.lit(1)) - F.countDistinct("entity_id")).alias("n_duplicate_ids"), F.countDistinct("country").alias("n_countries"),
    )


def country_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source", "country").agg(F.count(F.lit(1)).alias("n"))


def truth_report(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: entities, links, singletons, matches in both sources, the empty prediction's F0.5."""
    per = truth.select("s1", "id").distinct().groupBy("s1").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("id").startswith("S2-").cast("int")).alias("a"), F.max(F.col("id").startswith("S3-").cast("int")).alias("b"))
    rows = s1.select("s1").join(per, "s1", "left").na.fill(0)
    return rows.agg(F.count(F.lit(1)).alias("records"), F.sum("k").alias("links"), F.avg((F.col("k") == 0).cast("int")).alias("singleton_rate"), F.sum(F.col("a") * F.col("b")).alias("both_sources"), F.max("k").alias("most"), F.avg((F.col("k") == 0).cast("int")).alias("empty_baseline"))


def match_histogram(s1: DataFrame, truth: DataFrame) -> DataFrame:
    per = truth.select("s1", "id").distinct().groupBy("s1").agg(F.count(F.lit(1)).alias("matches"))
    return s1.select("s1").join(per, "s1", "left").na.fill(0).groupBy("matches").agg(F.count(F.lit(1)).alias("n"))


def noise_examples(truth: DataFrame, s1: DataFrame, targets: DataFrame, k: int = 20) -> DataFrame:
    """The first k true pairs side by side (a report's limit)."""
    first = truth.select("s1", "id").distinct().orderBy("s1", "id").limit(k)
    return first.join(s1.select("s1", F.col("business_name").alias("name_1"), F.col("business_address").alias("address_1")), "s1").join(targets.select("id", F.col("business_name").alias("name_t"), F.col("business_address").alias("address_t")), "id")


def false_profile(false_links: DataFrame) -> DataFrame:
    """Shares of false links with each sign of likeness or conflict."""
    tests = {"name_exact": F.col("name_exact") >= 1, "name_token_sort_ge_09": F.col("name_token_sort") >= 0.9, "addr_token_sort_lt_05": F.col("addr_token_sort") < 0.5, "num_conflict": F.col("num_conflict") >= 1, "long_num_conflict": F.col("long_num_conflict") >= 1, "country_equal": F.col("country_equal") >= 1}
    return false_links.agg(*(F.avg(c.cast("int")).alias(k) for k, c in tests.items()))


def assess(s1: DataFrame, truth: DataFrame, cands: DataFrame, links: DataFrame, n_targets: int, ids: DataFrame, digest: str) -> DataFrame:
    """One row for a frozen policy's links on a frozen slice of ids, whose digest must be the given one: evaluation and candidate diagnostics."""
    found = id_digest(ids).first()["digest"]
    if found != digest:
        raise ValueError(f"the slice's digest is {found}, not {digest}")
    only = lambda df: df.join(ids.select("s1"), "s1", "left_semi")
    scores = per_entity(only(s1), only(truth), only(links))
    return evaluate(scores).crossJoin(candidate_diagnostics(only(s1), only(truth), only(cands), n_targets))  # one row each


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; none if two runs agree."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
