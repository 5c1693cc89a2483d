"""Training rows, and splits that keep entities sharing a target together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.operators.graph import checkpointed, min_label_components


#: Draws are below this.
DRAWS = 1 << 52


def draw(*cols: str, seed: int = 42) -> Column:
    """A seeded number in 0..DRAWS of a row's key: the same on every run and partitioning, and in any engine that has MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *cols).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with label 1 where (s1, id) is in truth(s1, id)."""
    return pairs.join(truth.select("s1", "id", F.lit(1).alias("label")), ["s1", "id"], "left").na.fill(0, ["label"])


def sample_negatives(labelled: DataFrame, per_positive: int, floor: int, seed: int = 42) -> DataFrame:
    """All positives and, for each s1, max(floor, per_positive * max(positives, 1)) negatives in a seeded order."""
    of = Window.partitionBy("s1")
    most = F.greatest(F.lit(floor), per_positive * F.greatest(F.sum("label").over(of), F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("s1", "label").orderBy(draw("s1", "id", seed=seed), "id"))
    return labelled.withColumn("__most", most).withColumn("__rank", rank).filter((F.col("label") == 1) | (F.col("__rank") <= F.col("__most"))).drop("__most", "__rank")


def add_missed(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs and the true links that retrieval missed."""
    missed = truth.select("s1", "id").join(pairs.select("s1", "id"), ["s1", "id"], "left_anti")
    return pairs.unionByName(missed, allowMissingColumns=True)


def random_split(s1: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """s1 rows with fold val or train by a seeded hash."""
    return s1.withColumn("fold", F.when(draw("s1", seed=seed) < share * float(DRAWS), "val").otherwise("train"))


def bounded_sample(s1: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return s1.orderBy(draw("s1", seed=seed), "s1").limit(n)


def components(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, component): S1 rows that share a target, directly or through others; component is the least s1.

    Nodes are numbers that a checkpoint holds, one for each s1, so that none can be taken for another. Rows without a shared target
    are components of their own.
    """
    nodes = checkpointed(s1.select("s1").distinct().withColumn("node", F.monotonically_increasing_id()))
    links = truth.select("s1", "id").join(nodes, "s1").select("id", "node")
    least = links.groupBy("id").agg(F.min("node").alias("dst"))
    known = min_label_components(links.join(least, "id").select(F.col("node").alias("src"), "dst"))
    named = nodes.join(known, "node", "left").select("s1", F.coalesce("component", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("s1").alias("component"))
    return named.join(names, "root").select("s1", "component")


def component_split(members: DataFrame, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """(s1, component, fold): whole components, in a seeded order, fill the folds to their shares of all rows.

    The running sum goes over hash slices first, then inside each, so no task orders all components.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("at", draw("component", seed=seed)).withColumn("slice", F.shiftright("at", 42))
    starts = sizes.groupBy("slice").agg(F.sum("n").alias("m")).withColumn("start", F.sum("m").over(Window.orderBy("slice")) - F.col("m"))
    inside = F.sum("n").over(Window.partitionBy("slice").orderBy("at", "component")) - F.col("n")
    total = members.agg(F.count(F.lit(1)).alias("total"))  # one row
    placed = sizes.withColumn("inside", inside).join(starts.drop("m"), "slice").crossJoin(F.broadcast(total)).withColumn("before", (F.col("start") + F.col("inside")) / F.col("total"))
    fold, upto = F.lit(list(shares)[-1]), 1.0
    for name in reversed(list(shares)[:-1]):
        upto = sum(v for k, v in shares.items() if list(shares).index(k) <= list(shares).index(name))
        fold = F.when(F.col("before") < upto, name).otherwise(fold)
    return members.join(placed.select("component", fold.alias("fold")), "component").select("s1", "component", "fold")


def leaks(split: DataFrame) -> DataFrame:
    """Components that straddle folds; none in a sound split."""
    return split.groupBy("component").agg(F.countDistinct("fold").alias("folds")).filter("folds > 1")


def conflicts(split: DataFrame, frozen: DataFrame) -> DataFrame:
    """s1 whose fold differs from a frozen split's."""
    return split.join(frozen.select("s1", F.col("fold").alias("was")), "s1").filter("fold <> was")


def fresh_slice(split: DataFrame, used: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At least n s1 of whole components that no used s1 touches, in a seeded order of components."""
    touched = split.join(used, "s1", "left_semi").select("component").distinct()
    free = split.join(touched, "component", "left_anti")
    sizes = free.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("at", draw("component", seed=seed))
    # n bounds the rows that are needed: the first n components hold at least n rows.
    first = sizes.orderBy("at", "component").limit(n).withColumn("before", F.sum("n").over(Window.orderBy("at", "component")) - F.col("n"))
    return free.join(first.filter(F.col("before") < n), "component", "left_semi")


#: Ids of a slice that is digested.
MOST_IDS = 5_000_000


def id_digest(ids: DataFrame) -> DataFrame:
    """SHA-256 of the sorted ids, one a line, of a slice of MOST_IDS at most (its text is one value); larger ones fail."""
    n = F.count(F.lit(1))
    lines = F.array_join(F.array_sort(F.collect_list("s1")), "\n")
    first = ids.select("s1").limit(MOST_IDS + 1)
    return first.agg(n.alias("n"), lines.alias("lines")).select(F.when(F.col("n") > MOST_IDS, F.raise_error(F.lit("too many ids"))).otherwise(F.sha2("lines", 256)).alias("digest"))
