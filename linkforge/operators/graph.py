"""Checkpoints in the shared folder, and connected components on top of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's. Where none is set, a local session gets a temporary one; a cluster must name its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="linkforge-ckpt-"))
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints; what is written there is removed when the session's process ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    # Marking needs the folder to be there.
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; an executor lost later costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to a scratch folder and read from there: compressed columns, for rows that several passes take."""
    folder = scratch_folder(df.sparkSession, name) + "/rows"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def min_label_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(src, dst) as (node, component), component being the least node.

    Large-star and small-star rounds (Kiveris et al. 2014): every node hands its neighbours to its
    least neighbour, until the edges are stars around the least nodes. Each half-round is one
    aggregation and one equi-join by node: a hub is pre-aggregated, and its join is split at run time
    because both of the join's sides come straight from a shuffle.
    Every round's edges are checkpointed; only counts and hash sums reach the driver. Nodes without
    an edge to another node, null ends and loops don't appear in the result.
    """
    ends = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    now = ends.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now = checkpointed(now)

    def dealt(per_node: DataFrame) -> DataFrame:
        # Adaptive execution leaves a skewed join alone if an aggregation stands between it and its shuffle.
        return per_node.repartition(F.xxhash64("src"))

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(dealt(least), "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        floor = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(dealt(floor), "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(floor.select("src", F.col("m").alias("dst")))
        now = checkpointed(small.filter("src <> dst").distinct())
        after = mark(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
