"""What the operators of this subpackage share: checkpoints, Arrow plumbing, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkforge.operators.graph import checkpointed, ensure_checkpoint_dir, min_label_components, remove_folder, scratch_folder

__all__ = ["checkpointed", "ensure_checkpoint_dir", "fresh", "map_batches", "min_label_components", "read_table", "remove_folder", "scratch_folder", "width"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions for a keyed exchange that carries whole texts."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh(taken: Iterable[str], name: str) -> str:
    """The name, with underscores added until no column has it (Spark's names ignore case)."""
    used = {c.lower() for c in taken}
    while name in used:
        name += "_"
    return name


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """One output batch for each Arrow batch; make() builds a task's state (caches, models) once.

    Batches are bounded in rows and in bytes by the session's Arrow settings, so that a task holds
    one batch of whole texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield step(batch)

    return df.mapInArrow(run, schema)
