"""Readers and writers of record files.

TSV files are quoted like csv (doubled quotes); their header must be exact. Empty fields are empty strings. Row order,
where it counts, is an explicit `ord`.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = ["entity_id", "business_name", "business_address", "country"]
TRUTH = ["source1_entity_id", "matched_entity_ids"]
CANDIDATES = ["source1_entity_id", "candidate_entity_ids"]


class BadHeader(ValueError):
    """A file's header isn't the one asked for."""


def _schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_tsv(spark: SparkSession, path: str, columns: list[str], strict: bool = False) -> DataFrame:
    """All columns as strings, missing as ''; strict also fails on a row with too few or too many fields, whatever columns are asked for."""
    first = spark.read.text(path).limit(1).collect()
    if not first or [c.strip('"') for c in first[0][0].rstrip("\r").split("\t")] != columns:
        raise BadHeader(f"Bad header in {path}: {first[0][0] if first else 'no line'}")
    reader = spark.read.schema(_schema(columns)).option("sep", "\t").option("quote", '"').option("escape", '"').option("header", True)
    # A pruned parser reads only the fields that are asked for and would pass over the rest of a row.
    reader = reader.option("mode", "FAILFAST").option("columnPruning", False) if strict else reader.option("mode", "PERMISSIVE")
    return reader.csv(path).na.fill("")


def broken_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """What the strict reader fails on: the line, and how many of its fields were read that aren't empty."""
    schema = T.StructType([*_schema(columns).fields, T.StructField("line", T.StringType())])
    reader = spark.read.schema(schema).option("sep", "\t").option("quote", '"').option("escape", '"').option("header", True).option("mode", "PERMISSIVE")
    rows = reader.option("columnNameOfCorruptRecord", "line").option("columnPruning", False).csv(path).filter(F.col("line").isNotNull())
    return rows.select("line", F.size(F.array_compact(F.array(*columns))).alias("fields"))


def with_order(df: DataFrame) -> DataFrame:
    """Rows of a file-backed frame with their place in the files, by name and block, as `ord`.

    A block's rows keep their order in one partition; counts of blocks give each its first number, so no task orders all rows.
    """
    at = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__in": F.monotonically_increasing_id()}
    rows = df.select("*", *(c.alias(k) for k, c in at.items()))
    block = ["__file", "__block"]
    counts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"))
    firsts = counts.select(*block, (F.sum("__n").over(Window.orderBy(*block)) - F.col("__n")).alias("__first"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("__in")) - 1
    return rows.withColumn("__at", inside).join(firsts, block).select(*df.columns, (F.col("__first") + F.col("__at")).alias("ord"))


def read_sources(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(read_tsv(spark, f"{folder}/{split}/source{k}.tsv", SOURCE) for k in (1, 2, 3))  # type: ignore[return-value]


def targets(s2: DataFrame, s3: DataFrame) -> DataFrame:
    return s2.unionByName(s3)


def parse_ids(column: str):
    """A comma list as an array of distinct non-empty ids."""
    return F.array_distinct(F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != ""))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1 and its set of true ids."""
    return read_tsv(spark, path, TRUTH).select(F.col("source1_entity_id").alias("s1"), parse_ids("matched_entity_ids").alias("ids"))


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """s1 and ids of a result file, by raw tabs."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).filter(~F.col("value").rlike("^source1_entity_id\t"))
    return rows.select(F.get(parts, F.lit(0)).alias("s1"), F.array_distinct(F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: x != "")).alias("ids"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """s1 ids of a JSON object {"ids": [...]} or of words in a text file."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "ids array<string>")["ids"]
    return whole.select(F.explode(F.coalesce(listed, F.filter(F.split("value", r"\s+"), lambda x: x != ""))).alias("s1"))


def only_ids(s1: DataFrame, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose entity_id is listed, the first `limit` by `ord`."""
    out = s1 if ids is None else s1.join(ids, s1["entity_id"] == ids["s1"], "left_semi")
    return out if limit is None else out.orderBy("ord").limit(limit)


def fetch_records(wanted: DataFrame, records: DataFrame, strict: bool = False) -> DataFrame:
    """Records of the ids in wanted(id); strict raises if one is unknown."""
    if strict and (missing := wanted.join(records, wanted["id"] == records["entity_id"], "left_anti").head(1)):
        raise KeyError(f"unknown id {missing[0]['id']}")
    return records.join(wanted, records["entity_id"] == wanted["id"], "left_semi")


def id_lists(s1: DataFrame, links: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row for each s1 (entity_id, ord): its ids of links(s1, id, rank), by rank, first of repeats, comma-joined."""
    lists = links.filter("id is not null and id <> ''").groupBy("s1").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])).alias("ids"))
    out = s1.join(lists, s1["entity_id"] == lists["s1"], "left")
    return out.select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias(name), "ord")


def write_lists(lists: DataFrame, path: str) -> None:
    """A result file in s1's order: range-sorted parts, tabs and no quotes."""
    first, second = lists.columns[:2]
    lists.orderBy("ord").select(first, second).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def _content_digest(columns: list[str]) -> Column:
    """A digest of a group of rows that their order doesn't change: the sum of 60-bit pieces of each row's SHA-256."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    return F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def _shard_facts(results: DataFrame) -> DataFrame:
    """shard, n_s1, links, empty_pred, cands, zero_cand, digest of results(shard, s1, country, matches, cands)."""
    m, c = F.size("matches"), F.size("cands")
    return results.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_s1"), F.sum(m).alias("links"), F.sum((m == 0).cast("int")).alias("empty_pred"), F.sum(c).alias("cands"), F.sum((c == 0).cast("int")).alias("zero_cand"),
        _content_digest(results.columns).alias("digest"),
    )


def write_shards(results: DataFrame, path: str, run_hash: str) -> None:
    """Results (shard, s1, country, matches, cands) as Parquet by shard, replacing the shards that they hold and no others.

    Each shard's manifest (run hash, counts, content digest) and its counts by country are written after it, from what was written.
    """
    def write(df: DataFrame, where: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(where)

    write(results, f"{path}/results")
    shards = results.select("shard").distinct()
    written = results.sparkSession.read.schema(results.schema).parquet(f"{path}/results").join(shards, "shard", "left_semi").select(*results.columns)
    write(_shard_facts(written).withColumn("run_hash", F.lit(run_hash)), f"{path}/manifest")
    m, c = F.size("matches"), F.size("cands")
    by_country = written.groupBy("shard", "country").agg(F.count(F.lit(1)).alias("n_s1"), F.sum(m).alias("links"), F.sum((m == 0).cast("int")).alias("empty_pred"), F.sum(c).alias("cands"), F.sum((c == 0).cast("int")).alias("zero_cand"))
    write(by_country, f"{path}/by_country")


def reusable_shards(spark: SparkSession, path: str, run_hash: str, schema: T.StructType) -> DataFrame:
    """Shards whose manifest is of this run and agrees with the rows that are there."""
    manifest = spark.read.parquet(f"{path}/manifest").filter(F.col("run_hash") == run_hash)
    have = _shard_facts(spark.read.schema(schema).parquet(f"{path}/results").select(*schema.names))
    return manifest.select(*have.columns).join(have, have.columns, "left_semi").select("shard")


def write_json(data: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True, default=str))


def to_markdown(title: str, rows: list[dict]) -> str:
    """A report table."""
    if not rows:
        return f"# {title}\n"
    head = list(rows[0])
    return "\n".join([f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(str(r.get(h, "")) for h in head) + " |" for r in rows), ""])


#: Fixed: the fields of an experiment's row.
LEDGER = [
    "experiment_id", "timestamp", "hypothesis", "validation_version", "blocking_config", "feature_config", "model", "decision_rule", "threshold", "candidate_recall",
    "precision", "recall", "macro_f0.5", "singleton_accuracy", "avg_candidates", "runtime", "notes", "data_provenance", "fold",
]


def append_ledger(spark: SparkSession, path: str, row: dict) -> None:
    """One experiment's row, appended as a tab-separated file with the fixed fields: others are dropped, missing ones empty."""
    values = ["" if row.get(k) is None else str(row[k]) for k in LEDGER]
    one = spark.createDataFrame([values], _schema(LEDGER)).coalesce(1)
    one.write.mode("append").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_schema(LEDGER)).option("sep", "\t").option("quote", '"').option("escape", '"').option("header", True).csv(path).na.fill("")
