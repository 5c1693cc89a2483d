"""Registered queries that go through files: written into the session's scratch folder, read back by the library's readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.operators import decide as D
from linkforge.operators import evaluate as E
from linkforge.operators import retrieve as R
from linkforge.operators import split as SP
from linkforge.operators import validate as V
from linkforge.operators.graph import checkpointed, scratch_folder
from linkforge.plans import adapters as A
from linkforge.plans import sql as Q
from linkforge.sources import tables as T
from linkforge.streaming import match as ST

Query = Callable[[SparkSession, str], DataFrame]

#: Fields with quotes, tabs, accents and nothing at all, as expressions of both engines.
TRICKY = {
    "entity_id": "entity_id",
    "business_name": "CASE ord % 5 WHEN 0 THEN '\"' || business_name || '\" é' WHEN 1 THEN business_name || chr(9) || 'x' WHEN 2 THEN '' ELSE business_name END",
    "business_address": "business_address",
    "country": "country",
}


def _tricky(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The records with those fields, and a folder that holds them as files in order."""
    rows = A.raw_records(spark, d).selectExpr("ord", *(f"{e} AS {k}" for k, e in TRICKY.items()))
    folder = scratch_folder(spark, "tsv") + "/rows"
    T.write_tsv(rows.orderBy("ord").select(T.SOURCE), folder)
    return rows, folder


def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return T.read_tsv(spark, _tricky(spark, d)[1], T.SOURCE, strict=True)


def tsv_order(spark: SparkSession, d: str) -> DataFrame:
    return T.with_order(T.read_tsv(spark, _tricky(spark, d)[1], T.SOURCE)).select("entity_id", "ord")


def tsv_broken(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth row lacks a field, every tenth has one more; one file, since a header heads each."""
    fields = ["entity_id", "business_name", F.when(F.col("ord") % 10 != 3, F.col("business_address")), "country", F.when(F.col("ord") % 10 == 7, F.lit("more"))]
    lines = A.raw_records(spark, d).select("ord", F.concat_ws("\t", *fields).alias("line"))
    head = spark.createDataFrame([(-1, "\t".join(T.SOURCE))], "ord long, line string")
    folder = scratch_folder(spark, "broken") + "/rows"
    head.unionByName(lines).coalesce(1).sortWithinPartitions("ord").select("line").write.text(folder)
    return T.broken_rows(spark, folder, T.SOURCE)


def _three_files(spark: SparkSession, d: str) -> str:
    rows, folder = A.raw_records(spark, d), scratch_folder(spark, "sources")
    for k in (1, 2, 3):
        T.write_tsv(rows.filter(f"source = 'S{k}'").select(T.SOURCE), f"{folder}/train/source{k}.tsv")
    return folder


def sources_read(spark: SparkSession, d: str) -> DataFrame:
    s1, s2, s3 = T.read_sources(spark, _three_files(spark, d), "train")
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(s1, "s1").unionByName(side(T.targets(s2, s3), "target"))


def truth_file(spark: SparkSession, d: str) -> DataFrame:
    """Ids are written twice, with blanks between; singletons have an empty list."""
    rows = A.records(spark, d)
    truth, s1 = A.truth(rows), A.s1(rows).select("s1")
    ids = F.array_join(F.array_sort(F.collect_list("id")), ",")
    lists = s1.join(truth.groupBy("s1").agg(ids.alias("ids")), "s1", "left")
    folder = scratch_folder(spark, "truth") + "/rows"
    again = F.when(F.col("ids").isNotNull(), F.concat("ids", F.lit(",, "), "ids"))
    T.write_tsv(lists.select(F.col("s1").alias(T.TRUTH[0]), F.coalesce(again, F.lit("")).alias(T.TRUTH[1])), folder)
    return T.read_truth(spark, folder).select("s1", F.array_join(F.array_sort("ids"), "~").alias("ids"))


def ids_file(spark: SparkSession, d: str) -> DataFrame:
    """S1 records whose ids, those with a true link, a JSON file lists."""
    rows = A.records(spark, d)
    listed = A.truth(rows).select("s1").distinct().agg(F.to_json(F.struct(F.array_sort(F.collect_list("s1")).alias("ids"))).alias("value"))
    folder = scratch_folder(spark, "ids") + "/ids"
    listed.write.text(folder)
    return T.only_ids(rows.filter("source = 'S1'"), T.read_ids(spark, folder)).select("entity_id", "business_name")


def result_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = A.records(spark, d)
    s1, t = A.s1(rows), A.targets(rows)
    lists = T.id_lists(s1.withColumnRenamed("s1", "entity_id"), R.exact_matches(s1, t).withColumn("rank", F.col("id")))
    folder = scratch_folder(spark, "lists") + "/lists"
    T.write_lists(lists, folder)
    return T.read_lists(spark, folder).select("s1", F.array_join("ids", "~").alias("ids"))


def fetch_records(spark: SparkSession, d: str) -> DataFrame:
    rows = A.records(spark, d)
    return T.fetch_records(A.truth(rows).select("id").distinct(), rows, strict=True).select("entity_id", "business_name")


def _results(spark: SparkSession, d: str) -> DataFrame:
    rows = A.records(spark, d)
    s1, t = A.s1(rows), A.targets(rows)
    lists = lambda links, name: links.groupBy("s1").agg(F.array_sort(F.collect_list("id")).alias(name))
    none = F.array().cast("array<string>")
    out = s1.select("s1", "country", (F.col("ord") % 6).cast("int").alias("shard")).join(lists(R.exact_matches(s1, t), "matches"), "s1", "left")
    out = out.join(lists(A.truth(rows), "cands"), "s1", "left")
    return out.select("shard", "s1", "country", F.coalesce("matches", none).alias("matches"), F.coalesce("cands", none).alias("cands"))


def shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards written in two parts, one of them then by another run; counts by country, and whether the first run can use a shard again."""
    folder = scratch_folder(spark, "shards")
    results, run = checkpointed(_results(spark, d)), V.run_hash({"policy": "exact"})
    T.write_shards(results.filter("shard < 3"), folder, run)
    T.write_shards(results.filter("shard >= 3"), folder, run)
    T.write_shards(results.filter("shard = 4"), folder, V.run_hash({"policy": "another"}))
    again = T.reusable_shards(spark, folder, run, results.schema).withColumn("reusable", F.lit(1))
    counts = spark.read.parquet(f"{folder}/by_country").withColumn("shard", F.col("shard").cast("int"))
    return counts.join(again.withColumn("shard", F.col("shard").cast("int")), "shard", "left").na.fill(0, ["reusable"])


def verified_merge(spark: SparkSession, d: str) -> DataFrame:
    rows, results = A.records(spark, d), checkpointed(_results(spark, d))
    s1 = A.s1(rows)
    matches = results.select("s1", F.array_intersect("matches", "cands").alias("ids"))
    return V.verified_merge(matches, results.select("s1", F.col("cands").alias("ids")), s1).select("s1", F.array_join("ids", "~").alias("ids"), "ord")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    rows, folder = A.records(spark, d), scratch_folder(spark, "ledger") + "/rows"
    for name, n in (("s1", A.s1(rows).count()), ("targets", A.targets(rows).count())):
        T.append_ledger(spark, folder, {"experiment_id": name, "notes": 'a "quoted" note', "avg_candidates": n, "unknown": 1})
    return T.read_ledger(spark, folder).select("experiment_id", "avg_candidates", "notes", "fold")


def model_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and whether a matcher that was saved and loaded gives the probability that it gave before."""
    from linkforge.plans import queries as P

    names, rows = P.MODEL_FEATURES, P.labelled_pairs(spark, d)
    folder = scratch_folder(spark, "bundle")
    model = D.train_sgd(SP.sample_negatives(rows, 3, 8), names, epochs=5)
    D.save_bundle(spark, model, folder, {"variant": "v1", "cap": 50, "threshold": 0.5})
    loaded, _ = D.load_bundle(spark, folder, variant="v1", cap=50, features=names)
    before, after = D.probabilities(model, rows), D.probabilities(loaded, rows)
    both = before.select("s1", "id", "label", F.col("prob").alias("was")).join(after.select("s1", "id", "prob"), ["s1", "id"])
    return both.select("s1", "id", F.col("label").cast("long").alias("label"), ((F.col("was") == F.col("prob")) & F.col("prob").between(0, 1)).cast("int").alias("same"))


def streamed_links(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of S1 records that arrive as a stream of files, against static postings."""
    rows, folder = A.records(spark, d, "v1"), scratch_folder(spark, "stream")
    raw = A.raw_records(spark, d).filter("source = 'S1'")
    raw.repartition(3).write.parquet(f"{folder}/in")
    targets, v = checkpointed(A.targets(rows)), R.VARIANTS["v1"]
    postings = checkpointed(R.build_postings(targets, v))
    kept = checkpointed(R.limit_postings(postings, v))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def sink(cands: DataFrame, batch_id: int) -> None:
        cands.select("s1", "id", "score", F.col("rank").cast("long").alias("rank")).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    ST.link_stream(stream, targets, postings, kept, v, sink, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def assessment(spark: SparkSession, d: str) -> DataFrame:
    """The exact matcher, assessed once on the frozen slice of all S1."""
    rows = A.records(spark, d)
    s1, t, truth = A.s1(rows), A.targets(rows), A.truth(rows)
    ids = s1.select("s1")
    cands = R.candidates(A.s1(A.records(spark, d, "v1")), A.targets(A.records(spark, d, "v1")), R.VARIANTS["v1"])
    out = E.assess(s1, truth, cands, R.exact_matches(s1, t), t.count(), ids, SP.id_digest(ids).first()["digest"])
    return out.select("n", F.round("macro_f05", 6).alias("macro_f05"), "tp", "fp", "fn", "true_matches_total", "true_matches_retrieved")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (tsv_round_trip, tsv_order, tsv_broken, sources_read, truth_file, ids_file, result_lists, fetch_records, shards, verified_merge, ledger, model_bundle, streamed_links, assessment)
}

_EXPR = ", ".join(f"{e} AS {k}" for k, e in TRICKY.items())
_IDS = "coalesce(array_to_string(list_sort(list({0})), '~'), '')"
_RESULTS = f"""{Q.LINKS}, m AS (SELECT s1, list(id) AS matches FROM links GROUP BY s1), cd AS (SELECT s1, list(id) AS cands FROM truth GROUP BY s1),
res AS (SELECT s.ord, (s.ord % 6)::int AS shard, s.s1, s.country, coalesce(matches, []) AS matches, coalesce(cands, []) AS cands FROM s LEFT JOIN m USING (s1) LEFT JOIN cd USING (s1))"""
ORACLE_SQL: dict[str, str] = {
    "tsv_round_trip": Q.with_(Q.BASE, f"SELECT {_EXPR} FROM r0"),
    "tsv_order": Q.with_(Q.BASE, "SELECT entity_id, row_number() OVER (ORDER BY ord) - 1 AS ord FROM r0"),
    "tsv_broken": Q.with_(Q.BASE, "SELECT entity_id || chr(9) || business_name || CASE WHEN ord % 10 = 3 THEN '' ELSE chr(9) || business_address END || chr(9) || country || CASE WHEN ord % 10 = 7 THEN chr(9) || 'more' ELSE '' END AS line, (2 + (country <> '')::int + (business_address <> '' AND ord % 10 = 7)::int)::int AS fields FROM r0 WHERE ord % 10 IN (3, 7)"),
    "sources_read": Q.with_(Q.BASE, "SELECT entity_id, business_name, business_address, country, CASE WHEN source = 'S1' THEN 's1' ELSE 'target' END AS side FROM r0"),
    "truth_file": Q.with_(Q.BASE, f"SELECT s.s1, {_IDS.format('truth.id')} AS ids FROM s LEFT JOIN truth USING (s1) GROUP BY s.s1"),
    "ids_file": Q.with_(Q.BASE, "SELECT entity_id, business_name FROM s WHERE s1 IN (SELECT s1 FROM truth)"),
    "result_lists": Q.with_(Q.LINKS, f"SELECT s.s1, {_IDS.format('links.id')} AS ids FROM s LEFT JOIN links USING (s1) GROUP BY s.s1"),
    "fetch_records": Q.with_(Q.BASE, "SELECT entity_id, business_name FROM t WHERE id IN (SELECT id FROM truth)"),
    "shards": Q.with_(_RESULTS, "SELECT shard, country, count(*) AS n_s1, sum(len(matches))::bigint AS links, sum((len(matches) = 0)::int)::bigint AS empty_pred, sum(len(cands))::bigint AS cands, sum((len(cands) = 0)::int)::bigint AS zero_cand, (shard <> 4)::int AS reusable FROM res GROUP BY shard, country"),
    "verified_merge": Q.with_(_RESULTS, "SELECT s1, coalesce(array_to_string(list_sort(list_intersect(matches, cands)), '~'), '') AS ids, ord FROM res"),
    "ledger": Q.with_(Q.BASE, """SELECT 's1' AS experiment_id, (SELECT count(*) FROM s)::varchar AS avg_candidates, 'a "quoted" note' AS notes, '' AS fold UNION ALL SELECT 'targets', (SELECT count(*) FROM t)::varchar, 'a "quoted" note', ''"""),
    "model_bundle": Q.with_(Q.PAIRS, "SELECT sc.s1, sc.id, count(truth.s1) AS label, 1 AS same FROM sc LEFT JOIN truth USING (s1, id) GROUP BY sc.s1, sc.id"),
    "streamed_links": Q.with_(Q.V1, "SELECT s1, id, score, rank FROM c"),
    "assessment": Q.with_(f"{Q.ENTITY_V1}, hh AS (SELECT count(*) AS n, count(c.id) AS got FROM truth LEFT JOIN c USING (s1, id))", "SELECT count(*) AS n, round(avg(f05), 6) AS macro_f05, sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn, any_value(hh.n) AS true_matches_total, any_value(got) AS true_matches_retrieved FROM f, hh"),
}
