import pytest
from pyspark.sql import functions as F

from linkforge.operators import decide as D
from linkforge.operators import evaluate as E
from linkforge.operators import index as I
from linkforge.operators import retrieve as R
from linkforge.operators import split as SP
from linkforge.operators import validate as V
from linkforge.operators.graph import min_label_components
from linkforge.sources import tables as T


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "s1 string, id string")


def test_f05_edges(spark):
    s1 = spark.createDataFrame([(x,) for x in "abcdef"], "s1 string")
    truth = _pairs(spark, [("c", "x"), ("d", "x"), ("e", "x"), ("f", "x"), ("f", "y")])
    links = _pairs(spark, [("b", "x"), ("c", "x"), ("e", "x"), ("e", "y"), ("f", "x")])
    got = {r["s1"]: round(r["f05"], 6) for r in E.per_entity(s1, truth, links).collect()}
    assert got == {"a": 1, "b": 0, "c": 1, "d": 0, "e": round(5 / 9, 6), "f": round(5 / 6, 6)}
    with pytest.raises(ValueError):
        E.check_keys(s1, s1.filter("s1 <> 'a'"))


def test_balanced_limit_matches_the_rule(spark):
    for n2, n3 in [(79, 0), (80, 80), (0, 160), (160, 1), (40, 41), (30, 100)]:
        rows = [("num", "k", f"S2-{i:04}", "S2", i) for i in range(n2)] + [("num", "k", f"S3-{i:04}", "S3", i) for i in range(n3)]
        df = spark.createDataFrame(rows, "route string, key string, id string, source string, ord long")
        got = {r["source"]: r["count"] for r in I.limit_balanced(df, {"num": 80}).groupBy("source").count().collect()}
        a, b = min(n2, 80), min(n3, 80)
        keep3 = b if a + b <= 80 else min(b, max(40, 80 - a))
        keep2 = a if a + b <= 80 else 80 - keep3
        assert (got.get("S2", 0), got.get("S3", 0)) == (keep2, keep3)


def test_accept_at_its_edges(spark):
    names = ["prob", "name_token_sort", "name_jaccard", "name_exact", "addr_token_sort", "num_overlap", "name_addr_conflict", "name_partial"]
    rows = [(0.5, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0), (0.49, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0), (0.9, 0.95, 0.0, 1.0, 0.2, 0.0, 1.0, 0.0), (0.9, 0.95, 0.0, 1.0, 0.2, 0.1, 1.0, 0.0), (0.98, 0.8, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, names)
    assert [r[0] for r in df.select(D.accept(F.col("prob"), 0.5)).collect()] == [True, False, False, True, True]


def test_components_of_a_chain_and_a_hub(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)], "src long, dst long")
    got = {r["node"]: r["component"] for r in min_label_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100 + i: 100 for i in range(1, 50)}


def test_split_keeps_components_whole(spark):
    s1 = spark.createDataFrame([(f"S1-{i}",) for i in range(200)], "s1 string")
    truth = _pairs(spark, [(f"S1-{i}", f"S2-{i // 4}") for i in range(150)])
    members = SP.components(s1, truth)
    folds = SP.component_split(members, {"fit": 0.7, "select": 0.15, "assess": 0.15})
    assert SP.leaks(folds).count() == 0 and folds.count() == 200
    assert 120 <= folds.filter("fold = 'fit'").count() <= 160
    used = folds.filter("fold = 'fit'").select("s1")
    fresh = SP.fresh_slice(folds, used, 10)
    assert fresh.count() >= 10 and fresh.join(used, "s1").count() == 0


def test_validation_findings(spark):
    s1 = spark.createDataFrame([("S1-a",), ("S1-b",)], "s1 string")
    t = spark.createDataFrame([("S2-1",)], "id string")
    lists = spark.createDataFrame([("S1-a", ["S2-1", "S2-1", "S1-a", "X-1", "S3-9"]), ("S1-c", [])], "s1 string, ids array<string>")
    got = {(r["rule"], r["id"]) for r in V.validate_lists(lists, s1, t).collect()}
    assert got == {("missing_s1", None), ("unexpected_s1", None), ("duplicate_id", "S2-1"), ("self_match", "S1-a"), ("bad_prefix", "X-1"), ("unknown_id", "X-1"), ("unknown_id", "S3-9")}


def test_audit_golden(spark):
    truth = _pairs(spark, [("S1-a", "S2-a"), ("S1-a", "S3-a")])
    s1 = spark.createDataFrame([("S1-a",), ("S1-b",)], "s1 string")
    r = E.truth_report(s1, truth).first()
    assert (r["records"], r["links"], r["singleton_rate"], r["empty_baseline"]) == (2, 2, 0.5, 0.5)
    rows = spark.createDataFrame([("S1-a", ["S2-a"]), ("S1-a", [])], "s1 string, ids array<string>")
    with pytest.raises(ValueError, match="repeated S1"):
        V.require_unique_truth(rows)


def test_tsv_round_trip(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A ""B"" Co"\t\tUS\n')
    assert list(T.read_tsv(spark, str(p), T.SOURCE).first()) == ["S1-1", 'A "B" Co', "", "US"]
    with pytest.raises(T.BadHeader):
        T.read_tsv(spark, str(p), T.TRUTH)
    s1 = spark.createDataFrame([("S1-2", 0), ("S1-1", 1)], "entity_id string, ord long")
    links = spark.createDataFrame([("S1-1", "S2-9", 1), ("S1-1", "S2-1", 2), ("S1-1", "S2-9", 3)], "s1 string, id string, rank int")
    T.write_lists(T.id_lists(s1, links), str(tmp_path / "out"))
    got = {r["s1"]: r["ids"] for r in T.read_lists(spark, str(tmp_path / "out")).collect()}
    assert got == {"S1-2": [], "S1-1": ["S2-9", "S2-1"]}


def test_strict_rows_fail_whatever_is_asked_for(spark, tmp_path):
    p = tmp_path / "x.tsv"
    head = "\t".join(T.SOURCE)
    for bad in ("S1-2\tname\taddress", "S1-2\tname\taddress\tUS\tmore"):
        p.write_text(f"{head}\nS1-1\ta\tb\tc\n{bad}\n")
        assert T.read_tsv(spark, str(p), T.SOURCE).count() == 2
        for read in (lambda df: df.count(), lambda df: df.select("entity_id").collect()):
            with pytest.raises(Exception, match="MALFORMED"):
                read(T.read_tsv(spark, str(p), T.SOURCE, strict=True))


def test_order_of_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.tsv").write_text("\t".join(T.SOURCE) + "\n" + "".join(f"S1-{k}{i}\ta\tb\tc\n" for i in range((k + 1) * 4)))
    rows = T.with_order(T.read_tsv(spark, str(tmp_path), T.SOURCE)).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(24)) and [r["entity_id"] for r in rows] == [f"S1-{k}{i}" for k in range(3) for i in range((k + 1) * 4)]


def test_shards_resume_after_a_lost_one(spark, tmp_path):
    schema = "shard int, s1 string, country string, matches array<string>, cands array<string>"
    rows = [(i % 3, f"S1-{i}", "US", [f"S2-{i}"], [f"S2-{i}", "S3-1"]) for i in range(12)]
    df, path = spark.createDataFrame(rows, schema), str(tmp_path / "shards")
    for k in range(3):
        T.write_shards(df.filter(F.col("shard") == k), path, "run")
    ready = lambda run="run": sorted(r["shard"] for r in T.reusable_shards(spark, path, run, df.schema).collect())
    assert ready() == [0, 1, 2] and ready("another") == []
    lost = next((tmp_path / "shards/results/shard=1").glob("*.parquet"))
    lost.unlink()
    assert ready() == [0, 2]
    T.write_shards(df.filter("shard = 1"), path, "run")
    assert ready() == [0, 1, 2] and spark.read.parquet(f"{path}/results").count() == 12


def test_dataset_must_be_the_manifests(spark, tmp_path):
    good = tmp_path / "data"
    good.mkdir()
    (good / "a.tsv").write_text("x\ty\n1\t2\n")
    facts = V.file_digests(spark, str(good / "a.tsv")).first()
    manifest = {"a.tsv": {"header": ["x", "y"], "bytes": facts["length"], "sha256": facts["sha256"]}}
    V.require_dataset(spark, str(good), manifest, banned=("synthetic",), root=str(tmp_path))
    for wrong in ({"header": ["x"]}, {"bytes": 1}, {"sha256": "0"}):
        with pytest.raises(V.Provenance):
            V.require_dataset(spark, str(good), {"a.tsv": wrong}, banned=("synthetic",))
    for folder, root in ((str(tmp_path / "synthetic_x"), None), (str(good), "/elsewhere"), (f"{good}/../data", None)):
        with pytest.raises(V.Provenance):
            V.require_dataset(spark, folder, {}, root=root)


def test_slice_digest_and_assessment(spark):
    import hashlib

    ids = spark.createDataFrame([("S1-b",), ("S1-a",)], "s1 string")
    assert SP.id_digest(ids).first()["digest"] == hashlib.sha256(b"S1-a\nS1-b").hexdigest()
    truth, s1 = _pairs(spark, [("S1-a", "S2-1")]), ids.unionByName(spark.createDataFrame([("S1-c",)], "s1 string"))
    row = E.assess(s1, truth, truth, truth, 5, ids, SP.id_digest(ids).first()["digest"]).first()
    assert (row["n"], row["macro_f05"], row["true_matches_retrieved"]) == (2, 1.0, 1)
    with pytest.raises(ValueError, match="digest"):
        E.assess(s1, truth, truth, truth, 5, ids, "x")


def test_exact_matches_of_a_frequent_name(spark):
    """A chain's name pairs only what shares an address, or a country where one address is missing."""
    cols = "name_norm string, addr_norm string, country_key string, source string, ord long"
    rows = [("chain", f"{i} road", "us", "S2", i) for i in range(200)] + [("chain", "", "us", "S3", 1), ("chain", "", "", "S3", 2), ("", "x", "us", "S3", 3)]
    t = spark.createDataFrame([(f"T{k}", *r) for k, r in enumerate(rows)], f"id string, {cols}")
    s1 = spark.createDataFrame([("a", "chain", "7 road", "us", "S1", 0), ("b", "chain", "", "us", "S1", 1), ("c", "", "x", "us", "S1", 2)], f"s1 string, {cols}")
    got = {(r["s1"], r["id"]) for r in R.exact_matches(s1, t).collect()}
    assert got == {("a", "T7"), ("a", "T200")} | {("b", f"T{k}") for k in range(201)}
    assert {r["id"] for r in R.exact_matches(s1, t, 5).collect()} == {f"T{k}" for k in range(5)}


def test_models_learn_and_are_saved(spark, tmp_path):
    rows = [(f"S1-{i}", f"S2-{i}", (i % 10) / 10, (i * 7 % 10) / 10, int(i % 10 >= 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "s1 string, id string, x double, y double, label int")
    for train in (lambda d, f: D.train_sgd(d, f, epochs=200, batch=16, rate=0.5), D.train_logistic, lambda d, f: D.train_trees(d, f, trees=5, depth=2)):
        model = train(df, ["x", "y"])
        D.save_bundle(spark, model, str(tmp_path / "b"), {"variant": "v1", "features": ["x", "y"]})
        loaded, facts = D.load_bundle(spark, str(tmp_path / "b"), variant="v1", features=["x", "y"])
        got = D.probabilities(loaded, df).select("label", "prob").collect()
        assert sum((r["prob"] >= 0.5) == bool(r["label"]) for r in got) >= 0.95 * len(got)
        assert [r["prob"] for r in D.probabilities(model, df).collect()] == [r["prob"] for r in got]
    with pytest.raises(D.BadBundle, match="variant"):
        D.load_bundle(spark, str(tmp_path / "b"), variant="v2")


def test_bootstrap_against_resampling(spark):
    import numpy as np

    d = np.random.default_rng(1).choice([-0.5, 0.0, 0.0, 0.25], 400)
    got = E.paired_bootstrap(spark.createDataFrame([(float(x),) for x in d], "delta double"), 2000)
    lot = np.random.default_rng(2)
    means = [d[lot.integers(0, 400, 400)].mean() for _ in range(2000)]
    assert abs(got["low"] - np.quantile(means, 0.025)) < 0.01 and abs(got["high"] - np.quantile(means, 0.975)) < 0.01
    assert got["mean"] == pytest.approx(d.mean()) and (got["better"], got["worse"]) == (int((d > 0).sum()), int((d < 0).sum()))


def test_bootstrap_of_a_constant(spark):
    got = E.paired_bootstrap(spark.createDataFrame([(0.5,)] * 20, "delta double"), 50)
    assert got["mean"] == got["low"] == got["high"] == 0.5 and got["better"] == 20


def test_slices_by_target_script(spark):
    s1 = spark.createDataFrame([("S1-a", "US", "a")], "s1 string, country string, name_norm string")
    names = [("S2-1", "Acme"), ("S2-2", "Acme क्षेत्र"), ("S3-3", "12 34"), ("S3-4", "Café")]
    t = spark.createDataFrame([(i, n, "a") for i, n in names], "id string, business_name string, name_norm string")
    truth = _pairs(spark, [("S1-a", i) for i, _ in names] + [("S1-a", "S3-gone")])
    cands = _pairs(spark, [("S1-a", "S2-1"), ("S1-a", "S2-2")])
    got = {r["bucket"]: (r["truth_links"], r["retrieved"], r["recall"]) for r in E.slices(truth, cands, s1, t).collect() if r["dim"] == "target_script"}
    assert got == {"latin": (2, 1, 0.5), "non_latin": (1, 1, 1.0), "no_letters": (2, 0, 0.0)}


def test_sequential_matcher_takes_all_rows_from_a_file(spark, monkeypatch):
    import numpy as np

    rows = [(f"S1-{i}", f"S2-{i}", (i % 10) / 10, (i * 7 % 10) / 10, int(i % 10 >= 6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "s1 string, id string, x double, y double, label int").repartition(5)
    held = df.orderBy(SP.draw("s1", "id"), "s1", "id").toPandas()
    monkeypatch.setattr(D, "PIECE", 3)
    # Nothing brings the whole table into the driver's memory.
    monkeypatch.setattr(type(df), "toPandas", None)
    monkeypatch.setattr(type(df), "collect", None)
    with D.training_rows(df, ["x", "y"]) as (x, at):
        assert isinstance(x, np.memmap) and np.array_equal(x[at], held[["x", "y", "label"]].to_numpy(float))
    got, lot = D.train_sgd(df, ["x", "y"], epochs=3), np.random.default_rng(42)
    x, y = held[["x", "y"]].to_numpy(float), held["label"].to_numpy(float)
    w, b = lot.normal(0, 0.01, 2), 0.0
    for _ in range(3):
        at = lot.permutation(len(y))
        for begin in range(0, len(y), 256):
            k = at[begin : begin + 256]
            off = 1 / (1 + np.exp(-np.clip(x[k] @ w + b, -500, 500))) - y[k]
            w, b = w - 0.05 * (off @ x[k]) / len(k), b - 0.05 * off.mean()
    assert got.weights == pytest.approx(tuple(w), abs=1e-12) and got.bias == pytest.approx(b, abs=1e-12)


def test_miss_counts_tell_the_same_as_each_link(spark, monkeypatch):
    """Blocks of few rows, against a row for each link: all categories that targets can have, a null key, an S1 without keys."""
    monkeypatch.setattr(E, "MISS_TARGETS", 3)
    monkeypatch.setattr(E, "MISS_S1", 2)
    s1 = spark.createDataFrame([(f"S1-{n}", f"k{n % 3}" if n < 9 else None) for n in range(10)], "s1 string, truth_key string")
    t = spark.createDataFrame([(f"S{2 + n % 2}-{n:02d}", f"k{n % 4}") for n in range(40)], "id string, truth_key string")
    truth = s1.join(t, "truth_key").select("s1", "id")
    every = spark.createDataFrame([(f"S1-{n}", "token", f"w{(n + x) % 5}") for n in range(1, 10) for x in (0, 1)], "s1 string, route string, key string")
    postings = spark.createDataFrame([(f"S{2 + n % 2}-{n:02d}", "token", f"w{n % 5}") for n in range(40)], "id string, route string, key string")
    queried = every.filter("key <> 'w2'")
    pool = truth.filter("substring(id, 4, 2) % 3 = 0").withColumn("rank", F.expr("cast(substring(id, 4, 2) as int)"))
    cands = pool.filter("rank <= 12")
    want = E.miss_report(s1, truth, cands, E.miss_attribution(truth, cands, pool, t, postings, every, queried))
    got = E.miss_summary(10, E.miss_counts(s1, t, pool, 12, postings, every, queried))
    rows = lambda df: sorted((r["category"], r["misses"], r["s2"], r["s3"], round(r["oracle_gain"], 9)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(want)) == 4
