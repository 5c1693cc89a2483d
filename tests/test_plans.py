"""Queries against their SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from linkforge.operators import features as FT
from linkforge.operators import retrieve as R
from linkforge.plans import files
from linkforge.plans import queries as P

QUERIES, SQL = P.QUERIES | files.QUERIES, P.ORACLE_SQL | files.ORACLE_SQL
CHECKED = sorted(SQL)


def _rows(frame, cols):
    return sorted(tuple("" if v is None or v != v else round(float(v), 9) if isinstance(v, int | float) or hasattr(v, "dtype") else v for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("part", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(SQL[name]).fetchdf()
    got = QUERIES[name](spark, sf).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert _rows(got, cols) == _rows(want, cols)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_lists_each_s1_once(spark, sf):
    out = P.flagship(spark, sf)
    assert out.count() == out.select("source1_entity_id").distinct().count() > 0


def test_unicode_norm_reads_whole_texts(spark, tmp_path):
    rows = [(1, "Café " * 40 + "Straße", "de"), (2, "x" * 100 + " क्षेत्र", "hi"), (3, "7 " * 60, None), (4, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["entity_id"]: (r["name_norm"], r["script"]) for r in P.unicode_norm(spark, str(tmp_path)).collect()}
    assert got["1"] == ("cafe " * 40 + "strasse", "latin")
    assert got["2"][0].startswith("x" * 100 + " ") and got["2"][1] == "non_latin"
    assert got["3"] == (("7 " * 60).strip(), "no_letters") and got["4"] == ("", "no_letters")


def test_fuzz_features_keep_the_variants_cap(spark, sf):
    got, cap = P.fuzz_features(spark, sf), R.VARIANTS["v4all"].cap
    want = {(r["s1"], r["id"]) for r in P.QUERIES["cands_v4all"](spark, sf).collect()}
    rows = got.select("s1", "id", "n_cands").collect()
    assert {(r["s1"], r["id"]) for r in rows} == want and len(rows) == len(want)
    many = Counter(r["s1"] for r in rows)
    assert max(many.values()) > 20 and all(round(r["n_cands"] * FT.CAP) == many[r["s1"]] for r in rows) and cap == FT.CAP


def test_tfidf_knn_equals_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 20)
    monkeypatch.setattr(R, "TARGET_BLOCK", 30)
    s1, t, _ = P._sides(spark, sf)

    def grams(r):
        out = Counter()
        for w in f"{r['name_norm']} {r['addr_norm']}".split():
            for n in (3, 4, 5):
                if len(w) + 2 >= n:
                    out.update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
        return out

    texts = {r["id"]: grams(r) for r in t.collect()}
    df = Counter(g for x in texts.values() for g in x)

    def unit(x):
        w = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in x.items() if g in df}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {g: v / norm for g, v in w.items()}

    vectors = {k: unit(x) for k, x in texts.items()}
    want = {}
    for r in s1.collect():
        q = unit(grams(r))
        near = sorted((-round(sum(v * x.get(g, 0) for g, v in q.items()), 9), k) for k, x in vectors.items())
        want[r["s1"]] = [(k, -d) for d, k in near[:20] if d]
    got = {}
    for r in P.tfidf(spark, sf).orderBy("s1", "rank").collect():
        got.setdefault(r["s1"], []).append((r["id"], r["similarity"]))
    assert max(map(len, got.values())) == 20
    assert {k: [i for i, _ in x] for k, x in got.items()} == {k: [i for i, _ in x] for k, x in want.items()}
    assert all(abs(a - b) < 1e-6 for k in want for (_, a), (_, b) in zip(got[k], want[k], strict=True))


def test_variant_b_adds_tfidf_neighbours(spark):
    cols = "s1 string, source string, ord long, name_norm string, addr_norm string, country_key string"
    s1 = spark.createDataFrame([("S1-1", "S1", 1, "brandon bakery", "", "us")], cols)
    rows = [("S2-1", "S2", 1, "grandon bakerey", "", "us"), ("S2-2", "S2", 2, "brandon bakery", "", "us"), ("S2-3", "S2", 3, "grandon bakerey", "", "france"), ("S2-4", "S2", 4, "zzz", "", "us")]
    t = spark.createDataFrame(rows, cols.replace("s1 ", "id ", 1))
    got = {r["id"]: r for r in R.candidates(s1, t, R.VARIANTS["b"]).collect()}
    near = {r["id"]: r["similarity"] for r in R.tfidf_knn(s1, t).collect()}
    assert set(got) == {"S2-1", "S2-2", "S2-3"} and got["S2-1"]["routes"] == ["tfidf"]
    assert got["S2-1"]["score"] == pytest.approx(2 * near["S2-1"]) and got["S2-3"]["score"] == pytest.approx(near["S2-3"])
    # name 5, prefix 1, two tokens of bucket 1 at 2 / (1 + 1 / 40), and the neighbour.
    assert got["S2-2"]["score"] == pytest.approx(6 + 4 / (1 + 1 / 40) + 2 * near["S2-2"]) and near["S2-2"] == pytest.approx(1)


def test_model_queries_label_without_all_links_and_train_without_collecting(spark, sf, monkeypatch):
    want = {(r["s1"], r["id"]) for r in P.A.truth(P.A.records(spark, sf)).collect()}
    rows = P.labelled_pairs(spark, sf)
    assert rows.columns == ["s1", "id", "label", *P.MODEL_FEATURES]
    assert all(r["label"] == ((r["s1"], r["id"]) in want) for r in rows.collect())
    # The training rows are never one frame.
    monkeypatch.setattr(type(rows), "toPandas", None)
    assert files.model_bundle(spark, sf).agg({"same": "min"}).first()[0] == 1


def test_tfidf_search_prunes_exactly_and_keeps_ties(spark, monkeypatch):
    cols = "s1 string, name_norm string, addr_norm string"
    t = [(f"S2-{n:03d}", f"{a} {b}", c) for n, (a, b, c) in enumerate([("red", "bolt", "")] * 40 + [(x, y, z) for x in ("red", "blue", "bold") for y in ("bolt", "ring") for z in ("", "12 oak st", "13 oak rd")])]
    s = [(f"S1-{n}", *x[1:]) for n, x in enumerate(t[38:])] + [("S1-x", "", ""), ("S1-y", "qqq", "")]
    s1, targets = spark.createDataFrame(s, cols), spark.createDataFrame(t, cols.replace("s1", "id", 1))
    get = lambda: sorted(map(tuple, R.tfidf_knn(s1, targets, 5).select("s1", "rank", "id", "similarity").collect()))
    want = get()
    monkeypatch.setattr(R, "MOST_CELLS", 1)
    monkeypatch.setattr(R, "PRODUCT_BYTES", 1)
    monkeypatch.setattr(R, "LEAST_BLOCK", 3)
    assert get() == want
    assert [r[2] for r in want if r[0] == "S1-0"] == [f"S2-{n:03d}" for n in range(5)] and not [r for r in want if r[0] in ("S1-x", "S1-y")]


def test_matchers_train_on_stored_rows(spark, sf):
    plans = []

    def train(rows, names):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return P.D.Logistic(tuple(names), (0.5,) * len(names), 0.0)

    got = P._model(train)(spark, sf)
    # Passes read columns: no retrieval, join or ranking is repeated.
    assert plans[0].strip().startswith("Relation") and "\n" not in plans[0].strip() and got.count() > 0


def test_pairs_show_forms_and_measures_in_few_rows_at_a_time(spark, sf, monkeypatch):
    monkeypatch.setattr(R, "CELLS", 50)
    monkeypatch.setattr(R, "LEAST_PLACE", 5)
    monkeypatch.setattr(R, "PLACE", 5)
    s1, t, _ = P._sides(spark, sf, "b")
    got = P._pairs(spark, sf, "v1", "b", FT.EDITS_B)
    want = FT._measured(FT.pairs(P._found(spark, sf).drop("routes", "score"), s1, t), FT.EDITS_B)
    rows = lambda df: sorted(map(tuple, df.select(sorted(want.columns)).collect()))
    assert rows(got) == rows(want)
    # Pairs aren't exchanged once they have arisen.
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]


def test_fuzz_features_arise_with_pairs_and_equal_those_of_windows(spark, sf, monkeypatch):
    monkeypatch.setattr(R, "CELLS", 50)
    monkeypatch.setattr(R, "ROWS", 7)
    got = P.fuzz_features(spark, sf)
    # Nothing stands above the places: no window, join or further exchange of pairs.
    above = got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert not any(x in above for x in ("Window", "Join", "Aggregate", "Repartition"))
    cols = "s1 string, source string, ord long, name_norm string, addr_norm string, country_key string"
    names = ["red bolt limited", "red bolt", "bolt red red", "ab", "", "the blue company limited", "blue ring works of the north " * 4]
    addrs = ["", "100 oak road 10035", "100 oak road 20042", "  ", "12 oak street", "100 100 oak 12345 \u0661\u0662\u0663", "oak road " * 20 + "77777"]
    rows = [(f"{k % 3 + 1}-{k:03d}", k % 3 + 1, k, names[k % 7], addrs[k // 7 % 7], ("", "us", "france")[k % 5 % 3]) for k in range(147)]
    s1 = spark.createDataFrame([(f"S{x[0]}", f"S{x[1]}", *x[2:]) for x in rows if x[1] == 1], cols)
    t = spark.createDataFrame([(f"S{x[0]}", f"S{x[1]}", *x[2:]) for x in rows if x[1] > 1], cols.replace("s1 ", "id ", 1))
    v = R.VARIANTS["v4all"]
    want = P._features(FT.features_43(R.candidates(s1, t, v, records=(s1, t))), FT.FEATURES_43).collect()
    told = R.candidates(s1, t, v, records=(s1, t), tell=(FT.FEATURES_43, FT.told_43))
    assert told.columns == ["s1", "id", *FT.FEATURES_43] and len(want) > 1000
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want))


def test_floats_are_rounded_as_decimals(spark):
    import numpy as np

    x = np.concatenate([np.random.default_rng(1).random(2000) * 3 - 1, np.arange(-300, 300) / 128, [1e-7, -1e-7, 5e-7, 0.0, 1 / 3]]).astype(np.float32)
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").selectExpr("round(x, 6)").collect()]
    got = R.rounded(x).tolist()
    assert got == want and not any(math.copysign(1, v) < 0 for v in got if v == 0)


def test_gate_brings_only_pairs_above_the_threshold_together(spark):
    rows = [("a", "x", 0.9), ("a", "y", 0.5), ("a", "z", 0.85), ("b", "x", 0.55), ("b", "y", 0.2), ("c", "x", 0.65), ("c", "y", 0.6)]
    df = spark.createDataFrame(rows, "s1 string, id string, prob double")
    got = P.D.gate_relative(df, 0.6, 0.7, 0.9)
    assert {(r["s1"], r["id"]) for r in got.collect()} == {("a", "x"), ("a", "z")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("prob") > plan.index("Window") and "Filter" in plan.split("Window")[-1]
