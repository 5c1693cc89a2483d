"""Operators on Spark: small hostile tables, SQL, brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from linkforge.llm import ann, bpe, chat, html_extract, iblt, language, mixing, queries, sharding, simhash, warc
from linkforge.operators.graph import min_label_components  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size string"
LONG = "word salad tossed " * 20000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again", "en", "b", 1, "x", "y"),
    (2, "the quick  brown fox jumps over the lazy dog AGAIN", "en", "b", 1, "x", "y"),
    (3, None, None, None, None, None, None),
    (4, "", "de", "a", 0, "", ""),
    (5, LONG, "de", "a", 0, "", ""),
    (5, LONG, "de", "a", 0, "", ""),
    (6, "\n \t", None, "c", 3, "", ""),
    (None, "no id at all", "en", None, 3, "", ""),
    (-9, "señor ñandú über straße 漢字", "es", "漢", 3, "", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.execute(queries.ORACLE_SQL[name]).fetchdf(), queries.QUERIES[name](spark, sf).toPandas()
    cols = sorted(got.columns)
    key = lambda f: sorted(tuple("" if pd.isna(v) else v for v in r) for r in f[cols].itertuples(index=False))
    assert cols == sorted(want.columns) and key(got) == key(want)


def test_simhash_components_by_brute_force(spark, sf):
    got = queries.QUERIES["op3_simhash"](spark, sf).toPandas()
    fp = np.array([int(x, 16) for x in got.fingerprint], dtype=np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 2
    label = got.doc_id.to_numpy().copy()
    while (new := np.array([label[near[i]].min() for i in range(len(label))])).tolist() != label.tolist():
        label = new
    assert label.tolist() == got.component_id.tolist()


def test_links_of_dense_fingerprints(spark):
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 62, size=40)
    fps = {int(b) ^ sum(1 << int(k) for k in draw.choice(62, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4) for _ in range(20)}
    reps = spark.createDataFrame(list(enumerate(sorted(fps))), "node long, fp long")
    got = {r["node"]: r["component"] for r in simhash.min_label_components(simhash.link_fingerprints(reps, 2)).collect()}
    a = np.array(sorted(fps), dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= 2
    label = np.arange(len(a))
    while (new := np.array([label[near[i]].min() for i in range(len(a))])).tolist() != label.tolist():
        label = new
    assert [got.get(i, i) for i in range(len(a))] == label.tolist()


def test_near_duplicates_by_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = df.orderBy("doc_id").collect()
    sets = [set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = {r["doc_id"]: rows[label[i]]["doc_id"] for i, r in enumerate(rows)}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == want


def test_hostile_documents(docs):
    found = simhash.components(docs).collect()
    assert len(found) == len(ROWS)
    groups = {r["doc_id"]: r["component_id"] for r in found}
    assert groups[1] == groups[2] == 1 and groups[3] == groups[4] == groups[6] == 3
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one_of_each(docs).collect()) == ["-9", "1", "3", "5", "None"]
    tokens = {r["doc_id"]: r for r in bpe.encode_documents(docs, with_ids=True).collect()}
    assert tokens[3]["n_tokens"] == tokens[4]["n_tokens"] == 0 and tokens[5]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert len(tokens[-9]["token_ids"]) == tokens[-9]["n_tokens"]
    shards = sharding.shard_documents(docs).collect()
    for s in {r["shard"] for r in shards}:
        assert sorted(r["slot"] for r in shards if r["shard"] == s) == list(range(sum(r["shard"] == s for r in shards)))
    assert {r["size"] for r in shards if r["doc_id"] in (3, 4)} == {1}
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in mixed)
    prints = iblt.fingerprint_documents(docs).collect()
    assert len(prints) == len(ROWS) and all(0 <= r["near_next"] <= 1 for r in prints)
    assert len({r["fingerprint"] for r in prints if r["doc_id"] == 5}) == 1
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({3, 4, 6})


def test_empty_tables(spark, none):
    assert simhash.components(none).count() == simhash.keep_one_of_each(none).count() == bpe.encode_documents(none).count() == 0
    assert sharding.shard_documents(none).count() == mixing.mix(none).count() == mixing.curriculum(none).count() == 0
    assert iblt.fingerprint_documents(none).count() == language.keep_identified(none).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda v: v % 20 == 0).count() == 0


def test_chat_is_reversible_for_any_text(spark):
    texts = ["", "<|end|>", "<~|x", "</s>[INST]~[/INST]", "a<|msg|>b<~~|next|>", None, "[~INST]", "<s>\\$1"]
    rows = [(1, i, ("user", "user", "assistant")[i % 3], t) for i, t in enumerate(texts)] + [(2, None, None, "x"), (None, 1, "user", "y"), (2, 1, "r<|msg|>", "z")]
    df = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in df.select("conv_id", chat.read_turns(df["formatted"]).alias("t")).collect()}
    assert got[1] == [(("user", "user", "assistant")[i % 3], t or "") for i, t in enumerate(texts)]
    assert got[2] == [("r<|msg|>", "z"), ("", "x")] and got[None] == [("user", "y")]


def test_targets_by_the_rule(spark):
    sizes = {f"s{i:02}": n for i, n in enumerate([1000, 10, 5, 0, 300, 7, 2, 900])}
    df = spark.createDataFrame([*sizes.items(), (None, 40)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    names = [*sorted(sizes), None]
    weight, cap = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, {n: 3 * sizes.get(n, 40) for n in names}
    want, total = dict.fromkeys(names, 0.0), sum(cap.values()) / 3
    open_ = set(names)
    while True:
        left = total - sum(cap[n] for n in names if n not in open_)
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > cap[n]}
        if not over:
            break
        open_ -= over
    want = {n: share[n] if n in open_ else cap[n] for n in names}
    assert all(abs(got[n] - want[n]) < 1e-6 for n in names)


def test_curve_inverts_its_integral(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES:
        xs, ys = zip(*knots, strict=True)
        t = np.linspace(0, 1, 20001)
        w = np.interp(t, xs, ys)
        done = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))))
        shares = [0.0, 0.1, 0.37, 0.5, 0.8, 1.0]
        df = spark.createDataFrame([(s,) for s in shares], "s double")
        got = [r[0] for r in df.select(mixing.inverse_demand(F.col("s"), knots)).collect()]
        assert np.allclose(got, np.interp(np.array(shares) * done[-1], done, t), atol=1e-4)


def test_shards_only_grow(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = sharding.op9_sharding(spark, sf).toPandas()
    assert set(got.grown_shard[got.shard != got.grown_shard]) <= {16}
    assert all(zlib.crc32((rows[i] or "").encode()) == c for i, c in zip(got.doc_id, got.text_crc32, strict=True))


def _pieces_by_hand(text):
    """Counts of paragraphs and of the sentences of those with several, without the operator's own cutting."""
    from collections import Counter

    out = Counter()
    for line in text.split("\n"):
        line = " ".join(line.split())
        sentences, now = [], ""
        for k, c in enumerate(line):
            now += c
            if c in ".!?" and (k + 1 == len(line) or line[k + 1] not in ".!?"):
                sentences.append(now.strip())
                now = ""
        sentences = [s for s in [*sentences, now.strip()] if s]
        if line:
            out.update([line, *(sentences if len(sentences) > 1 else [])])
    return out


def _prints_by_hand(rows):
    """(n_chars, sha256, near_edited, near_next) of rows (doc_id, text) in their order, the next after the last being the first."""
    want = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, e = map(_pieces_by_hand, (text, after, new))
        like = lambda x, y: 2 * (x & y).total() / (x.total() + y.total()) if x or y else 1.0
        want.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), round(like(a, e), 9), round(like(a, b), 9)))
    return want


def test_fingerprints_by_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id", ascending=False).collect()]
    found = iblt.op8_document_fingerprints(spark, sf).collect()
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found]
    assert sorted(got) == sorted(_prints_by_hand(rows))
    for r in found[:50]:
        seen = iblt.compare_fingerprints(r["fingerprint"], r["edited_fingerprint"])
        assert seen is None or seen[2] == r["near_edited"]


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(5, "a. b. c!\nd"), (5, "a. b. c!\nd"), (5, "zz zz. " * 50), (None, "x"), (None, None), (None, "y y\n" * 9), (-3, ""), (9, "w " * 10**5)] * 3
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, part long, place long")
    sha = lambda r: hashlib.sha256((r[1] or "").encode()).digest()
    want = _prints_by_hand(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), sha(r))))
    for size in (1 << 28, 200):
        got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in iblt.fingerprint_documents(df, size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_language_accuracy_on_held_out(spark, sf):
    got = language.op10_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").filter("held_out and lang is not null")
    rows = got.select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 0


def test_neighbours_recall_and_hostile_vectors(spark, sf):
    got = queries.QUERIES["op6_nearest_neighbours"](spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    v, ids, hit = np.array(table.embedding.tolist(), dtype=np.float64), table.vec_id.to_numpy(), 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[np.searchsorted(ids, q)]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(got.vec_id[got.query_id == q]))
    assert hit >= 0.9 * 20 * (ids % 20 == 0).sum()
    bad = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [0.5, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (8, [float("inf"), 1.0]), (9, [0.0, 5.0]), (9, [-3.0, 1.0])]
    out = ann.search(spark.createDataFrame([(*r, 1, 2) for r in bad], "vec_id long, embedding array<float>, vec int, rank int"), lambda c: c % 20 == 0).orderBy("query_id", "rank").collect()
    want = [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 7, 0.5), (0, 4, 20, -1.0), (0, 5, 9, -3.0), (20, 1, 9, 3.0), (20, 2, 7, -0.5), (20, 3, 0, -1.0), (20, 4, 5, -1.0), (20, 5, 6, -1.0)]
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out] == want


@pytest.mark.parametrize(("kind", "share"), [("clustered", 0.2), ("unclustered", 0.9)])
def test_neighbours_recall_where_the_search_is_partial(spark, monkeypatch, kind, share):
    draw = np.random.default_rng(12)
    centres = draw.normal(size=(60, 32))
    v = centres[draw.integers(0, 60, 6000)] + 0.3 * draw.normal(size=(6000, 32)) if kind == "clustered" else draw.normal(size=(6000, 32))
    visited, calibrate = [], ann._calibrated

    def spy(placed, tree, *rest):
        visited.append(calibrate(placed, tree, *rest) / tree.leaves)
        return calibrate(placed, tree, *rest)

    monkeypatch.setattr(ann, "_calibrated", spy)
    got = ann.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), lambda c: c % 20 == 0).toPandas()
    near = got.groupby("query_id").vec_id.agg(set)
    hit = 0
    for q in range(0, 6000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:20]) & near[q])
    assert hit >= 0.9 * 20 * 300 and visited[0] < share and (got["rank"].max(), len(got)) == (20, 6000)


def test_warc_round_trip_of_hostile_pages(spark, tmp_path):
    big = "<p>é" * 5000
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "u", big), (5, "u", "x" * 100), (6, "u\r\nWARC/1.1", "x" * 100), (7, "u", "x" * 99), (8, "u", "x" * 99)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), records=2)
    got = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 9 and all(r["quarantined"] is None for r in got.values())
    assert {k: r["refers_to"] for k, r in got.items()} == {1: None, 2: 1, 3: None, 4: None, None: 1, 5: None, 6: 5, 7: None, 8: None}
    assert all(got[i]["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest() and got[i]["payload_bytes"] == len((h or "").encode()) for i, _, h in rows)


def test_bpe_of_unbroken_words_and_clashing_columns(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    texts = ["a" * 60_000, "xyzzy" * 8_000, "漢" * 3_000, None, "<|endoftext|>" * 50]
    df = spark.createDataFrame([(i % 3, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, token_ids array<int>")
    want = sorted((i % 3, lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts))
    assert sorted((r["doc_id"], list(r["token_ids"])) for r in bpe.encode_documents(df, with_ids=True).collect()) == want
    kept = bpe._Words(bpe.vocabulary(bpe.default_path()))
    assert kept["b" * 500] and "b" * 500 not in kept and kept["abc"] and "abc" in kept


def test_chat_merges_runs_of_a_role(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"), (1, 3, "user", "d"), (1, 4, None, None), (2, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(df).collect()}
    part = lambda role, *texts: chat.START + role + chat.MSG + chat.NEXT.join(texts) + chat.END
    assert got == {1: part("user", "a", "b") + part("assistant", "c") + part("user", "d", "d") + part("", ""), 2: part("assistant", "x" * 300_000)}


def test_warc_fails_on_damage_and_on_unresolved_revisits(spark, sf, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"<p>{i // 2}</p>" * 50, "x") for i in range(6)] + [(0, "u", "again" * 10**5, "x")], "page_id long, url string, html string, payload string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    whole = warc.read_archives(spark, str(tmp_path / "w"))
    assert whole.count() == 7 and whole.filter("record_type = 'revisit'").count() == 3 and warc.unresolved(whole).count() == 0
    assert warc.unresolved(whole.filter("page_id <> 2")).collect()[0]["refers_to"] == 2
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(empty, str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    written = next((tmp_path / "w").glob("part-*"))
    raw = bytearray(written.read_bytes())
    raw[len(raw) // 2 : len(raw) // 2 + 9] = b"\0" * 9
    (tmp_path / "hurt").mkdir()
    (tmp_path / "hurt" / "a.warc.gz").write_bytes(bytes(raw))
    hurt = warc.read_archives(spark, str(tmp_path / "hurt")).collect()
    assert sum(r["quarantined"] is not None for r in hurt) == 1 and len(hurt) == 7
    write = warc.write_archives

    def damaging(pages, path):
        write(pages.coalesce(1), path)
        from pathlib import Path

        one = next(Path(path.removeprefix("file:")).glob("part-*"))
        data = bytearray(one.read_bytes())
        data[200:209] = b"\0" * 9
        one.write_bytes(bytes(data))
        one.with_name(f".{one.name}.crc").unlink(missing_ok=True)

    monkeypatch.setattr(warc, "write_archives", damaging)
    with pytest.raises(ValueError, match="quarantined"):
        warc.op4_warc(spark, sf)


def test_pages_hostile(spark):
    long = "<p>" + "word, " * 200_000 + "</p>"
    rows = [(1, "u", long, "t", 5), (1, "u", long, "t", 5), (None, None, None, None, None)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got if r["page_id"]] == [(1, 200_000 * 6 - 1)] * 2 and len(got) == 3
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_keep_null_ids(spark):
    df = spark.createDataFrame([(None, None, "<p>a</p>"), (1, "u", None)], "page_id long, url string, html string")
    assert {(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()} == {(None, "a", 1), (1, "", 0)}


def test_pipeline_stages_keep_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    read = spark.read.parquet(f"{sf}/documents.parquet")
    cols = read.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, read, sf).write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        assert read.columns == cols
    assert corpus_pipeline.STAGES[-1][1](spark, read, sf).count() == read.count()


def test_near_dedup_keeps_rows_by_their_own_text(spark):
    a, b = (" ".join(f"{p}{k}" for k in range(60)) for p in "ab")
    rows = [(3, a), (7, a), (7, b), (9, b), (7, b), (None, a), (None, "lonely words"), (None, "lonely words"), (2, ""), (1, " \t")]
    cols = "doc_id long, text string, row_key string, digest string, n long, node long, `first` string, key string, grp long"
    docs = spark.createDataFrame([(*r, *[None] * 7) for r in rows], cols)
    kept = simhash.keep_one_of_each(docs, shingle=5, similarity=0.8)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, a), (7, b), (None, "lonely words"), (1, " \t")], key=str)


def test_near_duplicates_in_blocks_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_BLOCK", 7)
    monkeypatch.setattr(simhash, "GROUP_TILE", 3)
    draw = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for k in draw.choice(120, int(draw.integers(0, 6)), replace=False):
            words[k] = f"x{draw.integers(0, 3)}"
        texts.append(" ".join(words[: int(draw.integers(90, 121))]))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert len(set(label)) > 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == dict(enumerate(label))


def _mixed_by_hand(rows):
    """Positions of every row by the rules, in plain Python."""
    words = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {n: sum(words(r[1]) for r in rows if r[3] == n) for n in names}
    weight, cap = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, {n: 3 * size[n] for n in names}
    open_, total = set(names), sum(size.values())
    while True:
        left = total - sum(cap[n] for n in names if n not in open_)
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] >= cap[n]}
        if not over:
            break
        open_ -= over
    target = {n: share[n] if n in open_ else cap[n] for n in names}
    out = []
    for i, n in enumerate(names):
        place = lambda r: hashlib.sha256(f"{'' if r[0] is None else r[0]}\n{r[1] or ''}".encode()).hexdigest()
        done = 0
        xs, ys = zip(*mixing.SCHEDULES[i % 3], strict=True)
        t = np.linspace(0, 1, 200_001)
        area = np.concatenate(([0], np.cumsum(np.diff(t) * (np.interp(t[1:], xs, ys) + np.interp(t[:-1], xs, ys)) / 2)))
        for r in sorted((r for r in rows if r[3] == n), key=lambda r: (place(r), r[0] if r[0] is not None else -1)):
            middle, done = done + words(r[1]) / 2, done + words(r[1])
            passes = int(target[n] // size[n]) if size[n] else 0
            copies = min(3, passes + (middle < target[n] - passes * size[n])) if words(r[1]) else 0
            for c in range(copies):
                out.append((float(np.interp(min(1.0, (c * size[n] + middle) / target[n]) * area[-1], area, t)), r))
    return sorted(out, key=lambda x: x[0])


def test_curriculum_by_brute_force_with_repeated_and_null_ids(spark, tmp_path):
    draw = np.random.default_rng(6)
    rows = []
    for k in range(120):
        text = " ".join(f"w{k}x{j}" for j in range(int(draw.integers(0, 30)))) or None
        doc_id = [k % 7, k, None][k % 3]
        rows.append((doc_id, text, "en", ["a", "b", "b", "b", "c", None][int(draw.integers(0, 6))], k))
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, size long")
    mixing.curriculum(df).write.parquet(str(tmp_path / "m"))
    read = spark.read.parquet(str(tmp_path / "m"))
    assert read.columns == df.columns
    got = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in read.orderBy("_metadata.file_name", "_metadata.row_index").collect()]
    want = _mixed_by_hand(rows)
    assert len(got) == len(want) and sorted(map(str, got)) == sorted(str(r) for _, r in want)
    at = {}
    for p, r in want:
        at.setdefault(r, []).append(p)
    seen, places = {}, []
    for r in got:
        places.append(at[r][seen.get(r, 0)])
        seen[r] = seen.get(r, 0) + 1
    assert all(b >= a - 1e-4 for a, b in zip(places, places[1:], strict=False))


def test_language_with_clashing_names_and_no_rows(spark, none):
    cols = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, lang_score double, `lang_rejected` boolean, lang_pred_ string"
    rows = [(i, ["the cat and the dog ran on", "der hund und die katze liefen"][i % 2] + f" {i}", ["en", "de"][i % 2], "s", 1, "x", 0.0, True, "y") for i in range(60)]
    rows += [(0, "the cat and the dog ran on 0", "en", "s", 1, "x", 0.0, True, "y"), (None, "the dog and the cat", None, None, None, None, None, None, None), (7, None, "de", "s", 1, "x", 0.0, True, "y")]
    df = spark.createDataFrame(rows, cols)
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and kept.count() >= 58 and kept.filter("text is null").count() == 0
    assert language.predict(none, language.fit_sample(none), ["doc_id"]).count() == 0


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_by_hand(spark, sf):
    """Its rows against the stages in plain Python: the model's own rejection, brute-force groups, the mix by hand, the library's ids."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit_sample(df)
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    labels, scores = model.score([r[1] for r in rows])
    rows = sorted((r for r, lab, s in zip(rows, labels, scores, strict=True) if lab != "und" and s >= model.threshold), key=lambda r: r[0])
    sets = [set(simhash.shingle_hashes(r[1], 5).tolist()) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    mixed = _mixed_by_hand([r for i, r in enumerate(rows) if label[i] == i])
    lib = Tokenizer.from_file(bpe.default_path())
    want = sorted((r[0], lib.encode(r[1], add_special_tokens=False).ids) for _, r in mixed)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], list(r["token_ids"])) for r in got) == want
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["input_part"], r["input_row"]))]
    where = {}
    for p, r in mixed:
        where.setdefault(r[0], []).append(p)
    places = [where[i].pop(0) for i in order]
    assert all(b >= a - 1e-4 for a, b in zip(places, places[1:], strict=False))


def test_repeated_lines_do_not_part_near_copies(spark):
    """The similarity is of sets of shingles: a line that one copy repeats often changes nothing."""
    words = [f"w{k}" for k in range(200)]
    line = " ".join(f"chorus{k}" for k in range(5))
    once, often = " ".join([*words, line]), " ".join([*words, *[line] * 200])
    other = " ".join(f"v{k}" for k in range(200))
    docs = spark.createDataFrame([(1, once), (2, often), (3, other)], "doc_id long, text string")
    a, b = (simhash.shingle_hashes(t, 5) for t in (once, often))
    apart = np.bitwise_count(np.uint64(simhash.fingerprint(a) % (1 << 64)) ^ np.uint64(simhash.fingerprint(b) % (1 << 64)))
    assert simhash._similar(np.unique(a), np.unique(b), 0.8) and apart > 24
    assert {(r[0], r[1]) for r in simhash.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_few_vectors_in_a_leaf_make_a_query_visit_more(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 8)
    monkeypatch.setattr(ann, "_calibrated", lambda *_: 1)
    vectors = np.random.default_rng(3).normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = ann.search(df, lambda c: c % 20 == 0).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {i: ann.K for i in range(0, 200, 20)}
