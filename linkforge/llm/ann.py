"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a sample of SAMPLE vectors at most and gives every vector a leaf. A query goes through it best
bin first: a priority queue holds the nodes seen, the one whose centre has the largest inner product with the query is
opened next, and leaves are visited in that order. How many leaves are visited is calibrated: the exact neighbours of
a few CALIBRATE queries are found among all vectors, and the visits are widened until RECALL of them lie in visited
leaves. A query whose leaves hold fewer than K others visits more. Visited leaves are searched whole and exactly, with inner products in double precision of the original vectors.

Leaves are packed into bins of about BIN vectors, searched as equi-joins by (bin, block); a leaf that one common
vector fills is split into blocks of that size, so it is many tasks. Queries stream past a bin's vectors, each with the
leaves that it visits there, and the bin returns its best K of each query: partial results grow with bins, not leaves.

What takes part: a vec_id counts once (of repeated rows the least vector); null ids, null or zero vectors and vectors with
null or non-finite components take no part. Vectors of unlike lengths meet in the components that both have: shorter ones
are filled with zeros. Ties go to the smaller vec_id. Fewer than K candidates are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkforge.llm.common import checkpointed, read_table

K, EVERY = 20, 20
SAMPLE, FAN, LEAF, BIN = 20_000, 16, 50, 8192
CALIBRATE, RECALL = 96, 0.97


@dataclass
class Tree:
    """Nodes in arrays: a centre each, the children of inner nodes, the number of each leaf (else -1)."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            near = _nearest(vectors[rows], self.centres[kids])
            todo += [(kid, rows[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def visit(self, query: np.ndarray, leaves: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first so many leaves, best bin first; more if those hold fewer than `least` vectors, by the counts in `held`."""
        out: list[int] = []
        queue, have = [(0.0, 0)], 0
        while queue and (len(out) < leaves or have < least):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(int(self.leaf[node]))
                have += int(held[out[-1]]) if held is not None else 0
                continue
            for kid, near in zip(kids, (-(self.centres[kids] @ query)).tolist(), strict=True):
                heapq.heappush(queue, (near, kid))
        return out


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * vectors @ centres.T).argmin(1)


def fit_tree(sample: np.ndarray, leaf_rows: float, seed: int = 11) -> Tree:
    """A tree over the sample, split until a node has leaf_rows sample vectors or only equal ones."""
    draw = np.random.default_rng(seed)
    centres, children, leaf, number = [sample.mean(0) if len(sample) else np.zeros(1)], [[]], [-1], 0
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        own = sample[rows]
        if len(rows) <= leaf_rows or (own == own[0]).all():
            leaf[node], number = number, number + 1
            continue
        distinct = np.unique(own, axis=0)
        c = distinct[draw.permutation(len(distinct))[: min(FAN, max(2, int(len(rows) / leaf_rows) + 1))]]
        for _ in range(8):
            near = _nearest(own, c)
            c = np.stack([own[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        near = _nearest(own, c)
        groups = [k for k in range(len(c)) if (near == k).any()]
        if len(groups) < 2:
            leaf[node], number = number, number + 1
            continue
        for k in groups:
            children[node].append(len(centres))
            centres.append(c[k])
            children.append([])
            leaf.append(-1)
            todo.append((len(centres) - 1, rows[near == k]))
    return Tree(np.array(centres), children, np.array(leaf))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _best(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the vectors for a query, with scores that don't depend on a vector's place in the block."""
    rough = np.where(ids == own, -np.inf, rough)
    if len(ids) > k:
        floor = np.partition(rough, len(rough) - k)[len(rough) - k]
        at = np.flatnonzero(rough >= floor - 1e-9 * max(1.0, abs(floor)))
    else:
        at = np.arange(len(ids))
    at = at[rough[at] > -np.inf]
    score = (vectors[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at][order], score[order]


def _pairs(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q = np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in found]) if found else np.empty(0, np.int64)
    i = np.concatenate([i for _, i, _ in found]) if found else np.empty(0, np.int64)
    s = np.concatenate([s for _, _, s in found]) if found else np.empty(0)
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i.astype(np.int64)), pa.array(s.astype(np.float64))], ["query_id", "vec_id", "score"])


def _search_bins(k: int, leaves: int):
    """For mapInArrow over rows (bin, block, query, id, vec, leaves) sorted in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        whole: tuple | None = None
        for batch in batches:
            bin_, block, query, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            vec, visits = _matrix(batch.column(4)), batch.column(5)
            keys = bin_.astype(np.int64) << 32 | block.astype(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (query[1:] != query[:-1])) + 1).tolist(), len(keys)]
            found = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key != keys[a]:
                    key, held, whole = keys[a], [], None
                if not query[a]:  # a vector's only leaf is its own
                    held.append((row[a:b], vec[a:b], visits.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)))
                    continue
                if not held:
                    continue
                if whole is None:
                    whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                for at in range(a, b, 64):
                    end = min(b, at + 64)
                    rough = vec[at:end] @ whole[1].T
                    for i in range(end - at):
                        opened = np.zeros(leaves, bool)
                        opened[visits[at + i].as_py()] = True
                        found.append((int(row[at + i]), *_best(vec[at + i], int(row[at + i]), whole[0], whole[1], np.where(opened[whole[2]], rough[i], -np.inf), k)))
            if found:
                yield _pairs(found)

    return run


def _top(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def usable_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>) of the rows that take part."""
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & sound)
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    least, most = rows.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if least == most:
        return rows
    return rows.select("vec_id", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("vec"))).alias("vec"))


def search(table: DataFrame, queries, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for the rows whose vec_id satisfies queries(column)."""
    spark = table.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    vectors = checkpointed(usable_vectors(table))
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], out)
    by_hash = vectors.orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = np.array([r["vec"] for r in by_hash.limit(SAMPLE).toLocalIterator()])
    tree = fit_tree(sample, max(8.0, LEAF * len(sample) / n))
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.assign(_matrix(b.column(1))).astype(np.int32))], ["vec_id", "vec", "leaf"])

    placed = checkpointed(vectors.mapInArrow(assign, "vec_id long, vec array<double>, leaf int"))
    leaves = _calibrated(placed, tree, queries, k, recall)
    # One row for each leaf of the tree, whose number the sample bounds.
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    held = np.zeros(tree.leaves, np.int64)
    for r in sizes.collect():
        held[r["leaf"]] = r["n"]
    bins, least = (np.cumsum(held) - held) // BIN, k + 1
    blocks = np.maximum(1, -(-held // BIN))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes to a block of a bin once, with all the leaves that it visits there."""
        for b in batches:
            at, places, lists = [], [], []
            for k, v in enumerate(_matrix(b.column(1))):
                mine: dict[tuple[int, int], list[int]] = {}
                for leaf in shared.value.visit(v, leaves, held, least):
                    for block in range(blocks[leaf]):
                        mine.setdefault((int(bins[leaf]), block), []).append(leaf)
                at += [k] * len(mine)
                places += mine
                lists += mine.values()
            took = pa.array(at, pa.int64())
            cols = [pa.array([p[0] for p in places], pa.int32()), pa.array([p[1] for p in places], pa.int32()), b.column(0).take(took), b.column(1).take(took), pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["bin", "block", "id", "vec", "leaves"])

    table_of = F.broadcast(spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(bins, blocks, strict=True))], "leaf int, bin int, blocks long"))
    homes = placed.join(table_of, "leaf").select("bin", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("query"), F.col("vec_id").alias("id"), "vec", F.array("leaf").alias("leaves"))
    asked = placed.filter(queries(F.col("vec_id"))).select("vec_id", "vec").mapInArrow(visit, "bin int, block int, id long, vec array<double>, leaves array<int>")
    asked = asked.select("bin", "block", F.lit(1).alias("query"), "id", "vec", "leaves")
    rows = homes.unionByName(asked).repartition("bin", "block").sortWithinPartitions("bin", "block", "query")
    pairs = rows.mapInArrow(_search_bins(k, tree.leaves), "query_id long, vec_id long, score double")
    return _top(pairs, k).select("query_id", "rank", "vec_id", "score")


def _calibrated(placed: DataFrame, tree: Tree, queries, k: int, recall: float) -> int:
    """Leaves to visit: the least number whose leaves hold `recall` of the calibration queries' true neighbours."""
    picked = placed.filter(queries(F.col("vec_id"))).orderBy(F.xxhash64("vec_id", F.lit("calibrate")), "vec_id").limit(CALIBRATE).collect()
    if not picked or tree.leaves == 1:
        return tree.leaves
    ids, asked = [r["vec_id"] for r in picked], np.array([r["vec"] for r in picked])
    shared = placed.sparkSession.sparkContext.broadcast((ids, asked))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, vec = b.column(0).to_numpy(), _matrix(b.column(1))
            rough = shared.value[1] @ vec.T
            yield _pairs([(q, *_best(v, q, own, vec, r, k)) for q, v, r in zip(*shared.value, rough, strict=True)])

    true = _top(placed.select("vec_id", "vec").mapInArrow(exact, "query_id long, vec_id long, score double"), k)
    held = true.join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()  # CALIBRATE * k rows
    ranks = {q: {leaf: i for i, leaf in enumerate(tree.visit(v, tree.leaves))} for q, v in zip(ids, asked, strict=True)}
    needed = np.sort([ranks[r["query_id"]][r["leaf"]] for r in held])
    leaves = 1
    while len(needed) and np.searchsorted(needed, leaves) < recall * len(needed):
        leaves += 1
    return leaves


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % EVERY == 0)
