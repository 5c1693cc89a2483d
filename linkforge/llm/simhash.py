"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: the text's UTF-8 bytes with A-Z lower-cased are cut into words at ASCII white space;
every run of `shingle` words (repeats included; fewer words: the whole sequence) is hashed with XXH64,
seed 42; a bit is set if more than half the hashes have it. A null, empty or blank text has fingerprint
zero and links like any other.

link_fingerprints() compares distinct fingerprints within small radii exactly. Three sub-word population
counts place each fingerprint in a cell; counts of linked fingerprints differ by the radius at most in sum,
so a cell meets only the cells that near. Inside a cell, numpy tiles are compared by exclusive-or and bit
counts, and tile pairs whose further population counts lie too far apart are skipped. A task keeps one block
of a cell (BLOCK fingerprints at most, larger cells are split) and streams the rest past it; it emits a
forest, never all pairs, so that large groups stay linear.

near_duplicates() is for a similarity threshold, where the radius is too wide for population counts to part
anything (0.8 on five words is 10 of 64 bits on average, 26 at worst). There min-hash bands choose which
tiles meet; inside them tiles are skipped if their population counts, or their numbers of shingles, lie too far
apart, fingerprints are compared by exclusive-or and bit counts, and each remaining link is verified by the exact
Jaccard similarity of the whole texts' shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkforge.llm.common import checkpointed, fresh, map_batches, min_label_components, read_table, width
from linkforge.llm.hash_sql import xxh64_ctes

SEED = 42
#: Fingerprints that one task holds of a cell, and one side of a numpy tile.
BLOCK, TILE = 16384, 512
#: Sub-words whose population counts name a cell, and others that part the tiles inside it.
CELL_MASKS = ((1 << 22) - 1, ((1 << 21) - 1) << 22, ((1 << 21) - 1) << 43)
TILE_MASKS = tuple(sum(1 << b for b in range(k, 64, 4)) for k in range(4))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode("utf-8").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A signed 64-bit fingerprint of unsigned hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of docs(doc_id, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fp long")


class Forest:
    """Union-find over node numbers that tells which links were new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _tiles(fp: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles of TILE fingerprints, alike in population counts, with the least and largest counts."""
    counts = np.stack([np.bitwise_count(fp & np.uint64(m)).astype(np.int64) for m in TILE_MASKS], axis=1)
    order = np.lexsort(counts.T[::-1])
    fp, node, counts = fp[order], node[order], counts[order]
    return [(fp[a : a + TILE], node[a : a + TILE], counts[a : a + TILE].min(0), counts[a : a + TILE].max(0)) for a in range(0, len(fp), TILE)]


def _link(a: tuple, b: tuple, radius: int, forest: Forest) -> list[tuple[int, int]]:
    """New links between two tiles."""
    gap = np.maximum(0, np.maximum(a[2] - b[3], b[2] - a[3])).sum()
    if gap > radius:
        return []
    left, right = np.nonzero(np.bitwise_count(a[0][:, None] ^ b[0][None, :]) <= radius)
    if not len(left):
        return []
    x, y = a[1][left], b[1][right]
    if len(x) > 2 * TILE:  # a dense group: one link from each node to each tree is enough
        roots = np.array([forest.find(int(v)) for v in b[1]], dtype=np.int64)
        both = np.unique(np.stack([x, roots[right]], axis=1), axis=0)
        x, y = both[:, 0], both[:, 1]
    return [(u, v) for u, v in zip(x.tolist(), y.tolist(), strict=True) if u != v and forest.union(u, v)]


def _compare_cells(radius: int):
    """For mapInArrow over rows (cell, block, probe, fp, node) sorted in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, held, forest, ready = None, [], [], Forest(), False
        out: list[tuple[int, int]] = []
        for batch in batches:
            cell, block, probe, fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            keys = cell.astype(np.int64) << 32 | block.astype(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (probe[1:] != probe[:-1])) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key != keys[a]:
                    key, home, held, forest, ready = keys[a], [], [], Forest(), False
                part = (fp[a:b].astype(np.int64).view(np.uint64), node[a:b].astype(np.int64))
                if not probe[a]:
                    tiles = _tiles(*part)
                    for i, x in enumerate(tiles):
                        for y in [*held, *tiles[: i + 1]]:
                            out += _link(x, y, radius, forest)
                    held += tiles
                    if len(part[0]) < TILE and len(held) > 8:  # many small batches of one block
                        fps, nodes = np.concatenate([t[0] for t in held]), np.concatenate([t[1] for t in held])
                        held = _tiles(fps, nodes)
                elif held:
                    for x in _tiles(*part):
                        for y in held:
                            out += _link(x, y, radius, forest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], ["src", "dst"])
                out = []

    return run


def link_fingerprints(reps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (src, dst) that connect what radius connects, of reps(fp, node) with distinct fp."""
    a, b, c = (F.bit_count(F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))) for m in CELL_MASKS)
    placed = reps.select("fp", "node", a.alias("a"), b.alias("b"), c.alias("c"))
    name = lambda a, b, c: (a * 32 + b) * 32 + c
    # At most 23 * 22 * 22 cells exist, whatever the input: a bounded side for the broadcast.
    sizes = placed.groupBy(name(F.col("a"), F.col("b"), F.col("c")).alias("cell")).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    near = [o for o in product(range(-radius, radius + 1), repeat=3) if sum(map(abs, o)) <= radius and o >= (0, 0, 0)]
    inside = lambda o: (F.col("a") + o[0]).between(0, 22) & (F.col("b") + o[1]).between(0, 21) & (F.col("c") + o[2]).between(0, 21)
    goes = F.array_compact(F.array(*(F.when(inside(o), F.struct(name(F.col("a") + o[0], F.col("b") + o[1], F.col("c") + o[2]).alias("cell"), F.lit(o == (0, 0, 0)).alias("own"))) for o in near)))
    sent = placed.select("fp", "node", F.explode(goes).alias("g")).select("fp", "node", "g.cell", "g.own").join(F.broadcast(sizes), "cell")
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    # Its own block gets a fingerprint to keep; later blocks of its cell, and all blocks of near cells, see it pass.
    block = F.explode(F.when(F.col("own"), F.sequence(own, F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = sent.withColumn("block", block).select("cell", "block", (~(F.col("own") & (F.col("block") == own))).cast("int").alias("probe"), "fp", "node")
    rows = rows.repartition(width(reps.sparkSession), "cell", "block").sortWithinPartitions("cell", "block", "probe")
    return rows.mapInArrow(_compare_cells(radius), "src long, dst long")


def components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id for every row of docs(doc_id, text).

    component_id is the least doc_id that links of radius or fewer differing bits reach. Repeated doc_ids
    give repeated rows; a null doc_id keeps its row with a null component unless a linked row has an id.
    """
    fps = checkpointed(fingerprints(docs, shingle))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    known = checkpointed(reps.filter("node is not null"))
    labels = min_label_components(link_fingerprints(known, radius))
    named = known.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(read_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::ubigint ELSE 0::ubigint END" for b in range(64))
OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
{xxh64_ctes("hashed", "sh", "s", "s", str(SEED))},
signed AS (SELECT doc_id, {_BITS} AS fp FROM (SELECT doc_id, hashed.h::ubigint AS h FROM sh JOIN hashed ON hashed.key = sh.s) GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(fp, 0::ubigint) AS fp FROM documents LEFT JOIN signed USING (doc_id)),
reps AS (SELECT fp, min(doc_id) AS node FROM f GROUP BY fp),
near AS (SELECT a.fp AS a, b.fp AS b FROM reps a JOIN reps b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
reach AS (SELECT fp AS a, fp AS b FROM reps UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
named AS (SELECT reach.a AS fp, min(reps.node) AS component_id FROM reach JOIN reps ON reps.fp = reach.b GROUP BY reach.a)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM f JOIN named USING (fp)
"""


# -- a similarity threshold -------------------------------------------------------------------------

#: Texts, and shingles, of one likeness group that a task compares with each other or with as many others.
GROUP_BLOCK, GROUP_SHINGLES = 1024, 1 << 22
#: Texts of a tile.
GROUP_TILE = 256


def _sketch(shingle: int, bands: int, rows: int):
    """A task's step over (doc_id, digest, text): the number of distinct shingles and one min-hash key for each band."""
    draw = np.random.default_rng(20240229)
    mult = draw.integers(1, 1 << 32, size=(bands * rows, 1), dtype=np.uint32) | np.uint32(1)
    add = draw.integers(0, 1 << 32, size=(bands * rows, 1), dtype=np.uint32)
    room = np.empty((bands * rows, 1024), dtype=np.uint32)

    def keys(hashes: np.ndarray) -> list[int]:
        least = np.full(bands * rows, np.iinfo(np.uint32).max, dtype=np.uint32)
        low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        for at in range(0, len(low), room.shape[1]):
            part = low[None, at : at + room.shape[1]]
            here = room[:, : part.shape[1]]
            np.multiply(part, mult, out=here)
            np.add(here, add, out=here)
            np.minimum(least, here.min(axis=1), out=least)
        return [xxhash.xxh64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b) - (1 << 63) for b in range(bands)]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, bandkeys = [], []
        for t in batch.column(2):
            hashes = np.unique(shingle_hashes(t.as_py(), shingle))
            sizes.append(len(hashes))
            bandkeys.append(keys(hashes) if len(hashes) else [])
        arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(bandkeys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "n", "keys"])

    return step


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of hashes have at least this Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < similarity * len(b):
        return len(b) == 0
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


@dataclass
class _Tile:
    """Texts of a group: nodes, sorted shingle sets, their fingerprints and both kinds of counts."""

    nodes: list[int]
    sets: list[np.ndarray]

    def __post_init__(self) -> None:
        # The similarity is of sets, so the fingerprint is too: repeated lines would pull it away.
        self.fps = np.array([fingerprint(s) for s in self.sets], dtype=np.int64).view(np.uint64)
        self.bits = np.bitwise_count(self.fps).astype(np.int64)
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)

    def apart(self, other: _Tile, similarity: float, radius: int) -> bool:
        """Whether counts alone rule out every pair: a Jaccard similarity is no more than the ratio of the sizes."""
        bits = max(self.bits.min() - other.bits.max(), other.bits.min() - self.bits.max())
        sizes = self.sizes.max() < similarity * other.sizes.min() or other.sizes.max() < similarity * self.sizes.min()
        return bool(bits > radius or sizes)

    def links(self, other: _Tile, similarity: float, radius: int, forest: Forest) -> Iterator[tuple[int, int]]:
        if self.apart(other, similarity, radius):
            return
        bits = np.bitwise_count(self.fps[:, None] ^ other.fps[None, :])
        left, right = np.nonzero((bits <= radius) & (np.minimum(self.sizes[:, None], other.sizes) >= similarity * np.maximum(self.sizes[:, None], other.sizes)))
        nearest = np.argsort(bits[left, right], kind="stable")
        for a, b in zip(left[nearest].tolist(), right[nearest].tolist(), strict=True):
            u, v = self.nodes[a], other.nodes[b]
            if u != v and forest.find(u) != forest.find(v) and _similar(self.sets[a], other.sets[b], similarity):
                forest.union(u, v)
                yield u, v


def _verify_groups(shingle: int, similarity: float, radius: int):
    """For mapInArrow over rows (grp, i, j, side, node, text) sorted by these, texts by their number of shingles: verified links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, forest, held = None, Forest(), []
        nodes: list[int] = []
        sets: list[np.ndarray] = []

        def close() -> list[tuple[int, int]]:
            """Links of the waiting tile: block i's tiles wait for block j's, or meet each other if i = j."""
            if not nodes:
                return []
            (_, i, j, side), tile = key, _Tile(list(nodes), list(sets))
            meets = held if side else [*held, tile] if i == j else []
            found = [x for other in meets for x in tile.links(other, similarity, radius, forest)]
            if not side:
                held.append(tile)
            nodes.clear()
            sets.clear()
            return found

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], ["src", "dst"])

        for batch in batches:
            links: list[tuple[int, int]] = []
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for at, new in enumerate(zip(*cols[:4], strict=True)):
                if key != new or len(nodes) == GROUP_TILE:
                    links += close()
                    if key is None or key[:3] != new[:3]:
                        forest, held = Forest(), []
                    key = new
                nodes.append(cols[4][at])
                sets.append(np.unique(shingle_hashes(batch.column(5)[at].as_py(), shingle)))
            if links:
                yield out(links)
        if links := close():
            yield out(links)

    return run


def _digest(text: Column) -> Column:
    """16 bytes that equal texts share; texts without words are equal."""
    return F.unhex(F.md5(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit(""))))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 26, bands: int = 40, rows: int = 6) -> DataFrame:
    """(doc_id, component_id, digest, first) for every row of docs(doc_id, text): groups of like texts.

    Equal texts are copies, and so are texts without words. Other texts are linked if their sets of
    shingles have at least this Jaccard similarity; a group is what links connect. `rows` equal minima in one
    of `bands` bands bring two texts together (missed at 0.8: one pair in 190,000, less above), fingerprints
    of their distinct shingles farther apart than `radius` part them again (0.8 means 10 bits of 64, with a deviation
    of 3: less than one pair in a million), and the exact similarity decides.

    A text's node is its digest, so that unlike texts under one doc_id are nodes of their own. component_id is a
    group's least doc_id, nulls last, and first is the digest of that row (the least of several).

    A group that copies or chains make large is cut into blocks of bounded texts and shingles; each pair of blocks is one
    task's work and yields a forest of verified links, so no task holds more than a block and a tile and no link is lost.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", _digest(F.col("text")))
    sketch = checkpointed(map_batches(named.select("doc_id", "digest", "text"), lambda: _sketch(shingle, bands, rows), "doc_id long, digest binary, n long, keys array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first")
    # Numbers of rows are told once and kept, so that they stay the same if an executor is lost.
    reps = checkpointed(sketch.groupBy("digest").agg(first, F.any_value("n").alias("n"), F.any_value("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()))
    keyed = checkpointed(reps.select("node", F.explode("keys").alias("key")))
    least = keyed.groupBy("key").agg(F.min("node").alias("dst"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    near = min_label_components(keyed.join(least, "key").select(F.col("node").alias("src"), "dst"))
    members = checkpointed(near.select("node", F.col("component").alias("grp")).union(near.select("component", "component").distinct()).join(reps.select("node", "first", "n"), "node"))
    sizes = members.groupBy("grp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(GROUP_BLOCK), F.sum("n") / F.lit(GROUP_SHINGLES))).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    placed = members.join(sizes, "grp").select("grp", "node", "n", own.alias("own"), "blocks", F.col("first.doc_id").alias("of_id"), F.col("first.digest").alias("of_digest"))
    # The first row of a text stands for it; a row that repeats is one text still.
    texts = named.join(placed, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest"))).select("grp", "node", "n", "own", "blocks", "text")
    if sketch.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").head(1):
        texts = texts.groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("grp", "n", "own", "blocks", "text")))
    sent = texts.select("grp", "node", "n", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"), "text")
    sent = sent.select("grp", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).cast("int").alias("side"), "node", "text", "n")
    sent = sent.repartition(width(docs.sparkSession), "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side", "n", "node").drop("n")
    links = min_label_components(sent.mapInArrow(_verify_groups(shingle, similarity, radius), "src long, dst long"))
    grouped = reps.join(links, "node", "left").select("digest", "first", F.coalesce("component", "node").alias("component"))
    heads = grouped.groupBy("component").agg(F.min("first").alias("head"))
    labels = grouped.select("digest", "component").join(heads, "component").select("digest", "component", F.col("head.doc_id").alias("component_id"), F.col("head.digest").alias("first"))
    return sketch.select("doc_id", "digest").join(labels, "digest").select("doc_id", "component_id", "digest", "first")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay when each group of near-duplicates keeps its row of least doc_id, nulls last.

    Of rows that share this doc_id, that of the least digest stays; of rows that share both, one, the least by the hash of all its columns.
    """
    named = checkpointed(near_duplicates(docs, **options))
    name, kept_name, hash_name = fresh(docs.columns, "row_key"), fresh(docs.columns, "kept_key"), fresh(docs.columns, "row_hash")
    row_key = lambda doc_id, digest: F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit(":"), F.hex(digest))
    kept = named.filter("doc_id <=> component_id and digest = first").groupBy(row_key(F.col("doc_id"), F.col("digest")).alias(kept_name)).agg(F.count(F.lit(1)).alias("n"))
    keyed = docs.withColumn(name, row_key(F.col("doc_id"), _digest(F.col("text").cast("string"))))
    out = keyed.join(kept.filter("n = 1"), F.col(name) == F.col(kept_name), "left_semi")
    if (again := kept.filter("n > 1")).head(1):
        repeated = keyed.join(again, F.col(name) == F.col(kept_name), "left_semi").withColumn(hash_name, F.xxhash64(*docs.columns))
        ranked = repeated.withColumn(kept_name, F.row_number().over(Window.partitionBy(name).orderBy(hash_name)))
        out = out.unionByName(ranked.filter(F.col(kept_name) == 1).drop(kept_name, hash_name))
    return out.select(*docs.columns)
