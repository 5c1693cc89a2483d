"""Document fingerprints by invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs at line ends, and paragraphs of several sentences into those as well, so that an edit inside a
paragraph is seen too; each piece, with its white space folded and the number of equal pieces before it, is hashed to
64 bits. A fingerprint is the number of digests and an array of cells (count, exclusive-or of digests, exclusive-or of
their check hashes); each digest goes to three cells, one in each third of the array. Fingerprints of two versions
subtract cell by cell; what both have cancels, and peeling cells that hold one digest recovers the digests that differ
(compare_fingerprints() does so from the published strings alone). When peeling gets stuck, both texts are sketched again
with larger arrays. The likeness of two texts is Dice's: twice the shared pieces over all pieces of both, 1 for two texts
without any.

fingerprint_documents() pairs each document with the next one in descending doc_id (after the last: the first);
ties go by the text's digest. A null text counts as empty. A null doc_id comes last. Repeated rows are documents of their
own. The texts are shuffled once, by ranges of (doc_id, digest) of even bytes, as many as the bytes need; the first document
of each range also goes to the range before, so that a task meets its rows' next documents as a stream and holds two texts and a
bounded batch of digests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkforge.llm.common import checkpointed, read_table, width
from linkforge.llm.hash_sql import mul, shifted, u, xxh64_ctes

#: Cells of the fingerprint that is returned; a multiple of 3.
CELLS = 24
#: Rows that a task peels together, and digests after which it stops adding rows.
BATCH_ROWS, BATCH_DIGESTS = 512, 1 << 18
SENTENCE = regex.compile(r"[^.!?]+[.!?]*|[.!?]+")
#: Odd multipliers that spread a digest's bits.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
#: Bytes of text that a range is meant to hold.
RANGE_BYTES = 1 << 28


def pieces(text: str) -> list[str]:
    """Paragraphs, and after each the sentences that it has more than one of; white space folded, empty ones left out."""
    out = []
    for paragraph in text.split("\n"):
        whole = " ".join(paragraph.split())
        if whole:
            out.append(whole)
            parts = [p for x in SENTENCE.findall(whole) if (p := x.strip())]
            if len(parts) > 1:
                out += parts
    return out


def digests(text: str) -> np.ndarray:
    """The distinct 64-bit digests of a text's pieces; the n-th equal piece has its own."""
    seen: dict[str, int] = {}
    out = []
    digest = xxhash.xxh64_intdigest
    for piece in pieces(text):
        n = seen.get(piece, 0)
        seen[piece] = n + 1
        out.append(digest(piece, n))
    return np.array(out, dtype=np.uint64)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(MIX[0])
        x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[1])
        return x ^ (x >> np.uint64(32))


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys, 99) >> np.uint64(32)


class Sketches:
    """Many sketches side by side: sketch k has cells[k] cells, a multiple of 3."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells
        self.start = np.concatenate(([0], np.cumsum(cells)))
        n = int(self.start[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def places(self, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        third = (self.cells[owner] // 3).astype(np.uint64)
        base = self.start[owner].astype(np.uint64)
        return np.stack([base + np.uint64(t) * third + _mix(keys, t + 1) % third for t in range(3)]).astype(np.int64)

    @classmethod
    def of(cls, sets: list[np.ndarray], cells: np.ndarray) -> Sketches:
        out = cls(cells)
        out.add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([np.zeros(0, np.uint64), *sets]), 1)
        return out

    def add(self, owner: np.ndarray, keys: np.ndarray, sign) -> None:
        at, check = self.places(owner, keys), _check(keys)
        for row in at:
            np.add.at(self.count, row, sign)
            np.bitwise_xor.at(self.keys, row, keys)
            np.bitwise_xor.at(self.checks, row, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owners, digests and signs of what is recovered, taken out of the cells; whether each sketch came out empty."""
        owners, keys, signs = [], [], []
        number = np.repeat(np.arange(len(self.cells)), self.cells)
        look = np.arange(len(self.count))
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (self.checks[look] == _check(self.keys[look]))]
            if not len(pure):
                break
            who, key, sign = number[pure], self.keys[pure], self.count[pure]
            _, one = np.unique(np.stack([who.astype(np.uint64), key]), axis=1, return_index=True)
            who, key, sign = who[one], key[one], sign[one]
            owners.append(who)
            keys.append(key)
            signs.append(sign)
            look = np.unique(self.places(who, key))
            self.add(who, key, -sign)
        full = np.zeros(len(self.cells), dtype=bool)
        full[number[(self.count != 0) | (self.keys != 0) | (self.checks != 0)]] = True
        empty = np.zeros(0, np.int64)
        return np.concatenate(owners or [empty]), np.concatenate(keys or [empty.astype(np.uint64)]), np.concatenate(signs or [empty]), ~full

    def text(self, k: int, n: int) -> str:
        """Sketch k of n digests as a string: n, and each cell's count, digests and checks, in hexadecimal."""
        at = slice(self.start[k], self.start[k + 1])
        return f"{n:x}:" + " ".join(f"{c:x}.{key:016x}.{check:08x}" for c, key, check in zip(self.count[at].tolist(), self.keys[at].tolist(), self.checks[at].tolist(), strict=True))


def parse_fingerprint(text: str) -> tuple[int, Sketches]:
    """A published fingerprint's number of digests and its sketch."""
    n, cells = text.split(":")
    rows = [c.split(".") for c in cells.split(" ")]
    out = Sketches(np.array([len(rows)]))
    out.count = np.array([int(c, 16) for c, _, _ in rows], dtype=np.int64)
    out.keys = np.array([int(k, 16) for _, k, _ in rows], dtype=np.uint64)
    out.checks = np.array([int(h, 16) for _, _, h in rows], dtype=np.uint64)
    return int(n, 16), out


def compare_fingerprints(a: str, b: str) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Digests that only a's, and only b's text has, and the likeness; None if these cells are too few for what differs."""
    (n, x), (m, y) = parse_fingerprint(a), parse_fingerprint(b)
    _, keys, signs, done = x.minus(y).peel()
    if not done[0]:
        return None
    return keys[signs > 0], keys[signs < 0], likeness(n, m, int((signs > 0).sum()))


def differences(pairs: list[tuple[np.ndarray, np.ndarray]], first: tuple[Sketches, Sketches] | None = None) -> list[tuple[int, int]]:
    """For each pair of digest sets: how many only the first and only the second has. first: the sketches to begin with."""
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    todo = np.arange(len(pairs))
    sizes = np.full(len(pairs), CELLS)
    while len(todo):
        a, b = first or (Sketches.of([pairs[k][side] for k in todo.tolist()], sizes) for side in (0, 1))
        owner, _, sign, done = a.minus(b).peel()
        mine = np.bincount(owner[sign > 0], minlength=len(todo))
        yours = np.bincount(owner[sign < 0], minlength=len(todo))
        for at in np.flatnonzero(done).tolist():
            out[todo[at]] = int(mine[at]), int(yours[at])
        todo, sizes, first = todo[~done], sizes[~done], None
        # At most as many digests differ as both have; 1.5 cells for each are enough as a rule.
        most = np.array([len(pairs[k][0]) + len(pairs[k][1]) for k in todo.tolist()], dtype=np.int64)
        sizes = 3 * np.where(sizes < 1.5 * most, most // 2 + 4, sizes * 2 // 3)
    return out


def likeness(a: int, b: int, only_a: int) -> float:
    """Dice's, of a and b pieces of which only_a aren't shared."""
    return 2 * (a - only_a) / (a + b) if a + b else 1.0


def edited(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _finish(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (doc_id, n_chars, edited_sha256, own, edited, next digests): likeness comes from subtracting the fingerprints."""
    cells = np.full(len(rows), CELLS)
    own, new, after = (Sketches.of([r[k] for r in rows], cells) for k in (3, 4, 5))
    near = [[likeness(len(r[3]), len(r[k]), only) for r, (only, _) in zip(rows, differences([(r[3], r[k]) for r in rows], (own, other)), strict=True)] for k, other in ((4, new), (5, after))]
    texts = [[sketch.text(i, len(r[k])) for i, r in enumerate(rows)] for k, sketch in ((3, own), (4, new))]
    cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows]), *map(pa.array, texts), *(pa.array(x, pa.float64()) for x in near)]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, guest, doc_id, text) sorted by part and place: each row is joined to the one after it."""
    rows: list[tuple] = []
    held, last = 0, None  # last: (part, doc_id, text, digests) that waits for its next document
    for batch in batches:
        part, guest, ids = (batch.column(i).to_pylist() for i in range(3))
        for at in range(batch.num_rows):
            text = batch.column(3)[at].as_py() or ""
            keys = digests(text)
            if last is not None and last[0] == part[at]:
                new = edited(last[2], text)
                other = digests(new)
                rows.append((last[1], len(last[2]), hashlib.sha256(new.encode()).hexdigest(), last[3], other, keys))
                held += len(keys) + len(other) + len(last[3])
                if len(rows) >= BATCH_ROWS or held >= BATCH_DIGESTS:
                    yield _finish(rows)
                    rows, held = [], 0
            last = None if guest[at] else (part[at], ids[at], text, keys)
    if rows:
        yield _finish(rows)


def _cuts(keys: DataFrame, ranges: int, total: int) -> list:
    """The first place of each range, in order, of keys(place, bytes): ranges of even bytes. As many rows as ranges reach the driver."""
    # Numbered by slices first, then inside each, so that no task orders all rows.
    sliced = checkpointed(keys.repartitionByRange(ranges, "place").withColumn("slice", F.spark_partition_id()))
    sums = sliced.groupBy("slice").agg(F.sum("bytes").alias("of_slice"))
    starts = sums.select("slice", (F.sum("of_slice").over(Window.orderBy("slice")) - F.col("of_slice")).alias("start"))
    before = F.sum("bytes").over(Window.partitionBy("slice").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    placed = sliced.withColumn("before", before).join(starts, "slice")
    part = F.floor((F.col("start") + F.col("before")) * F.lit(ranges) / F.lit(total))
    return [r["place"] for r in placed.groupBy(part.alias("part")).agg(F.min("place").alias("place")).select("place").distinct().orderBy("place").collect()]


def _range_of(place: Column, cuts: Column, n: int) -> Column:
    """How many of the n ascending cuts, but the first, are at or before place: bisection by powers of two."""
    steps = [1 << k for k in reversed(range(max(1, n.bit_length())))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step < F.lit(n)) & (F.get(cuts, at + step) <= place), at + step).otherwise(at))


def fingerprint_documents(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SCHEMA's columns for every row of docs(doc_id, text); see the module's text."""
    spark = docs.sparkSession
    # Descending order: the complement of an id ascends. Ties go by the text's digest, so equal places have equal texts.
    order = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.struct(order.alias("order"), F.sha2(text, 256).alias("tie")).alias("place"))
    keys = checkpointed(base.select("place", (F.octet_length("text") + 64).cast("long").alias("bytes")))
    total = keys.agg(F.sum("bytes")).first()[0]
    if not total:
        return spark.createDataFrame([], SCHEMA)
    ranges = max(width(spark), -(-total // range_bytes))
    cuts = _cuts(keys, ranges, total)
    n = len(cuts)
    # A constant of the plan: one array, as long as there are ranges, that each task looks a place up in.
    held = F.from_json(F.lit(json.dumps([{"order": c["order"], "tie": c["tie"]} for c in cuts])), "array<struct<order: bigint, tie: string>>")
    keyed = base.withColumn("part", _range_of(F.col("place"), held, n))
    # The first text of each range is the range before's last row's next.
    guests = keyed.filter(F.col("place") == F.get(held, F.col("part"))).groupBy("part").agg(F.any_value("text").alias("text"))
    guests = guests.select(F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(1).alias("guest"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("struct<order: bigint, tie: string>").alias("place"))
    own = keyed.select("part", F.lit(0).alias("guest"), "doc_id", "text", "place")
    rows = own.unionByName(guests).repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", "place")
    return rows.select("part", "guest", "doc_id", "text").mapInArrow(_stream, SCHEMA)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


_SEEDS = f"[{u(1)}, {u(2)}, {u(3)}, {u(99)}]"
#: _mix() of column h under each seed.
_MIXES = f"list_transform(list_transform(list_transform({_SEEDS}, lambda s: {mul('xor(h, s)', u(MIX[0]))}), lambda m: {mul(shifted('m', 29), u(MIX[1]))}), lambda m: {shifted('m', 32)})"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS after, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id DESC, sha256(t))),
e AS (SELECT *, left(t, n - n // 2) || left(after, n // 2) AS new FROM o),
lines AS (SELECT doc_id, v, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS whole FROM (SELECT doc_id, 0 AS v, unnest(string_split(t, chr(10))) AS line FROM e UNION ALL SELECT doc_id, 1, unnest(string_split(new, chr(10))) FROM e)),
parts AS (SELECT doc_id, v, whole, list_filter(list_transform(regexp_extract_all(whole, '[^.!?]+[.!?]*|[.!?]+'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM lines WHERE whole <> ''),
pieces AS (SELECT doc_id, v, unnest(list_concat([whole], CASE WHEN len(ss) > 1 THEN ss ELSE [] END)) AS piece FROM parts),
counted AS (SELECT doc_id, v, piece, count(*) AS k FROM pieces GROUP BY doc_id, v, piece),
each AS (SELECT doc_id, v, piece, unnest(range(0, k)) AS nth FROM counted),
numbered AS (SELECT piece, nth, row_number() OVER () AS id FROM (SELECT DISTINCT piece, nth FROM each)),
{xxh64_ctes("hashed", "numbered", "id", "piece", "nth")},
mixed AS (SELECT piece, nth, h::ubigint AS h, ({_MIXES}) AS m FROM hashed JOIN numbered ON id = key),
placed AS (SELECT doc_id, v, h, (m[4] // {u(1 << 32)})::ubigint AS c, unnest([{", ".join(f"({t * (CELLS // 3)} + m[{t + 1}] % {u(CELLS // 3)})::int" for t in range(3))}]) AS cell FROM each JOIN mixed USING (piece, nth)),
cells AS (SELECT doc_id, v, cell, count(*) AS n, bit_xor(h) AS h, bit_xor(c) AS c FROM placed GROUP BY doc_id, v, cell),
grid AS (SELECT doc_id, v, cell FROM (SELECT doc_id, unnest([0, 1]) AS v FROM e), range(0, {CELLS}) r(cell)),
total AS (SELECT doc_id, v, sum(k)::bigint AS n FROM counted GROUP BY doc_id, v),
prints AS (SELECT grid.doc_id, grid.v, lower(hex(coalesce(any_value(total.n), 0))) || ':' || string_agg(lower(hex(coalesce(cells.n, 0))) || '.' || lpad(lower(hex(coalesce(cells.h, 0))), 16, '0') || '.' || lpad(lower(hex(coalesce(cells.c, 0))), 8, '0'), ' ' ORDER BY grid.cell) AS print, coalesce(any_value(total.n), 0) AS n
  FROM grid LEFT JOIN cells USING (doc_id, v, cell) LEFT JOIN total ON total.doc_id = grid.doc_id AND total.v = grid.v GROUP BY grid.doc_id, grid.v),
kept AS (SELECT a.doc_id, sum(least(a.k, b.k))::bigint AS s FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND a.v = 0 AND b.v = 1 AND a.piece = b.piece GROUP BY a.doc_id),
met AS (SELECT e.doc_id, sum(least(a.k, b.k))::bigint AS s FROM e JOIN counted a ON a.doc_id = e.doc_id AND a.v = 0 JOIN counted b ON b.doc_id = e.next_id AND b.v = 0 AND a.piece = b.piece GROUP BY e.doc_id)
SELECT e.doc_id, e.n::bigint AS n_chars, sha256(e.new) AS edited_sha256, p.print AS fingerprint, q.print AS edited_fingerprint,
       CASE WHEN p.n + q.n = 0 THEN 1.0::double ELSE 2.0::double * coalesce(kept.s, 0) / (p.n + q.n) END AS near_edited,
       CASE WHEN p.n + r.n = 0 THEN 1.0::double ELSE 2.0::double * coalesce(met.s, 0) / (p.n + r.n) END AS near_next
FROM e JOIN prints p ON p.doc_id = e.doc_id AND p.v = 0 JOIN prints q ON q.doc_id = e.doc_id AND q.v = 1 JOIN prints r ON r.doc_id = e.next_id AND r.v = 0
LEFT JOIN kept ON kept.doc_id = e.doc_id LEFT JOIN met ON met.doc_id = e.doc_id
"""
