"""Byte-level BPE with a contiguous rank array.

A short word is held as an array of part boundaries with the rank of each part joined to its right
neighbour; the least rank is searched by scanning, its boundary is deleted, and the ranks of the two
neighbours are refreshed. Words longer than SHORT bytes give the same parts by a heap of pairs over linked
boundaries, since scanning them would take quadratic time.

The vocabulary is a public tokenizer file in the format of the `tokenizers` library (model, merges, added
tokens, byte-level pre-tokenizer); its path is a parameter. Added tokens found in a text take their own ids,
as the library does by default.

encode_documents(): a null text counts as empty and gives no ids; repeated rows give repeated results; other
columns don't matter. The text is taken whole, in batches that Arrow bounds in bytes; each task remembers at
most CACHE distinct words of SHORT bytes at most, so its memory is bounded in bytes too.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm.common import map_batches, read_table

SHORT, CACHE = 128, 1 << 18
FAR = 1 << 60
#: Fixed: the pre-tokenizer's pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself, or the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.pair = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(merges)}
        # The same ranks by what is joined and where it is parted, and those of single bytes as a table.
        self.joined: dict[bytes, dict[int, int]] = {}
        for (a, b), r in self.pair.items():
            self.joined.setdefault(a + b, {})[len(a)] = r
        self.of_bytes = [[self.pair.get((bytes([a]), bytes([b])), FAR) for b in range(256)] for a in range(256)]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def parts(self, word: bytes) -> list[int]:
        """Ids of one word."""
        bounds = self._scan(word) if len(word) <= SHORT else self._heap(word)
        ids = self.ids
        return [ids[word[a:b]] for a, b in zip(bounds, bounds[1:])]  # noqa: B905

    def _scan(self, word: bytes) -> list[int]:
        joined, of_bytes = self.joined, self.of_bytes
        bounds = list(range(len(word) + 1))
        ranks = [of_bytes[a][b] for a, b in zip(word, word[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) != FAR:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            start, end = bounds[i], bounds[i + 1]
            if i < len(ranks):
                split = joined.get(word[start : bounds[i + 2]])
                ranks[i] = split.get(end - start, FAR) if split else FAR
            if i:
                before = bounds[i - 1]
                split = joined.get(word[before:end])
                ranks[i - 1] = split.get(start - before, FAR) if split else FAR
        return bounds

    def _heap(self, word: bytes) -> list[int]:
        n = len(word)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        alive = [True] * n

        def rank(a: int) -> int:
            b = after[a]
            return FAR if b >= n else self.pair.get((word[a:b], word[b : after[b]]), FAR)

        todo = [(r, a, a + 1, a + 2) for a in range(n - 1) if (r := rank(a)) != FAR]
        heapq.heapify(todo)
        while todo:
            _, a, b, c = heapq.heappop(todo)
            if not alive[a] or after[a] != b or b >= n or not alive[b] or after[b] != c:
                continue  # one of the two parts has grown meanwhile
            alive[b] = False
            after[a] = c
            if c < n:
                before[c] = a
            for x in (before[a], a):
                if x >= 0 and (r := rank(x)) != FAR:
                    heapq.heappush(todo, (r, x, after[x], after[after[x]]))
        return [a for a in range(n) if alive[a]] + [n]

    def pieces(self, text: str) -> list:
        """Words (str) and ids of added tokens (int) in order."""
        if not self.special or not self.special.search(text):
            return self.words.findall(text)
        out: list = []
        at = 0
        for m in self.special.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.words.findall(text[at:])

    def encode(self, text: str) -> list[int]:
        return [i for x in self.pieces(text) for i in ([x] if isinstance(x, int) else self.parts(x.encode()))]

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


class _Words(dict):
    """Per word: ids as int32 bytes, ids as decimal text, their bytes; long ones aren't kept, all are forgotten when CACHE are held."""

    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe = bpe
        self.digits = {i: str(i) for i in bpe.bytes_of}

    def __missing__(self, word) -> tuple[bytes, str, bytes]:
        ids = [word] if isinstance(word, int) else self.bpe.parts(word.encode())
        entry = array("i", ids).tobytes(), ",".join([self.digits[i] for i in ids]), b"".join([self.bpe.bytes_of[i] for i in ids])
        if len(entry[2]) <= SHORT:
            if len(self) >= CACHE:
                self.clear()
            self[word] = entry
        return entry


@lru_cache(1)
def vocabulary(path: str) -> Bpe:
    """Read once by each Python worker."""
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False, with_place: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text, and token_ids if asked for.

    decoded_sha256 is of what decoding the ids gives; the ids' text is their decimal digits joined by commas. with_place, for
    docs that are files, adds input_part and input_row: the file's name and the row's number in it.
    """

    def make():
        words = _Words(vocabulary(path or default_path()))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, text_sha, packed = [], [], [], []
            for t in batch.column(1):
                found = [words[w] for w in words.bpe.pieces(t.as_py() or "")]
                raw = b"".join([x[0] for x in found])
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
                # The bytes of all ids are joined before they are decoded: a character may span two words.
                text_sha.append(hashlib.sha256(b"".join([x[2] for x in found]).decode("utf-8", errors="replace").encode()).hexdigest())
                if with_ids:
                    packed.append(raw)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32))))
                names.append("token_ids")
            if with_place:
                arrays += [batch.column(2), batch.column(3)]
                names += ["input_part", "input_row"]
            return pa.RecordBatch.from_arrays(arrays, names)

        return step

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids + ", input_part string, input_row long" * with_place
    place = [F.col("_metadata.file_name").alias("input_part"), F.col("_metadata.row_index").alias("input_row")] if with_place else []
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *place), make, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))
