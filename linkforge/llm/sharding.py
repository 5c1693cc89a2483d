"""Jump consistent hashing (Lamping and Veach 2014) in Spark expressions only.

The key's state advances by a 64-bit linear congruential step, and the next candidate shard is
floor((b + 1) * 2^31 / (top 31 bits + 1)) until it passes the shard count. No ring table exists; growing from
n to n + 1 shards moves about one row in n + 1, all of them into the new shard.

The state is kept as two 32-bit halves in longs, so that the multiplication modulo 2^64 never overflows under
ANSI rules. Sizes are UTF-8 bytes plus one; a null text has size 1 and the CRC of no bytes (0); a null doc_id
counts as key 0. Repeated rows each take a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm.common import read_table

#: Fixed: the published generator's multiplier.
MULTIPLIER = 2862933555777941757
MH, ML, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF, 0xFFFFFFFF
#: Jumps that are tried. Their number is about ln(shards); 64 are passed with a chance below 1e-20 for a million shards.
MOST_JUMPS = 64
#: Slices of a shard that number their rows separately.
SLICES = 4096


def _advance(s: Column) -> Column:
    """struct(hi, lo, b, j) after one jump."""
    hi, lo = s["hi"], s["lo"]
    l1, l0, h1, h0 = F.shiftright(lo, 16), lo.bitwiseAND(0xFFFF), F.shiftright(hi, 16), hi.bitwiseAND(0xFFFF)
    low = l0 * ML + F.shiftleft((l1 * ML).bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(l1 * ML, 16)
    cross = h0 * ML + F.shiftleft((h1 * ML).bitwiseAND(0xFFFF), 16)
    new_hi = (carry + (lo * MH).bitwiseAND(LOW) + cross.bitwiseAND(LOW)).bitwiseAND(LOW)
    j = F.floor((s["j"] + 1) * F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + 1))
    return F.struct(new_hi.alias("hi"), low.bitwiseAND(LOW).alias("lo"), s["j"].alias("b"), j.cast("long").alias("j"))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key; a null key counts as 0."""
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(k, 32).alias("hi"), k.bitwiseAND(LOW).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    steps = F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS)))
    return F.aggregate(steps, start, lambda s, _: F.when(s["j"] >= shards, s).otherwise(_advance(s)), lambda s: F.when(s["j"] >= shards, s["b"]).otherwise(s["j"]).cast("int"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs(doc_id, text).

    Slots are gapless from 0 in a shard, by slice (doc_id plus the text's checksum, modulo SLICES) and doc_id. The slices' first
    slots come from counts, a table of shards * SLICES rows at most, which bounds the broadcast; so no task numbers more than
    one slice, texts under one doc_id or under none are in slices of their own, and texts are never shuffled.
    """
    key, raw = F.col("doc_id").cast("long"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(key.alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"))
    place = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0).cast("long")), F.lit(SLICES)) + F.col("text_crc32"), F.lit(SLICES)).cast("int")
    rows = rows.withColumn("slice", place)
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select("shard", "slice", F.expr("sum(n) over (partition by shard order by slice rows between unbounded preceding and current row) - n").alias("first"))
    inside = F.expr("row_number() over (partition by shard, slice order by doc_id, size, text_crc32) - 1")
    numbered = rows.withColumn("at", inside).join(F.broadcast(firsts), ["shard", "slice"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), "grown_shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), 16)


def _crc_table() -> list[int]:
    """CRC-32's remainders of the sixteen half bytes, by its reversed polynomial."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def _crc_sql(text: str) -> str:
    """DuckDB: CRC-32 of a text's UTF-8 bytes, half a byte at a time, the lower half of each first."""
    digits = f"string_split(hex(encode({text})), '')"
    halves = "list_transform(range(0, len(h)), lambda i: (strpos('0123456789ABCDEF', h[CASE i % 2 WHEN 0 THEN i + 2 ELSE i END]) - 1)::bigint)"
    step = f"xor(s >> 4, {_crc_table()}[xor(s & 15, x) + 1]::bigint)"
    return f"(SELECT CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::bigint, {halves}), lambda s, x: {step}), 4294967295::bigint) END FROM (SELECT {digits} AS h))"


def _jumps(shards: int) -> str:
    """DuckDB: the shard of doc_id, by as many steps as can be needed."""
    state = "{'k': (coalesce(doc_id, 0)::hugeint + 18446744073709551616) % 18446744073709551616, 'b': -1::hugeint, 'j': 0::hugeint}"
    step = f"(s.k * {MULTIPLIER} + 1) % 18446744073709551616"
    return (
        f"list_reduce(list_transform(range(0, {min(shards, MOST_JUMPS)} + 1), lambda i: {state}), lambda s, x: CASE WHEN s.j >= {shards} THEN s ELSE "
        f"{{'k': {step}, 'b': s.j, 'j': floor((s.j + 1)::double * 2147483648::double / ((({step}) // 8589934592) + 1)::double)::hugeint}} END)"
    )


OP9_SQL = f"""
WITH r AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::bigint + 1 AS size, coalesce(text, '') AS t,
         {_jumps(16)} AS a, {_jumps(17)} AS g
  FROM documents
), p AS (
  SELECT doc_id, size, {_crc_sql("t")} AS text_crc32, (CASE WHEN a.j >= 16 THEN a.b ELSE a.j END)::int AS shard,
         (CASE WHEN g.j >= 17 THEN g.b ELSE g.j END)::int AS grown_shard
  FROM r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY ((coalesce(doc_id, 0) % {SLICES} + {SLICES}) % {SLICES} + text_crc32) % {SLICES}, doc_id, size, text_crc32)::bigint - 1 AS slot,
       grown_shard
FROM p
"""
