"""Posting tables: one long DataFrame (route, key, id, source, ord), exploded from one scan of the targets.

Limits of a bucket depend on its key alone, so they are applied once, before any query joins: a key as frequent as
a third of all rows is a bucket of its limit's size by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.functions import text as X

#: The largest limit of any bucket; a literal lets Spark drop rows before the shuffle.
MOST = 800


def _keys(route: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(route).alias("route"), k.alias("key")))


def _one(route: str, key: Column) -> Column:
    return _keys(route, F.array_compact(F.array(F.when(key != "", key))))


def unordered_pairs(items: Column, glue: str) -> Column:
    """All pairs of an array's elements, the lesser first."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.concat(F.least(a, b), F.lit(glue), F.greatest(a, b)))))


def products(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit("#"), b))))


def _emit(records: DataFrame, arrays: list[Column]) -> DataFrame:
    key = F.explode(F.concat(*arrays)).alias("k")
    return records.select("id", "source", "ord", key).select("k.route", "k.key", "id", "source", "ord")


def postings_v1(records: DataFrame) -> DataFrame:
    """name, prefix of 3, every significant token and number with repeats."""
    name, addr = F.col("name_norm"), F.col("addr_norm")
    return _emit(records, [_one("name", name), _one("prefix", X.prefix(name, 3)), _keys("token", X.sig_tokens_v1(name)), _keys("num", X.nums(addr))])


def postings_v2(records: DataFrame) -> DataFrame:
    """name, prefix of 4 (from 3 characters on), distinct tokens, sorted signature, numbers with repeats."""
    name, addr = F.col("name_norm"), F.col("addr_norm")
    return _emit(records, [_one("name", name), _one("prefix", X.prefix(name, 4, 3)), _keys("token", F.array_distinct(X.sig_tokens(name))), _one("sig", X.sorted_sig(name)), _keys("num", X.nums(addr))])


def postings_pair(records: DataFrame) -> DataFrame:
    """Pairs of the first 8 distinct tokens, and each with the first 6 distinct numbers."""
    toks = F.slice(F.array_distinct(X.sig_tokens(F.col("name_norm"))), 1, 8)
    numbers = F.slice(F.array_distinct(X.nums(F.col("addr_norm"))), 1, 6)
    return _emit(records, [_keys("pair", unordered_pairs(toks, "|")), _keys("toknum", products(toks, numbers))])


def postings_aux(records: DataFrame) -> DataFrame:
    """Number and address token, pairs of numbers, 8-character prefix."""
    numbers = F.slice(F.array_distinct(X.nums(F.col("addr_norm"))), 1, 3)
    return _emit(records, [_keys("numtok", products(numbers, X.addr_tokens(F.col("addr_norm")))), _keys("numnum", unordered_pairs(numbers, "#")), _one("cpre8", X.prefix(F.col("name_norm"), 8, 8))])


def postings_a(records: DataFrame) -> DataFrame:
    """First generation: sets of token (from 3 letters), prefix of 3, number (from 3 digits) and country."""
    name, addr = F.col("name_norm"), F.col("addr_norm")
    toks = F.filter(X.significant_tokens(name), lambda t: F.length(t) >= 3)
    return _emit(records, [_keys("token", F.array_distinct(toks)), _one("prefix", X.prefix(name, 3)), _keys("num", F.array_distinct(X.nums(addr))), _one("country", F.col("country_key"))])


def postings_b(records: DataFrame) -> DataFrame:
    """Second generation: name, prefix of 3 (of the name before legal forms are spelled out, where records have it), tokens and numbers with repeats."""
    name, addr = F.col("name_norm"), F.col("addr_norm")
    toks = F.filter(X.significant_tokens(name), lambda t: F.length(t) >= 3)
    return _emit(records, [_one("name", name), _one("prefix", X.prefix(F.col("name_key" if "name_key" in records.columns else "name_norm"), 3)), _keys("token", toks), _keys("num", X.nums(addr))])


def token_df(postings: DataFrame) -> DataFrame:
    """How many targets have each token."""
    return postings.filter("route = 'token'").groupBy("key").agg(F.countDistinct("id").alias("df"))


def token_limit(df: Column) -> Column:
    return F.when(df <= MOST, F.least(F.lit(2000), F.greatest(F.lit(80), df))).otherwise(40).cast("int")


def _limit(limits: dict[str, int], df: Column) -> Column:
    """A route's limit; a route that isn't listed goes by the token rule."""
    table = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.col("route")), token_limit(df))


def limit_plain(postings: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first rows of each bucket in (source, ord) order, up to its limit."""
    rank = F.row_number().over(Window.partitionBy("route", "key").orderBy("source", "ord", "id"))
    sized = postings.groupBy("route", "key").agg(F.countDistinct("id").alias("df"))
    cut = postings.withColumn("rn", rank).filter(F.col("rn") <= MOST)
    return cut.join(sized, ["route", "key"]).filter(F.col("rn") <= _limit(limits, F.col("df"))).drop("rn", "df")


def limit_balanced(postings: DataFrame, limits: dict[str, int]) -> DataFrame:
    """A bucket's first rows, shared by the two sources when both can't be kept whole."""
    rank = F.row_number().over(Window.partitionBy("route", "key", "source").orderBy("ord", "id"))
    counts = postings.groupBy("route", "key").agg(F.sum((F.col("source") == "S2").cast("int")).alias("c2"), F.sum((F.col("source") == "S3").cast("int")).alias("c3"), F.countDistinct("id").alias("df"))
    most = counts.select("route", "key", "c2", "c3", _limit(limits, F.col("df")).alias("most"))
    s2, s3 = F.least("c2", "most"), F.least("c3", "most")
    n3 = F.when(s2 + s3 <= F.col("most"), s3).otherwise(F.least(s3, F.greatest(F.floor(F.col("most") / 2), F.col("most") - s2)))
    shares = most.select("route", "key", n3.alias("n3"), F.when(s2 + s3 <= F.col("most"), s2).otherwise(F.col("most") - n3).alias("n2"))
    cut = postings.withColumn("rn", rank).filter(F.col("rn") <= MOST)
    kept = F.when(F.col("source") == "S2", F.col("rn") <= F.col("n2")).otherwise(F.col("rn") <= F.col("n3"))
    return cut.join(shares, ["route", "key"]).filter(kept).drop("rn", "n2", "n3")


def assert_complete(records: DataFrame, expected: int) -> DataFrame:
    """Fails unless the build has exactly the expected rows and unique ids."""
    n, ids = records.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    if (n, ids) != (expected, expected):
        raise ValueError(f"index has {n} rows and {ids} ids, expected {expected}")
    return records
