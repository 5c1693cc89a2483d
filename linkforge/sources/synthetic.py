"""Seeded record files for tests: businesses of a first source and their noisy copies in two others, with the truth.

Every choice is a draw from the entity's number, so a seed gives the same rows on any number of partitions. Copies change
case, abbreviate the legal form, lose accents, swap two words, drop a letter or lose the address; chains share a name but not an
address, some names aren't Latin, and some entities have no copy at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.operators.split import draw
from linkforge.sources import tables as T

FIRST = ["Café", "Müller", "São", "Harbour", "Étoile", "Northern", "Blue", "Señor", "Grand", "क्षेत्र", "Quick", "Olde", "東京", "Jägers", "Prime"]
SECOND = ["Bakery", "Motors", "Textiles", "Pharma", "Logistics", "Books", "Optics", "Tools", "Dairy", "Brewery", "Systems", "Foods"]
LEGAL = [("Private Limited", "Pvt Ltd"), ("Limited", "Ltd."), ("Corporation", "Corp"), ("Incorporated", "Inc"), ("& Company", "& Co"), ("", "")]
STREETS = [("Road", "Rd"), ("Street", "St"), ("Avenue", "Ave"), ("Lane", "Ln")]
COUNTRIES = [("US", "us"), ("India", "INDIA"), ("France", "france"), ("", "")]


def _pick(options: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (at % len(options) + 1).cast("int"))


def _entities(spark: SparkSession, n: int, seed: int) -> DataFrame:
    d = lambda k: draw("e", seed=seed + k)
    rows = spark.range(n).select(F.col("id").cast("string").alias("e"), F.col("id").alias("ord"))
    # Every eighth entity belongs to one of a few chains.
    owner = F.when(d(1) % 8 == 0, F.lit("Central Stores")).otherwise(F.concat_ws(" ", _pick(FIRST, d(2)), _pick(SECOND, d(3)), F.concat(F.lit("No"), (d(4) % 97).cast("string"))))
    return rows.select("e", "ord", owner.alias("name"), (d(5) % len(LEGAL)).alias("legal"), (100 + d(6) % 900).alias("number"), _pick(["Oak", "Hill", "Rivière", "Markt", "Lake"], d(7)).alias("street"), (d(8) % len(STREETS)).alias("kind"), (10000 + d(9) % 400).alias("code"), (d(10) % len(COUNTRIES)).alias("country"))


def _written(rows: DataFrame, source: str, short: Column, name: Column, no_address: Column) -> DataFrame:
    form = lambda table, at: F.when(short, _pick([b for _, b in table], at)).otherwise(_pick([a for a, _ in table], at))
    address = F.concat_ws(" ", F.col("number").cast("string"), "street", form(STREETS, F.col("kind")), F.col("code").cast("string"))
    return rows.select(
        F.concat(F.lit(f"{source}-"), F.lpad("e", 9, "0")).alias("entity_id"), F.trim(F.concat_ws(" ", name, form(LEGAL, F.col("legal")))).alias("business_name"),
        F.when(no_address, "").otherwise(address).alias("business_address"), form(COUNTRIES, F.col("country")).alias("country"), "e", "ord",
    )


def generate(spark: SparkSession, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """s1, s2, s3 (the columns of a source, e and ord) and truth(s1, id) of n entities."""
    rows, never = _entities(spark, n, seed), F.lit(False)
    sides = [_written(rows, "S1", never, F.col("name"), never)]
    for k, source in ((2, "S2"), (3, "S3")):
        d = lambda j, k=k: draw("e", seed=seed + 100 * k + j)
        words = F.split("name", " ")
        swapped = F.concat_ws(" ", F.reverse(F.slice(words, 1, 2)), F.array_join(F.slice(words, 3, 9), " "))
        plain = F.translate("name", "éüãñäÉè", "euanaEe")
        typo = F.concat(F.substring("name", 1, 4), F.expr("substring(name, 6)"))
        noisy = F.when(d(1) % 6 == 0, F.upper("name")).when(d(1) % 6 == 1, F.trim(swapped)).when(d(1) % 6 == 2, plain).when(d(1) % 6 == 3, typo).otherwise(F.col("name"))
        sides.append(_written(rows.filter(d(2) % 10 < 7), source, d(3) % 2 == 0, noisy, d(4) % 9 == 0))
    ids = lambda df, name: df.select("e", F.col("entity_id").alias(name))
    truth = ids(sides[0], "s1").join(ids(sides[1], "id").unionByName(ids(sides[2], "id")), "e").select("s1", "id")
    return (*sides, truth)


def write(spark: SparkSession, folder: str, n: int, seed: int = 42, split: str = "train") -> None:
    """source1.tsv to source3.tsv and truth.tsv of a split, as the readers expect them; the folder's name must say that it is synthetic."""
    if "synthetic" not in folder.lower():
        raise ValueError("a synthetic dataset's path must say so")
    *sides, truth = generate(spark, n, seed)
    for k, side in enumerate(sides, 1):
        T.write_tsv(side.orderBy("ord").select(T.SOURCE), f"{folder}/{split}/source{k}.tsv")
    lists = truth.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    named = sides[0].select(F.col("entity_id").alias("s1"), "ord").join(lists, "s1", "left").orderBy("ord")
    T.write_tsv(named.select(F.col("s1").alias(T.TRUTH[0]), F.coalesce("ids", F.lit("")).alias(T.TRUTH[1])), f"{folder}/{split}/truth.tsv")
