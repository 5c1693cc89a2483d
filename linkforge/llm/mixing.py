"""Mixing sources to target weights by a time-varying curriculum.

Targets: sources, ordered by code point with null last, weigh by a repeating pattern and share the sum of all
sizes; a source's target stops at REPEAT times its size, and what it can't take goes to the others by weight until
none is above. Sorted by size over weight, the sources that stop are a prefix, so one pass of running sums finds the
share of the rest.

Curriculum: each weight has a schedule, piecewise linear over training time 0 to 1. Its integral, scaled to the
source's target, is the source's cumulative token demand. A document's place in its source's stream (whole
passes in the order of a digest, then the documents that fill the rest) is inverted through that demand into
the time at which it is trained on; documents are range-sorted by that position.

Whole documents are taken: floor(target / source size) passes, and one more of those whose middle lies before the rest;
a source's words come within one document's size of its target. Running sums go by slices of the digest
(sums of slices, then inside each slice), so no task orders a whole source. The digest is of doc_id and text, so that
texts under one doc_id, or under none, are in slices of their own.

Nulls: a null text has size 0, a null source is a source of its own, a null doc_id counts as an empty name. Documents of
size 0 are taken 0 times. A row is its own: the rows of a repeated doc_id, and equal rows, are each taken as often as
their own place says. Reruns agree, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkforge.llm.common import checkpointed, read_table, width

PATTERN = (5.0, 2.0, 1.0)
REPEAT = 3
#: (time, weight) knots for each weight of the pattern: broad sources fade, small ones come late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.6, 1.0), (1.0, 1.75)))
#: Hexadecimal digits of the digest that name a slice, and a group of slices: 65536 and 256 of each source.
SLICE_DIGITS, GROUP_DIGITS = 4, 2


def word_count(text: Column) -> Column:
    r"""Runs of [^\x20\x09-\x0D]; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, pattern: tuple[float, ...] = PATTERN, repeat: float = REPEAT) -> DataFrame:
    """source, kind (its place in the pattern), source_size and target, of sized(source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    kind = F.pmod(place, F.lit(len(pattern)))
    weight = F.element_at(F.array(*map(F.lit, pattern)), kind + 1)
    cap = F.lit(float(repeat)) * F.col("source_size")
    rows = sums.select("source", "source_size", kind.alias("kind"), weight.alias("weight"), cap.alias("cap"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, on = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("share", left / F.sum("weight").over(on))
    # A source stops if the share by weight of what is left, when its turn comes, is above its cap.
    rows = rows.withColumn("stops", F.col("share") * F.col("weight") >= F.col("cap"))
    # The first that does not stop sets the level of all that follow; their own shares are lower.
    level = F.max(F.when(~F.col("stops"), F.col("share"))).over(Window.partitionBy())
    return rows.select("source", "kind", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def inverse_demand(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which the schedule has demanded this share, 0 to 1, of all that it demands."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, out, done = sum(areas), F.lit(knots[-1][0]), sum(areas)
    for (t, w), (u, v), area in reversed(list(zip(knots, knots[1:], areas, strict=False))):
        done -= area
        rest, slope = share * total - done, (v - w) / (u - t)
        inside = rest / w if not slope else (F.sqrt(F.greatest(F.lit(w * w) + rest * (2 * slope), F.lit(0.0))) - w) / slope
        out = F.when(share * total < done + area, F.lit(t) + inside).otherwise(out)
    return out


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, its place's digest, and source (never null) and slice as keys."""
    order = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256)
    source = F.col("source").cast("string")
    rows = docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), word_count(F.col("text")).alias("size"), order.alias("order"))
    return rows.withColumns({"of": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "slice": F.substring("order", 1, SLICE_DIGITS)})


def _placed(docs: DataFrame, whole: bool, pattern: tuple[float, ...], repeat: float) -> DataFrame:
    """doc_id, source, size, order, kind, source_size, target, middle (of its place in its source) and copies of every row; whole: also `row`."""
    sized = _sized(docs, F.struct(*docs.columns).alias("row")) if whole else checkpointed(_sized(docs))
    # Sums by source and slice are all that the whole table tells each row.
    sums = checkpointed((_sized(docs) if whole else sized).groupBy("of", "slice").agg(F.any_value("source").alias("source"), F.sum("size").alias("n")))
    aims = targets(sums.select("source", F.col("n").alias("size")), pattern, repeat)
    aims = aims.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("of"), "kind", "source_size", "target")
    # Slices are summed up in groups of their first digits, so that no task orders all slices of a source.
    grouped = sums.withColumn("group", F.substring("slice", 1, GROUP_DIGITS))
    whole_groups = grouped.groupBy("of", "group").agg(F.sum("n").alias("of_group"))
    groups = whole_groups.select("of", "group", (F.sum("of_group").over(Window.partitionBy("of").orderBy("group")) - F.col("of_group")).alias("first"))
    in_group = F.sum("n").over(Window.partitionBy("of", "group").orderBy("slice")) - F.col("n")
    starts = grouped.select("of", "group", "slice", in_group.alias("in_group")).join(groups, ["of", "group"])
    places = starts.select("of", "slice", (F.col("first") + F.col("in_group")).alias("start")).join(aims, "of")
    inside = Window.partitionBy("of", "slice").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sized.withColumn("upto", F.sum("size").over(inside)).join(places, ["of", "slice"])
    middle = F.col("start") + F.col("upto") - F.col("size") / 2
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("middle", middle).withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.col("passes") + (F.col("middle") < F.col("rest")).cast("long"), F.lit(repeat))).cast("int")
    return rows.select(*["row"][: int(whole)], "doc_id", "source", "size", "order", "kind", "source_size", "target", "middle", copies.alias("copies"))


def _position(c: Column, schedules) -> Column:
    """The training time of a row's copy number c."""
    share = F.least((c * F.col("source_size") + F.col("middle")) / F.col("target"), F.lit(1.0))
    out = inverse_demand(share, schedules[0])
    for k in range(1, len(schedules)):
        out = F.when(F.col("kind") == k, inverse_demand(share, schedules[k])).otherwise(out)
    return out


def mix(docs: DataFrame, pattern: tuple[float, ...] = PATTERN, schedules=SCHEDULES, repeat: float = REPEAT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, positions for every row of docs.

    positions: the training time of each copy, ascending; empty for documents that aren't taken. schedules has one for each weight of pattern.
    """
    rows = _placed(docs, False, pattern, repeat)
    # A document sees few copies, so each has its own expression: they stay inside code generation.
    each = F.filter(F.array(*(F.when(F.col("copies") > c, _position(F.lit(c), schedules)) for c in range(int(repeat)))), lambda p: p.isNotNull())
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), each.alias("positions"))


def curriculum(docs: DataFrame, pattern: tuple[float, ...] = PATTERN, schedules=SCHEDULES, repeat: float = REPEAT) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, range-sorted by training position (then by digest).

    Rows go through the running sums whole, so that each keeps its own place whatever else shares its doc_id. The columns are
    those of docs. Written as files, parts in the order of their names and rows in the order of a part are the training
    order; a reader that needs it asks for both (`_metadata.file_name` and `_metadata.row_index`).
    """
    copies = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)))
    taken = _placed(docs, True, pattern, repeat).select("row", "order", "kind", "source_size", "target", "middle", copies.alias("copy"))
    taken = taken.select("row", "order", _position(F.col("copy"), schedules).alias("at"))
    return taken.repartitionByRange(width(docs.sparkSession), "at", "order").sortWithinPartitions("at", "order").select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position")).orderBy("position", "doc_id")


def _curve_sql(share: str, knots) -> str:
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    out, done = f"{knots[-1][0]}::double", sum(areas)
    for (t, w), (u, v), area in reversed(list(zip(knots, knots[1:], areas, strict=False))):
        done -= area
        slope = (v - w) / (u - t)
        rest = f"(({share}) * {sum(areas)}::double - {done}::double)"
        inside = f"{rest} / {w}::double" if not slope else f"(sqrt(greatest({w * w}::double + {rest} * {2 * slope}::double, 0.0::double)) - {w}::double) / {slope}::double"
        out = f"CASE WHEN ({share}) * {sum(areas)}::double < {done + area}::double THEN {t}::double + {inside} ELSE {out} END"
    return out


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, sha256(coalesce(doc_id::varchar, '') || chr(10) || coalesce(text, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::bigint AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS kind
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE kind WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS weight, {REPEAT}.0::double * source_size AS cap FROM s
), c AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w
), t AS (
  SELECT source, kind, source_size, CASE WHEN share * weight >= cap THEN cap ELSE max(share) FILTER (WHERE share * weight < cap) OVER () * weight END AS target FROM c
), p AS (
  SELECT d.doc_id, d.size, t.kind, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0::double AS middle,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(passes + (middle < target - passes * source_size)::int, {REPEAT}) END AS copies FROM p
)
SELECT doc_id, size, source_size, target, (copies * size)::bigint AS taken,
       CASE WHEN copies > 0 THEN CASE kind WHEN 0 THEN {_curve_sql("least(middle / target, 1.0::double)", SCHEDULES[0])}
                                          WHEN 1 THEN {_curve_sql("least(middle / target, 1.0::double)", SCHEDULES[1])}
                                          ELSE {_curve_sql("least(middle / target, 1.0::double)", SCHEDULES[2])} END END AS position
FROM q
"""
