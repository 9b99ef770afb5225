"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's share of all words, at most ``MOST`` times its own words; what a capped source leaves is
shared among the others by weight until none is above. Every document of a source is expected target / size times. The
expectations are summed up along the source, from one random start in [0, 1), and a document is emitted once for every whole number
its stretch crosses: the floor or the ceiling of its expectation, so never more than MOST times.

Along a source documents stand by size, then by the MD5 of their id, so neighbours differ little and the words taken miss
the target by less than the largest document. A place is never counted by one task alone: document counts by (source, size,
slice of ids) are summed first, the running total goes over these counts, and ranks are only taken inside a slice, whose
number of documents is bounded.

Null texts have size 0 and stand first; a null source is a source of its own, last in order. Documents of size 0 are
emitted like any other and add no words. Repeated rows are documents of their own. No words at all: targets are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codegrid.llm.common import staged

MOST = 3
SLICE = 4096
#: a number in [0, 1) from 32 bits of an MD5; DuckDB gives the same
_UNIT = "cast(conv(substr(md5(cast({} as binary)), 1, 8), 16, 10) as double) / 4294967296.0"


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from one row per source. With sources ordered by cap / weight, those capped are a
    prefix; the rest share what is left in proportion to their weights."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("i", (F.row_number().over(by_name) - 1) % len(weights))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("i").cast("int") + 1))
    s = s.withColumn("cap", F.col("source_size") * float(MOST))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumns({"total": F.sum("source_size").over(whole), "used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
                       "w_left": F.sum("w").over(rest)})
    # what a unit of weight would get if all sources before this one were capped; the first that is not capped fixes it
    s = s.withColumn("level", (F.col("total") - F.col("used")) / F.col("w_left"))
    s = s.withColumn("free", F.col("level") <= F.col("cap") / F.col("w"))
    s = s.withColumn("unit", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"),
                    F.least("cap", F.col("w") * F.coalesce("unit", F.lit(float("inf")))).alias("target"))


def mix(docs: DataFrame, weights: tuple = (1, 2, 3), carry: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, ...), or its columns ``carry``, with size, source_size, target, copies and taken, one row
    per row."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    name = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*name).alias("row"), F.col("source").cast("string").alias("source"), size.alias("size"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("tie"))
    flat = rows.select("source", "size", "tie")
    per_size = flat.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    goal = targets(per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights)
    # slices of the ids within one size, so many that each holds about SLICE documents
    sliced = "cast(floor(" + _UNIT.format("tie") + " * ceil(n / %d)) as int)" % SLICE
    rows = _same(rows, per_size, ["source", "size"]).withColumn("slice", F.expr(sliced.replace("md5(cast(tie as binary))", "tie")))
    counts = rows.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("m"))
    along = Window.partitionBy("source").orderBy("size", "slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("m").over(along), F.lit(0))).drop("m")
    placed = _same(rows.drop("n"), _same(counts, goal, ["source"]), ["source", "size", "slice"])
    inside = Window.partitionBy("source", "size", "slice").orderBy("tie")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.expr(_UNIT.format("coalesce(concat('s', source), '')"))
    placed = placed.withColumn("place", F.col("before") + F.row_number().over(inside))
    copies = F.floor(start + F.col("place") * rate) - F.floor(start + (F.col("place") - 1) * rate)
    placed = placed.withColumn("copies", copies.cast("long"))
    clash = {"size", "source_size", "target", "copies", "taken"}
    keep = [F.col(f"row.`{c}`") for c in name if c not in clash]
    return placed.select(*keep, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys of which ``source`` may be null."""
    right = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]).drop(*[f"r_{k}" for k in keys])


def emitted(docs: DataFrame, weights: tuple = (1, 2, 3)) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``: each as many times as it is taken. Copies are counted over narrow rows
    (a key, source, size and tie); whole rows are written once and move once, in the join on the key."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("__key"), F.struct(*docs.columns).alias("__row")), "mix-rows")
    narrow = rows.select("__key", "__row.doc_id", "__row.text", "__row.source")
    taken = mix(narrow, weights, ["__key"]).where("copies > 0").select("__key", "copies")
    return rows.join(taken, "__key").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
