"""Contexts cut to a budget, and prompts that hold them.

The context of a repo is a table of ordered lines (repo, section, sort_key, line); its text is these lines joined by line breaks. It is cut
into parts of ``budget`` characters without ever being one string: lines are range-sorted over tasks, each slice sums up its characters,
a running total over the slices (one row a repo and slice) gives every slice its start, and the lines inside a slice theirs. A line that
crosses borders gives a piece to each part it reaches. A part is the only value put together, and the budget bounds it, so a repo that
holds most of all lines is spread over as many tasks as its parts and slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textprep import section_array

BUDGET = 32_000


def placed_lines(context: DataFrame, hold) -> DataFrame:
    """(repo, start, text, total): every line with the offset of its first character in its repo's text and that text's length. All lines
    but the first carry the line break before them. Lines that share (section, sort_key) stand in the order of their text; a null line is
    empty. ``hold`` materialises the range-sorted lines, so that a slice is the same rows whenever it is read."""
    lines = context.select("repo", "section", "sort_key", F.coalesce("line", F.lit("")).alias("line"))
    laid = hold(lines.repartitionByRange("repo", "section", "sort_key")
                .select("*", F.spark_partition_id().alias("slice"), (F.length("line") + 1).cast("long").alias("w")))
    repo = Window.partitionBy("repo")
    before = repo.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (laid.groupBy("repo", "slice").agg(F.sum("w").alias("w"))
              .select("repo", "slice", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("off"), (F.sum("w").over(repo) - 1).alias("total")))
    inside = Window.partitionBy("repo", "slice").orderBy("section", "sort_key", "line").rowsBetween(Window.unboundedPreceding, -1)
    out = (laid.withColumn("here", F.coalesce(F.sum("w").over(inside), F.lit(0)))
           .join(slices, ["repo", "slice"]).withColumn("at", F.col("off") + F.col("here")))
    return out.select("repo", F.greatest(F.col("at") - 1, F.lit(0)).alias("start"),
                      F.when(F.col("at") == 0, F.col("line")).otherwise(F.concat(F.lit("\n"), F.col("line"))).alias("text"), "total")


def context_parts(context: DataFrame, hold, budget: int = BUDGET) -> DataFrame:
    """(repo, part, n_parts, context_part): part p holds the characters from p * budget on of the repo's text, ``budget`` of them but in
    the last part. The parts of a repo joined in order are its whole text. A repo whose text is empty has none."""
    if budget < 1:
        raise ValueError("budget must be at least one character")
    at, n, b = F.col("start"), F.length("text"), F.lit(budget)
    part = F.col("part")
    cut = F.greatest(part * b - at, F.lit(0))
    pieces = (placed_lines(context, hold).where(n > 0)
              .select("repo", "start", "text", "total", F.explode(F.sequence(F.floor(at / b), F.floor((at + n - 1) / b))).alias("part"))
              .select("repo", "part", "total", (at + cut).alias("start"),
                      F.col("text").substr((cut + 1).cast("int"), (F.least((part + 1) * b - at, n) - cut).cast("int")).alias("piece")))
    return (pieces.groupBy("repo", "part").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))
            .select("repo", "part", F.ceil(F.col("total") / b).alias("n_parts"), F.array_join("p.piece", "").alias("context_part")))


def section_requests(parts: DataFrame, structure: dict) -> DataFrame:
    """(repo, structure, section_id, parent_id, ord, title, part, n_parts, user_prompt): every section or subsection with a prompt, for every
    part of every repo's context, with that part in the prompt."""
    head = F.concat(F.lit("# Section: "), F.col("s.title"), F.lit("\n\n## Instructions\n"), F.col("s.prompt"),
                    F.lit("\n\n## Codebase Context\n"), F.col("context_part"))
    return (parts.select("repo", "part", "n_parts", "context_part", F.explode(section_array(structure)).alias("s"))
            .select("repo", "s.structure", "s.section_id", "s.parent_id", "s.ord", "s.title", "part", "n_parts", head.alias("user_prompt")))
