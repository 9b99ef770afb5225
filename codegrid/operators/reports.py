"""Reports (R1-R3): files per language, structure counts per file,
extraction errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRUCTURE_KINDS = ["class", "interface", "enum", "struct", "type", "record", "module", "trait"]


def files_by_language(files: DataFrame) -> DataFrame:
    """Files per (repo, language) plus ROLLUP totals (NULL language =
    repo total, NULL repo = grand total); ``unknown`` is counted too."""
    return (files.rollup("repo", "language").agg(F.count("*").alias("files"))
            .select("repo", "language", "files"))


def structure_counts(files: DataFrame, types: DataFrame, imports: DataFrame, functions: DataFrame,
                     comments: DataFrame, config_keys: DataFrame | None = None,
                     custom_elements: DataFrame | None = None) -> DataFrame:
    """R2: per file the number of types by kind, imports, functions,
    comments, top-level config keys and custom elements; files without
    symbols get zeros (left joins)."""
    base = files.select("repo", F.col("relative_path").alias("file"), "language")
    t = types.groupBy("repo", "file").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in STRUCTURE_KINDS])
    i = imports.groupBy("repo", "file").agg(F.count("*").alias("import_count"))
    f = functions.groupBy("repo", "file").agg(F.count("*").alias("function_count"))
    c = comments.groupBy("repo", "file").agg(F.count("*").alias("comment_count"))
    out = base.join(t, ["repo", "file"], "left").join(i, ["repo", "file"], "left") \
        .join(f, ["repo", "file"], "left").join(c, ["repo", "file"], "left")
    if config_keys is not None:
        out = out.join(config_keys.select("repo", "file", F.col("key_count").alias("config_key_count")),
                       ["repo", "file"], "left")
    else:
        out = out.withColumn("config_key_count", F.lit(0))
    if custom_elements is not None:
        out = out.join(custom_elements.groupBy("repo", "file").agg(F.count("*").alias("custom_element_count")),
                       ["repo", "file"], "left")
    else:
        out = out.withColumn("custom_element_count", F.lit(0))
    counts = [f"{k}_count" for k in STRUCTURE_KINDS] + ["import_count", "function_count", "comment_count",
                                                       "config_key_count", "custom_element_count"]
    return out.select("repo", "file", "language",
                      *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in counts])


def processing_errors(*error_tables: DataFrame) -> DataFrame:
    """Union of the per-stage error rows (repo, file, stage, error)."""
    out = error_tables[0]
    for e in error_tables[1:]:
        out = out.unionByName(e)
    return out
