"""Driver tables (parquet) and the shared column helpers for file rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import EXTENSIONS
from ..schemas import FILE_COLUMNS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def suffix_of(path: Column) -> Column:
    """Lower-cased last suffix of the file name (``a.min.js`` -> ``.js``),
    ``''`` when the name has no dot or only a leading one."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)
    return F.lower(ext)


def language_of(ext: Column, extensions: dict[str, list[str]] | None = None) -> Column:
    """S6 as a column: first language in configuration order whose
    extension list holds ``ext``; ``unknown`` otherwise. The map is a
    constant of 19 entries: one map lookup per row (``ext`` is evaluated
    once, unlike a CASE chain that repeats it per branch)."""
    first: dict[str, str] = {}
    for lang, exts in (extensions or EXTENSIONS).items():
        for e in exts:
            first.setdefault(e, lang)
    m = F.create_map(*[x for e, lang in first.items() for x in (F.lit(e), F.lit(lang))])
    return F.coalesce(F.element_at(m, ext), F.lit("unknown"))


def files_from(df: DataFrame, repo: Column, relative_path: Column, content: Column,
               root: str = "/corpus") -> DataFrame:
    """Shape any (repo, relative_path, content) rows as a ``files`` table."""
    out = df.select(repo.alias("repo"), relative_path.alias("relative_path"),
                    content.alias("content"))
    ext = suffix_of(F.col("relative_path"))
    return out.select(
        F.col("repo"),
        F.concat(F.lit(root + "/"), F.col("repo"), F.lit("/"), F.col("relative_path")).alias("path"),
        F.col("relative_path"),
        F.element_at(F.split("relative_path", "/"), -1).alias("name"),
        ext.alias("ext"),
        language_of(ext).alias("language"),
        F.col("content"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        F.lit(None).cast("timestamp").alias("modified_at"),
    ).select(*FILE_COLUMNS)
