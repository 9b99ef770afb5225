"""Call graphs (G1) and class interactions.

G1: methods with bodies come from a small ``mapInPandas`` scan (balanced
bodies need offsets); callee detection is a JVM-side regex + semi join on
the methods of the same class. G2 / G3 reuse the member table of the body
pass and are joins and window functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.body import CALL_KEYWORDS, scan_cs_call_methods
from ..functions.rules import java_re

CALL_SITE = r"\b(\w+)\s*\("
JAVA_MEMBER_CALL = r"(\w+(?:\.\w+)*)\s*\.\s*(\w+)\s*\("
CHAIN_SKIP = ["equals", "hashCode", "toString"]


def _method_batches(batches):
    for b in batches:
        rows = []
        for repo, file, content in zip(b["repo"], b["file"], b["content"]):
            for r in scan_cs_call_methods(content or ""):
                rows.append((repo, file) + tuple(r))
        yield pd.DataFrame(rows, columns=["repo", "file", "class", "class_ord", "method", "method_ord", "body"])


def cs_methods(files: DataFrame) -> DataFrame:
    src = (files.where(F.col("language") == "csharp")
           .select("repo", F.col("relative_path").alias("file"), "content"))
    return src.mapInPandas(_method_batches, "repo string, file string, class string, class_ord long, "
                                            "method string, method_ord long, body string")


def call_edges(methods: DataFrame) -> DataFrame:
    """(repo, file, class, caller, callee, n): a method calls a method of its
    own class when ``name(`` occurs in its body; recursion is a self edge;
    overloads repeat an edge (counted in ``n``)."""
    called = (methods.select("repo", "file", "class", "class_ord", "method_ord", F.col("method").alias("caller"),
                             F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(java_re(CALL_SITE)), 1)))
                             .alias("callee"))
              .where(~F.col("callee").isin(*CALL_KEYWORDS)))
    names = methods.select("repo", "file", "class_ord", F.col("method").alias("callee")).distinct()
    hits = called.join(names, ["repo", "file", "class_ord", "callee"], "left_semi")
    return hits.groupBy("repo", "file", "class", "caller", "callee").agg(F.count("*").alias("n"))


def class_interactions(files: DataFrame, members: DataFrame) -> DataFrame:
    """G2 (Java): every ``x.y.m(`` call, for each class of the file that has a
    method ``m``; "from" is the file's first class; rows with from = to are
    dropped. (repo, file, ord, from_class, to_class, method)."""
    java = files.where(F.col("language") == "java")
    calls = java.select("repo", F.col("relative_path").alias("file"),
                        F.posexplode(F.regexp_extract_all("content", F.lit(java_re(JAVA_MEMBER_CALL)), 2))
                        .alias("pos", "method"))
    classes = members.where((F.col("member_kind") == "type") & (F.col("type_kind") == "class"))
    first = classes.groupBy("repo", "file").agg(F.min_by("type", "type_ord").alias("from_class"))
    meths = (members.where((F.col("member_kind") == "method") & (F.col("type_kind") == "class"))
             .select("repo", "file", F.col("type").alias("to_class"), "type_ord", F.col("name").alias("method"))
             .distinct())
    hits = (calls.join(meths, ["repo", "file", "method"]).join(first, ["repo", "file"])
            .where(F.col("from_class") != F.col("to_class")))
    w = Window.partitionBy("repo", "file").orderBy("pos", "type_ord")
    return hits.select("repo", "file", (F.row_number().over(w) - 1).cast("long").alias("ord"),
                       "from_class", "to_class", "method")


def class_chain(members: DataFrame, max_classes: int | None = None) -> DataFrame:
    """The classes of each Java file (with ``max_classes``, its first ones) as consecutive
    pairs, labelled with the target's first public (or unmodified) method
    other than equals / hashCode / toString, else ``process``.
    (repo, file, pos, from_class, to_class, method)."""
    classes = (members.where((F.col("member_kind") == "type") & (F.col("type_kind") == "class")
                             & (F.col("language") == "java"))
               .select("repo", "file", F.col("type").alias("cls"), "type_ord"))
    if max_classes is not None:
        classes = classes.where(F.col("type_ord") < max_classes)
    label = (members.where((F.col("member_kind") == "method") & (F.col("type_kind") == "class")
                           & (F.col("language") == "java") & ~F.col("name").isin(*CHAIN_SKIP)
                           & (F.array_contains("modifiers", "public") | (F.size("modifiers") == 0)))
             .groupBy("repo", "file", "type_ord").agg(F.min_by("name", "ord").alias("method")))
    w = Window.partitionBy("repo", "file").orderBy("type_ord")
    pairs = (classes.withColumn("to_class", F.lead("cls").over(w))
             .withColumn("to_ord", F.lead("type_ord").over(w)).where(F.col("to_class").isNotNull()))
    out = pairs.join(label.withColumnRenamed("type_ord", "to_ord"), ["repo", "file", "to_ord"], "left")
    return out.select("repo", "file", F.col("type_ord").alias("pos"), F.col("cls").alias("from_class"),
                      "to_class", F.coalesce("method", F.lit("process")).alias("method"))
