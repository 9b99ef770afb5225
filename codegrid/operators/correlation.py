"""Cross-stack correlation (C1-C3): keyword signals of .NET and Node
messaging libraries and Angular front-ends, per file and per repo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import java_re

# FIXED VALUES: keyword lists and the import / using patterns of the rule
DOTNET_KEYWORDS = ["masstransit", "rabbitmq", "rabbitmq.client", "masstransit.rabbitmq"]
NODE_KEYWORDS = ["amqplib", "amqp-connection-manager", "rascal", "@golevelup/nestjs-rabbitmq",
                 "@nestjs/microservices", "rabbitmq"]
JS_IMPORT = r"import\s+(?:[\w*\s{},]+)\s+from\s+['\"]([^'\"]+)['\"]"
JS_REQUIRE = r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"
CS_USING = r"using\s+([\w\.]+)\s*;"
DOTNET = ["csharp", "vbnet", "fsharp"]
NODE = ["javascript", "typescript"]


def _values(files: DataFrame, external: DataFrame) -> DataFrame:
    """(repo, file, language, value): imports by the rule's own patterns
    plus the file's unresolved imports."""
    content = F.col("content")
    arr = (F.when(F.col("language").isin(*NODE),
                  F.concat(F.regexp_extract_all(content, F.lit(java_re(JS_IMPORT)), 1),
                           F.regexp_extract_all(content, F.lit(java_re(JS_REQUIRE)), 1)))
           .when(F.col("language").isin(*DOTNET), F.regexp_extract_all(content, F.lit(java_re(CS_USING)), 1)))
    own = files.select("repo", F.col("relative_path").alias("file"), "language", F.explode(arr).alias("value"))
    ext = (external.join(files.select("repo", F.col("relative_path").alias("file"), "language"), ["repo", "file"])
           .select("repo", "file", "language", F.col("import").alias("value")))
    return own.unionByName(ext)


def messaging_signals(files: DataFrame, external: DataFrame) -> DataFrame:
    """(repo, file, stack, keyword), distinct. The keyword lists are
    constants (10 entries), so the keyword test is a projection, not a join."""
    v = _values(files, external).where(F.col("language").isin(*(DOTNET + NODE)))
    low = F.lower("value")
    kws = (F.when(F.col("language").isin(*DOTNET), F.array(*[F.lit(k) for k in DOTNET_KEYWORDS]))
           .otherwise(F.array(*[F.lit(k) for k in NODE_KEYWORDS])))
    hits = v.select("repo", "file", F.when(F.col("language").isin(*DOTNET), F.lit("dotnet"))
                    .otherwise(F.lit("node")).alias("stack"),
                    F.explode(F.filter(kws, lambda k: low.contains(k))).alias("keyword"))
    return hits.distinct()


def angular_files(files: DataFrame, external: DataFrame) -> DataFrame:
    """TS / JS / HTML files importing ``@angular/`` or under ``/src/app/``."""
    web = files.where(F.col("language").isin("typescript", "javascript", "markup"))
    by_import = (_values(web, external).where(F.lower("value").contains("@angular/"))
                 .select("repo", "file"))
    by_path = (web.where(F.lower("relative_path").contains("/src/app/"))
               .select("repo", F.col("relative_path").alias("file")))
    return by_import.union(by_path).distinct()


def cross_stack_summary(signals: DataFrame, angular: DataFrame) -> DataFrame:
    """Per repo, files per stack, whether both back-end stacks talk over
    messaging, and the summary edges."""
    per_stack = (signals.select("repo", "file", "stack").distinct().groupBy("repo")
                 .agg(F.count_if(F.col("stack") == "dotnet").alias("dotnet_files"),
                      F.count_if(F.col("stack") == "node").alias("node_files")))
    ang = angular.groupBy("repo").agg(F.count("*").alias("angular_files"))
    out = per_stack.join(ang, "repo", "full")
    d, n, a = [F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("dotnet_files", "node_files", "angular_files")]
    edges = F.array_compact(F.array(
        F.when(d > 0, F.lit("DOTNET->MQ")), F.when(n > 0, F.lit("NODE->MQ")),
        F.when((a > 0) & (n > 0), F.lit("ANGULAR->NODE")), F.when((a > 0) & (n == 0), F.lit("ANGULAR->MQ"))))
    return out.select("repo", d.alias("dotnet_files"), n.alias("node_files"), a.alias("angular_files"),
                      ((d > 0) & (n > 0)).alias("detected"), F.array_join(edges, ",").alias("edges"))
