"""URL filter: listed host/path rules first, association rules mined from labels for the rest.

Listed rules (host suffix, path prefix, verdict) are few and given by the caller; the longest that fits wins. For other pages,
Spark's FP-growth mines the token combinations of labelled pages' URLs together with their label; rules ``tokens -> block`` are kept with
``min_support`` (and ``min_rows`` pages) and ``min_confidence``, and only if no rule on fewer of the same tokens is at least as confident. They are matched through an inverted
index: token -> rules, a rule fires on a URL that holds all its tokens, counted per distinct token set. The verdict is block if a rule
fires, else allow.

Hosts: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; paths: from there up to ``?``, ``#`` or the end. Null
URLs and those without ``://`` have empty host and path and no tokens, so they are allowed. Repeated page ids are judged row by row. Without labelled pages no
rules are mined. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from codegrid.llm.common import staged

#: the item that marks a blocked row; itemsets of any length are mined
LABEL = "label:block"
SALTS = 32


def parts(url: str = "url") -> tuple:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, letters, letters.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def listed(host, path, rules: list[tuple[str, str, str]]) -> tuple:
    """(rule, verdict) of the longest listed rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(host, path) -> F.Column:
    """Distinct tokens: the host's labels, the path's segments (lower-cased)."""
    names = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    steps = F.transform(F.split(F.lower(path), r"[/.]+"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(names, steps), lambda x: F.length(x) > 2))


def spread(items: DataFrame, by: str, side: DataFrame) -> DataFrame:
    """``items`` joined with ``side`` on their token, each token dealt over ``SALTS`` tasks by the column ``by``: a token that
    a third of all URLs hold is not one task's work. ``side`` (a few rows a frequent token) goes to each of them."""
    items = items.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return items.join(side, ["token", "salt"]).drop("salt")


def mine(labelled: DataFrame, *, min_support: float, min_confidence: float, min_rows: int = 10) -> DataFrame:
    """(rule_id, tokens, confidence, support) from ``labelled`` (tokens, block). Infrequent tokens go before FP-growth sees them."""
    # numbered once: the numbers would not survive a second computation of the rows
    rows = staged(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "block"), "url-labelled")
    n = rows.count()
    least = max(float(min_rows), min_support * n)
    flat = rows.select("row", "block", F.explode("tokens").alias("token"))
    # a rule that is frequent with its label has only tokens that are
    useful = flat.where("block").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("token")
    baskets = spread(flat, "row", useful).groupBy("row").agg(F.sort_array(F.collect_set("token")).alias("items"))
    baskets = rows.select("row", "block").join(baskets, "row").select(
        F.when(F.col("block"), F.array_append("items", F.lit(LABEL))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(n, 1)), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(LABEL)))
    found = found.select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    found = staged(found.withColumn("rule_id", F.xxhash64("tokens")), "url-rules")
    # a rule goes if one of its tokens less is as sure
    shorter = (found.select("rule_id", "confidence", F.explode(F.expr(
        "transform(tokens, x -> xxhash64(array_except(tokens, array(x))))")).alias("other"))
        .join(found.select(F.col("rule_id").alias("other"), F.col("confidence").alias("c")), "other").where("c >= confidence").select("rule_id").distinct())
    return found.join(shorter, "rule_id", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], *, min_support: float = 0.001,
          min_confidence: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url); ``labels``: page_id, block."""
    host, path = parts()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", tokens(F.col("host"), F.col("path")))
    known = labels.where("page_id IS NOT NULL AND block IS NOT NULL").groupBy("page_id").agg(F.max("block").alias("block"))
    mined = staged(mine(rows.join(known, "page_id").select("tokens", "block"), min_support=min_support, min_confidence=min_confidence), "url-mined")
    index = mined.select("rule_id", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "listed": verdict, "key": F.xxhash64("tokens")})
    distinct = rows.where("listed IS NULL").groupBy("key").agg(F.first("tokens").alias("tokens"))
    # distinct token sets are matched, each once
    hits = (spread(distinct.select("key", F.explode("tokens").alias("token")), "key", index)
            .groupBy("key", "rule_id").agg(F.count(F.lit(1)).alias("got"), F.first("need").alias("need")).where("got = need")
            .select("key").distinct().withColumn("fires", F.lit(True)))
    out = rows.join(hits, "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("fires"), "block").otherwise("allow")).alias("verdict"))
