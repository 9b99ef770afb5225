"""Symbol extraction (P1-P4, P8-P10) as JVM-side regex jobs.

Every table here is a narrow projection of ``files``: a CASE on
``language`` picks the language's pattern (only that branch is evaluated
per row), ``regexp_extract_all`` returns the matches, ``posexplode`` turns
them into rows. No Python worker is involved; the plans stay inside
whole-stage codegen and never shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import (COMMENT_RULES, INHERITS_KINDS, LANG_RULES, MARKUP_TAG,
                               java_re)

def _key() -> list:
    return ["repo", F.col("relative_path").alias("file"), "language"]


def _by_language(branches: dict[str, Column], default: Column) -> Column:
    expr = None
    for lang, value in branches.items():
        cond = F.col("language") == lang
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return default if expr is None else expr.otherwise(default)


def _all(pattern: str, group: int, src: str = "content") -> Column:
    return F.regexp_extract_all(F.col(src), F.lit(java_re(pattern)), group)


# ------------------------------------------------------------------- P1
def extract_units(files: DataFrame, rules: dict | None = None) -> DataFrame:
    """units(repo, file, language, namespace): first namespace / package.
    ``rules`` overrides the language rule table (U1 plug-ins)."""
    ns = _by_language(
        {lang: F.regexp_extract("content", java_re(r["namespace"]), 1)
         for lang, r in (rules or LANG_RULES).items() if r.get("namespace")},
        F.lit(None).cast("string"))
    return files.select(*_key(), F.nullif(ns, F.lit("")).alias("namespace"))


# ------------------------------------------------------------------- P2
def import_arrays(files: DataFrame) -> Column:
    branches = {}
    for lang, r in LANG_RULES.items():
        if r["imports"]:
            arrays = [_all(p, 1) for p in r["imports"]]
            branches[lang] = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    return _by_language(branches, F.array().cast("array<string>"))


def extract_imports(files: DataFrame) -> DataFrame:
    """imports(repo, file, language, ord, import) in text order."""
    return (files.select(*_key(), F.posexplode(import_arrays(files)).alias("ord", "import"))
            .withColumn("ord", F.col("ord").cast("long")))


# ------------------------------------------------------------------- P3/P4
def _keyword(pattern: str) -> tuple[str, str | None]:
    """A header pattern without its optional words in front, and the keyword it then starts with. The words in front are not captured and
    hold no keyword, so the same headers are found; a pattern that starts with letters is searched for them in long steps.
    Patterns of another form are left as they are; they and those that ignore case have no keyword."""
    m = re.match(r"(\(\?i\))?(?:\(\?:[A-Za-z|]+\)\?\\s\*|\(\?:[a-z]+\\s\+\)\?)?(?=([A-Za-z]+))", pattern)
    return (pattern, None) if m is None else ((m[1] or "") + pattern[m.end():], None if m[1] else m[2])


def _type_array(lang: str, kind: str, pattern: str, g_name: int, g_ext: int, g_impl: int) -> Column:
    """Headers are searched once, then taken apart: a group of a whole match is the group of the pattern on the match alone."""
    pattern, keyword = _keyword(pattern)
    rx = F.lit(java_re(pattern))
    found = F.regexp_extract_all(F.col("content"), rx, 0)
    if keyword:
        found = F.when(F.contains(F.col("content"), F.lit(keyword)), found).otherwise(F.array().cast("array<string>"))

    def group(header: Column, g: int) -> Column:
        return F.regexp_extract(header, java_re(pattern), g) if g else F.lit("")
    return F.transform(found, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), group(x, g_name).alias("name"), i.cast("long").alias("ord"),
        group(x, g_ext).alias("extends_list"), group(x, g_impl).alias("implements_list")))


def type_headers(files: DataFrame) -> DataFrame:
    """One row per type header: kind, name, ord (within kind), raw parent lists."""
    branches = {}
    for lang, r in LANG_RULES.items():
        if r["types"]:
            arrays = [_type_array(lang, *t) for t in r["types"]]
            branches[lang] = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    arr = _by_language(branches, F.lit(None))
    return (files.select(*_key(), F.explode(arr).alias("t"))
            .select("repo", "file", "language", "t.*"))


def extract_types(files: DataFrame) -> DataFrame:
    """types(repo, file, language, kind, name, ord)."""
    return type_headers(files).select("repo", "file", "language", "kind", "name", "ord")


def strip_space(x) -> Column:
    """Without white space of any kind (line breaks too) at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def extract_heritage(files: DataFrame) -> DataFrame:
    """heritage(repo, file, language, kind, type, relation, ord, parent).

    Parent lists are split on every comma and trimmed (so generic bases
    split inside ``<...>``, as the reference does)."""
    return _heritage(type_headers(files))


def _heritage(h: DataFrame) -> DataFrame:
    ext_rel = F.lit("extends")
    for lang, kind in INHERITS_KINDS:
        ext_rel = F.when((F.col("language") == lang) & (F.col("kind") == kind),
                         F.lit("inherits")).otherwise(ext_rel)
    parts = F.concat(
        F.transform(F.split(F.col("extends_list"), ","),
                    lambda x: F.struct(ext_rel.alias("relation"), strip_space(x).alias("parent"))),
        F.transform(F.split(F.col("implements_list"), ","),
                    lambda x: F.struct(F.lit("implements").alias("relation"), strip_space(x).alias("parent"))))
    out = h.select("repo", "file", "language", "kind", F.col("name").alias("type"),
                   F.posexplode(F.filter(parts, lambda s: s["parent"] != "")).alias("pos", "h"))
    return out.select("repo", "file", "language", "kind", "type", "h.relation",
                      F.col("pos").cast("long").alias("ord"), "h.parent")


# ------------------------------------------------------------------- one pass
def symbol_table(files: DataFrame) -> DataFrame:
    """One narrow row per file with its namespace, import list and type
    headers, computed in a single pass over the content; units, imports
    and types are projections of it, so the (large) content column is read
    once however many symbol tables a job needs."""
    ns = _by_language(
        {lang: F.regexp_extract("content", java_re(r["namespace"]), 1)
         for lang, r in LANG_RULES.items() if r.get("namespace")},
        F.lit(None).cast("string"))
    branches = {}
    for lang, r in LANG_RULES.items():
        if r["types"]:
            arrays = [_type_array(lang, *t) for t in r["types"]]
            branches[lang] = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    types = _by_language(branches, F.lit(None))
    return files.select(*_key(), F.nullif(ns, F.lit("")).alias("namespace"),
                        import_arrays(files).alias("imports"), types.alias("types"))


def units_of(table: DataFrame) -> DataFrame:
    return table.select("repo", "file", "language", "namespace")


def imports_of(table: DataFrame) -> DataFrame:
    return (table.select("repo", "file", "language", F.posexplode("imports").alias("ord", "import"))
            .withColumn("ord", F.col("ord").cast("long")))


def import_lists(table: DataFrame) -> DataFrame:
    """(repo, file, i): the imports of a file as one list of (ord, import) in text order; files without any give no row."""
    listed = F.transform("imports", lambda x, i: F.struct(i.cast("long").alias("ord"), x.alias("import")))
    return (table.where(F.size("imports") > 0).groupBy("repo", "file")
            .agg(F.array_sort(F.flatten(F.collect_list(listed))).alias("i")))


def heritage_of(table: DataFrame) -> DataFrame:
    return _heritage(table.select("repo", "file", "language", F.explode("types").alias("t")).select("repo", "file", "language", "t.*"))


def types_of(table: DataFrame) -> DataFrame:
    return (table.select("repo", "file", "language", "namespace", F.explode("types").alias("t"))
            .select("repo", "file", "language", "t.kind", "t.name", "t.ord", "namespace"))


# ------------------------------------------------------------------- P8
def extract_functions(files: DataFrame) -> DataFrame:
    """functions(repo, file, language, ord, name) for JS/TS/F# (declarations
    first, then arrow functions). PHP functions come from the body pass."""
    branches = {}
    for lang, r in LANG_RULES.items():
        pats = r.get("functions")
        if not pats:
            continue
        arrays = [_all(p, 1) for p in pats]
        arr = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
        skip = r.get("function_skip") or []
        if skip:
            arr = F.filter(arr, lambda x: ~x.isin(*skip))
        branches[lang] = arr
    return (files.select(*_key(), F.posexplode(_by_language(branches, F.lit(None)))
                         .alias("ord", "name"))
            .withColumn("ord", F.col("ord").cast("long")))


# ------------------------------------------------------------------- P9
def clean_comment(text: Column, style: Column) -> Column:
    """Strip comment markers and a leading ``*`` on each line."""
    t = strip_space(text)
    c_like = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^//\s*", ""), r"^/\*\s*", ""),
                              r"\s*\*/$", "")
    fs_like = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^//\s*", ""), r"^\(\*\s*", ""),
                               r"\s*\*\)$", "")
    vb_like = F.regexp_replace(F.regexp_replace(t, r"^'\s*", ""), r"(?i)^REM\s+", "")
    out = (F.when(style == "vb", vb_like).when(style == "fs", fs_like)
           .when(style == "html", t).otherwise(c_like))
    out = F.when(style.isin("c", "fs"), F.regexp_replace(out, r"(?m)^\*\s*", "")).otherwise(out)
    return strip_space(out)


def extract_comments(files: DataFrame) -> DataFrame:
    """comments(repo, file, language, ord, text, clean): line comments
    first, then block comments; HTML gives the inner text."""
    styles = {lang: r["comments"] for lang, r in LANG_RULES.items()}
    branches = {}
    for lang, style in styles.items():
        pats = COMMENT_RULES[style]
        group = 1 if style == "html" else 0
        arrays = [_all(p, group) for p in pats]
        branches[lang] = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    style_col = _by_language({k: F.lit(v) for k, v in styles.items()}, F.lit("c"))
    out = files.select(*_key(), style_col.alias("style"),
                       F.posexplode(_by_language(branches, F.lit(None))).alias("ord", "text"))
    return out.select("repo", "file", "language", F.col("ord").cast("long").alias("ord"), "text",
                      clean_comment(F.col("text"), F.col("style")).alias("clean"))


# ------------------------------------------------------------------- P10
def extract_markup_tags(files: DataFrame) -> DataFrame:
    """markup_tags(repo, file, ord, tag, is_custom) for HTML files."""
    m = files.where(F.col("language") == "markup")
    out = m.select(*_key(), F.posexplode(_all(MARKUP_TAG, 1)).alias("ord", "tag"))
    return out.select("repo", "file", F.col("ord").cast("long").alias("ord"), "tag",
                      F.col("tag").contains("-").alias("is_custom"))


def custom_elements(files: DataFrame) -> DataFrame:
    """Distinct tags containing ``-`` per file."""
    return (extract_markup_tags(files).where("is_custom")
            .select("repo", "file", "tag").distinct())


# ------------------------------------------------------------------- P11
def _yaml_batches(batches):
    import pandas as pd

    from ..functions.config import parse_config, top_level_keys
    for b in batches:
        types, keys = [], []
        for text in b["content"]:
            t, data = parse_config(text or "")
            types.append(t)
            keys.append(top_level_keys(data))
        yield pd.DataFrame({"repo": b["repo"], "file": b["file"], "config_type": types, "keys": keys})


def extract_config_keys(files: DataFrame) -> DataFrame:
    """config_keys(repo, file, config_type, key_count, keys): JSON is parsed
    on the JVM; only the rest (YAML or neither) reaches PyYAML."""
    cfg = (files.where(F.col("language") == "config")
           .select("repo", F.col("relative_path").alias("file"), "content",
                   F.try_parse_json("content").isNotNull().alias("is_json")))
    js = cfg.where("is_json").select(
        "repo", "file", F.lit("json").alias("config_type"),
        F.coalesce(F.array_distinct(F.json_object_keys("content")), F.array().cast("array<string>")).alias("keys"))
    rest = (cfg.where(~F.col("is_json")).select("repo", "file", "content")
            .mapInPandas(_yaml_batches, "repo string, file string, config_type string, keys array<string>"))
    return js.unionByName(rest).select("repo", "file", "config_type",
                                       F.size("keys").cast("long").alias("key_count"),
                                       F.array_join("keys", ",").alias("keys"))
