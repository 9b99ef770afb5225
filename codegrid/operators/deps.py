"""Dependency graph (D1-D7, D9-D13; cycles are in ``cycles``) as joins and aggregations.

Imports resolve per *distinct* ``(repo, import)`` value, never per file:
the thousands of files that import the same name share one resolution,
which is then joined back. Indexes never cross repos (``repo`` is part of
every join key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import EXTENSIONS
from ..plans.materialize import reuse

# languages whose imports are resolved; rule 3 (package -> all its files)
# applies to the first four only
RESOLVING = ["java", "csharp", "vbnet", "fsharp", "php"]
PACKAGE_RULE = ["java", "csharp", "vbnet", "fsharp"]
DOTTED = ["java", "csharp", "vbnet", "fsharp"]
# type kinds that enter the index (classes before interfaces); F# reports
# neither list, so its types are not indexed
INDEXED_KINDS = {"class": 0, "interface": 1}
NOT_INDEXED_LANGS = ["fsharp", "markup", "config"]


def analyzable(files: DataFrame) -> DataFrame:
    """Rows of a supported language (``unknown`` and others dropped)."""
    return files.where(F.col("language").isin(*EXTENSIONS.keys()))


# ------------------------------------------------------------------ D1
def type_entries(types: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Index entries (repo, key, file, pos, kind, name), full and short keys.

    ``units`` gives the namespaces unless ``types`` has them. ``pos`` orders entries as they are inserted: file order, classes then
    interfaces, header order, full name before short name."""
    kinds = F.create_map(*[x for k, v in INDEXED_KINDS.items() for x in (F.lit(k), F.lit(v))])
    t = types.where(F.col("kind").isin(*INDEXED_KINDS) & ~F.col("language").isin(*NOT_INDEXED_LANGS))
    if "namespace" not in types.columns:
        t = t.join(units.select("repo", "file", "namespace"), ["repo", "file"], "left")
    t = t.withColumn("kind_ord", kinds[F.col("kind")])
    ns = F.col("namespace")
    full = (F.when(ns.isNull(), F.col("name"))
            .when(F.col("language").isin(*DOTTED), F.concat(ns, F.lit("."), F.col("name")))
            .when(F.col("language") == "php", F.concat(F.lit("\\"), ns, F.lit("\\"), F.col("name")))
            .otherwise(F.col("name")))

    def pos(short: int):
        return F.struct(F.col("file"), F.col("kind_ord"), F.col("ord"), F.lit(short).alias("short"))
    return (t.select("repo", full.alias("key"), "file", pos(0).alias("pos"), "kind", "name")
            .unionByName(t.select("repo", F.col("name").alias("key"), "file", pos(1).alias("pos"),
                                  "kind", "name")))


def build_type_index(entries: DataFrame) -> DataFrame:
    """type_index(repo, key, file, first_pos): last writer wins the value,
    the first insertion fixes the key's position (dict semantics)."""
    return (entries.groupBy("repo", "key")
            .agg(F.max_by("file", "pos").alias("file"), F.min("pos").alias("first_pos")))


# ------------------------------------------------------------------ D2
def build_package_index(units: DataFrame) -> DataFrame:
    """(repo, package, file): every file of a namespace / package."""
    return (units.where(F.col("namespace").isNotNull())
            .select("repo", F.col("namespace").alias("package"), "file"))


# ------------------------------------------------------------------ D3
def _clean_import(c):
    s = F.trim(c)
    return F.when(s.endswith(".*"), F.expr("substring(trim(`import`), 1, length(trim(`import`)) - 2)")) \
        .otherwise(s)


def import_rules(wanted: DataFrame, index: DataFrame, packages: DataFrame) -> DataFrame:
    """Resolve distinct (repo, imp, pkg_rule) values.

    Returns (repo, imp, pkg_rule, rule, target); rule 1 exact key, 2 last
    dotted segment, 3 package (its files are the targets, the column is
    null), 4 first index key (insertion order) containing the import. Rules
    1-3 are probed side by side (each gives at most one hit per import), the
    lowest rule wins, and rule 4 runs on the rest. One row per import that
    resolves."""
    idx = index.select("repo", "key", F.col("file").alias("target"))
    r1 = (wanted.join(idx, (wanted.repo == idx.repo) & (wanted.imp == idx.key))
          .select(wanted.repo, "imp", "pkg_rule", F.lit(1).alias("rule"), "target"))
    dotted = wanted.where(F.col("imp").contains(".")).withColumn(
        "last", F.element_at(F.split("imp", r"\."), -1))
    r2 = (dotted.join(idx, (dotted.repo == idx.repo) & (dotted["last"] == idx.key))
          .select(dotted.repo, "imp", "pkg_rule", F.lit(2).alias("rule"), "target"))
    pkgs = packages.select("repo", "package").distinct()
    pk = wanted.where("pkg_rule")
    r3 = (pk.join(pkgs, (pk.repo == pkgs.repo) & (pk.imp == pkgs.package))
          .select(pk.repo, "imp", "pkg_rule", F.lit(3).alias("rule"),
                  F.lit(None).cast("string").alias("target")))
    best = (r1.unionByName(r2).unionByName(r3)
            .groupBy("repo", "imp", "pkg_rule")
            .agg(F.min(F.struct("rule", "target")).alias("b"))
            .select("repo", "imp", "pkg_rule", "b.rule", "b.target"))
    best = reuse(best)
    left = reuse(wanted.join(best.select("repo", "imp", "pkg_rule").hint("merge"), ["repo", "imp", "pkg_rule"], "left_anti"))
    return best.unionByName(gram_match(left, index))


GRAM = 4
_SALT = 50_000  # keys of one gram that a task gets


def _grams(c, n):
    """Distinct substrings of length ``n``; none where ``c`` is shorter."""
    at = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(c, i, n)))).otherwise(F.array().cast("array<string>"))


def gram_match(left: DataFrame, index: DataFrame) -> DataFrame:
    """Rule 4 by an inverted index of grams: an import is looked up by the gram of it that the fewest index keys hold, the keys of that gram
    are verified by ``contains``, and the earliest (insertion order) is kept. Grams have ``GRAM`` characters; an import shorter than that is its own gram. A
    key is sent once for each of its grams that some import asks for, so the shuffle is linear in the keys' length; a gram that many keys hold is
    dealt over salts, and the minimum is combined before the shuffle."""
    want = left.select("repo", "imp").where(F.length("imp") > 0).distinct()
    asked = want.select("repo", "imp", F.explode(_grams(F.col("imp"), F.least(F.length("imp"), F.lit(GRAM)))).alias("gram"))
    # at most GRAM lengths; no import left, nothing to look up
    lengths = [r["n"] for r in asked.select(F.length("gram").alias("n")).distinct().collect()]
    cuts = F.concat(F.array().cast("array<string>"), *[_grams(F.col("key"), F.lit(n)) for n in sorted(lengths)])
    posted = (index.select("repo", "key", F.struct("first_pos", "file").alias("cand"), F.explode(cuts).alias("gram"))
              .join(asked.select("repo", "gram").distinct(), ["repo", "gram"], "left_semi"))
    held = posted.groupBy("repo", "gram").agg(F.count("*").alias("held"))
    # a gram that no key holds rules its import out
    probe = (asked.join(held, ["repo", "gram"], "left").groupBy("repo", "imp")
             .agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("g")).where("g.held > 0")
             .select("repo", "imp", "g.gram", F.ceil(F.col("g.held") / _SALT).cast("int").alias("salts")))
    salted = (posted.join(probe.select("repo", "gram", "salts").distinct(), ["repo", "gram"])
              .withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")).drop("salts"))
    best = (probe.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(salted, ["repo", "gram", "salt"])
            .where(F.contains("key", "imp")).groupBy("repo", "imp").agg(F.min("cand").alias("cand")))
    return (left.select("repo", "imp", "pkg_rule").join(best, ["repo", "imp"])
            .select("repo", "imp", "pkg_rule", F.lit(4).alias("rule"), F.col("cand.file").alias("target")))


def wanted_imports(imports: DataFrame) -> DataFrame:
    """(repo, file, ord, import, imp, pkg_rule) of the imports that may resolve (JS/TS imports never do)."""
    return (imports.where(F.col("language").isin(*RESOLVING))
            .select("repo", "file", "ord", "import",
                    _clean_import(F.col("import")).alias("imp"),
                    F.col("language").isin(*PACKAGE_RULE).alias("pkg_rule")))


_FAN = 2_000  # files of a package that a task pairs with those that import it


def resolved_by(imports: DataFrame, rules: DataFrame, packages: DataFrame) -> DataFrame:
    """resolved(repo, file, ord, import, rule, target) of every import that the ``rules`` (``import_rules``) resolve. Packages
    fan out here, straight into the result: their files are dealt over salts, so that no task holds all pairs of a package."""
    imps, key = wanted_imports(imports), ["repo", "imp", "pkg_rule"]
    columns = ["repo", "file", "ord", "import", "rule", "target"]
    single = imps.join(rules.where("rule <> 3").hint("merge"), key).select(*columns)
    files = packages.select("repo", F.col("package").alias("imp"), F.col("file").alias("target"))
    whole = (rules.where("rule = 3").select(*key, "rule")
             .join(files.groupBy("repo", "imp").agg(F.ceil(F.count("*") / _FAN).cast("int").alias("salts")), ["repo", "imp"]))
    asked = imps.join(whole, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = (files.join(whole.select("repo", "imp", "salts").distinct(), ["repo", "imp"])
             .withColumn("salt", F.pmod(F.xxhash64("target"), F.col("salts")).cast("int")).drop("salts"))
    return single.unionByName(asked.join(dealt, ["repo", "imp", "salt"]).select(*columns))


def resolve_imports(imports: DataFrame, index: DataFrame, packages: DataFrame) -> DataFrame:
    """resolved(repo, file, ord, import, rule, target) for every import
    that resolves (JS/TS imports never do)."""
    wanted = wanted_imports(imports).select("repo", "imp", "pkg_rule").distinct()
    return resolved_by(imports, import_rules(wanted, index, packages), packages)


# ------------------------------------------------------------------ D4/D5
def dependency_edges(resolved: DataFrame) -> DataFrame:
    """edges(repo, source, target, type): distinct file -> file; self-edges kept."""
    return (resolved.select("repo", F.col("file").alias("source"), "target").distinct()
            .withColumn("type", F.lit("internal")))


def external_dependencies(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """(repo, file, import): imports of resolving languages that hit no file."""
    imps = imports.where(F.col("language").isin(*RESOLVING)).select("repo", "file", "ord", "import")
    return (imps.join(resolved.select("repo", "file", "ord"), ["repo", "file", "ord"], "left_anti")
            .select("repo", "file", "import").distinct())


def unresolved(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``external_dependencies`` from the rules of the distinct imports: no resolved import is needed for them."""
    return (wanted_imports(imports).join(rules.select("repo", "imp", "pkg_rule").hint("merge"), ["repo", "imp", "pkg_rule"], "left_anti")
            .select("repo", "file", "import").distinct())


# ------------------------------------------------------------------ D6
def graph_nodes(units: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """nodes(repo, file, language, package, class_names, dependency_count,
    dependent_count); ``units`` has one row per analysed file."""
    classes = (entries.where(F.col("pos.short") == 0).groupBy("repo", "file")
               .agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("c"))
               .select("repo", "file", F.array_join(F.col("c.name"), ",").alias("class_names")))
    out_deg = edges.groupBy("repo", F.col("source").alias("file")).agg(F.count("*").alias("dependency_count"))
    in_deg = edges.groupBy("repo", F.col("target").alias("file")).agg(F.count("*").alias("dependent_count"))
    return (units.select("repo", "file", "language", F.col("namespace").alias("package"))
            .join(classes.hint("merge"), ["repo", "file"], "left")
            .join(out_deg.hint("merge"), ["repo", "file"], "left").join(in_deg.hint("merge"), ["repo", "file"], "left")
            .select("repo", "file", "language", "package",
                    F.coalesce("class_names", F.lit("")).alias("class_names"),
                    F.coalesce("dependency_count", F.lit(0)).cast("long").alias("dependency_count"),
                    F.coalesce("dependent_count", F.lit(0)).cast("long").alias("dependent_count")))


# ------------------------------------------------------------------ D9/D10
def orphaned_files(nodes: DataFrame) -> DataFrame:
    return (nodes.where((F.col("dependency_count") == 0) & (F.col("dependent_count") == 0))
            .select("repo", "file"))


def highly_coupled_files(nodes: DataFrame, threshold: int = 5, k: int | None = None) -> DataFrame:
    """Files with out + in >= threshold, most coupled first (ties by file).
    ``k`` cuts the report to its top k per repo (window group limit)."""
    out = nodes.select("repo", "file", "dependency_count", "dependent_count",
                       (F.col("dependency_count") + F.col("dependent_count")).alias("total_coupling")
                       ).where(F.col("total_coupling") >= threshold)
    if k is not None:
        w = Window.partitionBy("repo").orderBy(F.desc("total_coupling"), "file")
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    return out


# ------------------------------------------------------------------ D7
def graph_metrics(nodes: DataFrame, edges: DataFrame, index: DataFrame, entries: DataFrame,
                  external: DataFrame, threshold: int = 5) -> DataFrame:
    """One row per repo with the summary counts. ``class_count`` counts
    index keys (full + short names), ``distinct_type_count`` the types."""
    n = nodes.groupBy("repo").agg(
        F.count("*").alias("file_count"),
        F.count_if((F.col("dependency_count") == 0) & (F.col("dependent_count") == 0)).alias("orphan_count"),
        F.count_if(F.col("dependency_count") + F.col("dependent_count") >= threshold).alias("coupled_count"))
    idx = index.groupBy("repo").agg(F.count("*").alias("class_count"))
    types = (entries.where(F.col("pos.short") == 0)
             .groupBy("repo").agg(F.count("*").alias("distinct_type_count")))
    e = edges.groupBy("repo").agg(F.count("*").alias("dependency_count"))
    x = external.groupBy("repo").agg(F.count("*").alias("external_dependency_count"))
    out = n.join(idx, "repo", "left").join(types, "repo", "left").join(e, "repo", "left").join(x, "repo", "left")
    cols = ["file_count", "class_count", "distinct_type_count", "dependency_count",
            "external_dependency_count", "orphan_count", "coupled_count"]
    return out.select("repo", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in cols])


# ------------------------------------------------------------------ D11
def sample_graph(edges: DataFrame, max_sources: int = 20, max_targets: int = 5, max_edges: int | None = None) -> DataFrame:
    """First ``max_sources`` sources (by file) x first ``max_targets``
    targets each, per repo, and of these the first ``max_edges`` (by source,
    target) if given. The cuts are rank filters, which Spark turns into
    window group limits applied before the shuffle."""
    srcs = edges.select("repo", "source").distinct()
    top = (srcs.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy("source")))
           .where(F.col("r") <= max_sources).drop("r"))
    w = Window.partitionBy("repo", "source").orderBy("target")
    out = (edges.join(top, ["repo", "source"], "left_semi")
           .withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_targets).drop("r")
           .select("repo", "source", "target"))
    if max_edges is not None:
        w = Window.partitionBy("repo").orderBy("source", "target")
        out = out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_edges).drop("r")
    return out


# ------------------------------------------------------------------ D12
def display_id(path) -> "F.Column":
    """Diagram node id: non-word runs -> ``_``, trimmed, ``_`` prefix when it
    does not start with a letter, ``node`` if empty. Beyond 50 characters the
    end gives way to a hash of the path, so that long paths stay distinct."""
    s = F.regexp_replace(F.regexp_replace(path, r"(?U)[^\w]", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    s = F.when(s.rlike(r"^[^\p{L}_]"), F.concat(F.lit("_"), s)).otherwise(s)
    short = F.concat(F.substring(s, 1, 41), F.lit("_"), F.substring(F.md5(path), 1, 8))
    return F.when(s == "", F.lit("node")).when(F.length(s) > 50, short).otherwise(s)


def display_label(path) -> "F.Column":
    name = F.element_at(F.split(path, "/"), -1)
    s = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    s = F.regexp_replace(s, "[\r\n]", " ")
    return F.when(s == "", F.lit("file")).otherwise(s)


def display_edges(edges: DataFrame) -> DataFrame:
    """(repo, src_id, src_label, dst_id, dst_label): one row per edge between
    files; edges are told apart by their paths, never by their display ids."""
    e = edges.select("repo", "source", "target").distinct()
    return e.select("repo", display_id(F.col("source")).alias("src_id"), display_label(F.col("source")).alias("src_label"),
                    display_id(F.col("target")).alias("dst_id"), display_label(F.col("target")).alias("dst_label"))


# ------------------------------------------------------------------ D13
def export_lines(nodes: DataFrame, edges: DataFrame, fmt: str = "mermaid") -> DataFrame:
    """(repo, format, section, sort_key, line): one text line per row;
    writing them ordered by (section, sort_key) gives the file. Header and
    footer rows are one per repo."""
    repos = nodes.select("repo").distinct()

    def fixed(section, lines):
        rows = [F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(lines)]
        return repos.select("repo", F.lit(section).alias("section"),
                            F.explode(F.array(*rows)).alias("x")).select(
            "repo", "section", F.lpad(F.col("x.i").cast("string"), 6, "0").alias("sort_key"),
            F.col("x.t").alias("line"))

    if fmt == "mermaid":
        m = display_edges(edges)
        body = m.select("repo", F.lit(1).alias("section"),
                        F.concat_ws("\u0001", "src_id", "dst_id").alias("sort_key"),
                        F.format_string('  %s["%s"] --> %s["%s"]', "src_id", "src_label",
                                        "dst_id", "dst_label").alias("line"))
        out = fixed(0, ["graph LR"]).unionByName(body)
    elif fmt == "dot":
        def dot_id(c):
            return F.translate(c, "/\\.", "___")
        name = F.element_at(F.split("file", "/"), -1)
        label = F.when(F.coalesce(F.col("package"), F.lit("")) != "",
                       F.concat(name, F.lit("\\n("), F.col("package"), F.lit(")"))).otherwise(name)
        node_rows = nodes.select("repo", F.lit(1).alias("section"), F.col("file").alias("sort_key"),
                                 F.format_string('  "%s" [label="%s"];', dot_id(F.col("file")), label)
                                 .alias("line"))
        edge_rows = edges.select("repo", F.lit(3).alias("section"),
                                 F.concat_ws("\u0001", "source", "target").alias("sort_key"),
                                 F.format_string('  "%s" -> "%s";', dot_id(F.col("source")),
                                                 dot_id(F.col("target"))).alias("line"))
        out = (fixed(0, ["digraph Dependencies {", "  rankdir=LR;", "  node [shape=box, style=rounded];", ""])
               .unionByName(node_rows).unionByName(fixed(2, [""])).unionByName(edge_rows)
               .unionByName(fixed(4, ["}"])))
    else:
        raise ValueError(f"unknown graph format {fmt!r}")
    return out.select("repo", F.lit(fmt).alias("format"), "section", "sort_key", "line")


def write_graph(lines: DataFrame, path: str) -> None:
    """Write export lines as text, one folder per repo, in file order."""
    # a global range-partitioned sort keeps a huge repo spread over many
    # tasks; part files of one repo folder are in order
    (lines.orderBy("repo", "section", "sort_key")
     .select("repo", "line").write.mode("overwrite").partitionBy("repo").text(path))


def write_graph_json(nodes: DataFrame, edges: DataFrame, external: DataFrame, metrics: DataFrame,
                     path: str) -> None:
    """D13 JSON form: one JSON-lines folder per table, partitioned by repo
    (nodes, edges, unresolved imports, summary counts)."""
    for name, df in (("nodes", nodes), ("edges", edges), ("external", external), ("analysis", metrics)):
        df.write.mode("overwrite").partitionBy("repo").json(f"{path.rstrip('/')}/{name}")
