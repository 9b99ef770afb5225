"""Markdown and JSON documents as ordered lines.

A document is a table (repo, section, sort_key, line): sections are numbered in the order they stand in, lines inside a section are ordered by
``sort_key``. Headings appear only for sections that have lines. Nothing is gathered per repo: ``deps.write_graph`` range-sorts the rows and
writes them, so one repo of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deps import display_edges, sample_graph
from .extract import strip_space
from .textprep import GENERATION_ERROR

SEP = "\u0001"


def _lines(df: DataFrame, section: int, key: Column, line: Column) -> DataFrame:
    return df.select("repo", F.lit(section).alias("section"), key.alias("sort_key"), line.alias("line"))


def _under(heading: list[str], rows: DataFrame, section: int, end: list[str] | None = None) -> DataFrame:
    """``rows`` after the heading lines, which stand in every repo that has such rows; ``end`` follows in the section after."""
    repos = rows.select("repo").distinct()
    out = rows

    def fixed(at, lines):
        numbered = F.posexplode(F.array(*[F.lit(t) for t in lines])).alias("i", "t")
        return _lines(repos.select("repo", numbered), at, F.lpad(F.col("i").cast("string"), 6, "0"), F.col("t"))
    out = fixed(section - 1, heading).unionByName(out)
    return out.unionByName(fixed(section + 1, end)) if end else out


def _code(c: str) -> Column:
    return F.concat(F.lit("`"), F.col(c), F.lit("`"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# ------------------------------------------------------------------ D13
def dependency_report(metrics: DataFrame, cycles: DataFrame, orphans: DataFrame, coupled: DataFrame, edges: DataFrame,
                      max_sources: int = 20, max_targets: int = 5) -> DataFrame:
    """The Markdown report of a dependency graph: totals, cycles (closed by their first file), orphans, coupled files (as given, most
    coupled first) and a diagram of the first ``max_sources`` x ``max_targets`` edges, which is a sample by design."""
    totals = {"Total Files": "file_count", "Total Classes": "class_count", "Internal Dependencies": "dependency_count",
              "External Dependencies": "external_dependency_count"}
    items = F.posexplode(F.array(*[_text(f"**{label}:** ", F.col(c).cast("string")) for label, c in totals.items()])).alias("i", "t")
    head = _under(["# Dependency Map Analysis", ""], _lines(metrics.select("repo", items), 1, F.col("i").cast("string"), F.col("t")), 1, [""])
    ring = _text("- ", F.replace(F.col("cycle"), F.lit(" -> "), F.lit(" → ")), " → ", F.col("file"))
    loops = _lines(cycles.where("pos = 0"), 4, F.concat(F.lpad(F.col("cycle_len").cast("string"), 6, "0"), F.lit(SEP), F.col("cycle")), ring)
    alone = _lines(orphans, 7, F.col("file"), _text("- ", _code("file")))
    row = _text("| ", _code("file"), " | ", F.col("dependency_count").cast("string"), " | ", F.col("dependent_count").cast("string"), " | ",
                F.col("total_coupling").cast("string"), " |")
    # larger totals first: the key counts down
    high = _lines(coupled, 10, F.concat(F.lpad((F.lit(10 ** 15) - F.col("total_coupling")).cast("string"), 16, "0"), F.lit(SEP), F.col("file")), row)
    drawn = _lines(display_edges(sample_graph(edges, max_sources, max_targets)), 13, F.concat_ws("\u0001", "src_id", "dst_id"),
                   F.format_string('  %s["%s"] --> %s["%s"]', "src_id", "src_label", "dst_id", "dst_label"))
    return (head.unionByName(_under(["## Circular Dependencies", ""], loops, 4, [""]))
            .unionByName(_under(["## Orphaned Files", "", "Files with no dependencies:", ""], alone, 7, [""]))
            .unionByName(_under(["## Highly Coupled Files", "", "| File | Dependencies | Dependents | Total Coupling |", "|---|---|---|---|"],
                                high, 10, [""]))
            .unionByName(_under(["## Dependency Graph", "", "```mermaid", "graph TD"], drawn, 13, ["```"])))


def json_lines(**tables: DataFrame) -> DataFrame:
    """(repo, section, sort_key, line): the rows of the given tables as JSON objects, one a line, led by the name of their table. Sections
    follow the order of the arguments; rows are ordered by their text. Null fields are left out."""
    out = None
    for section, (name, df) in enumerate(tables.items()):
        fields = [F.lit(name).alias("table"), *[F.col(c) for c in df.columns if c != "repo"]]
        line = F.to_json(F.struct(*fields))
        part = _lines(df.select("repo", line.alias("j")), section, F.col("j"), F.col("j"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ T4
def context_sections(controllers: DataFrame, endpoints: DataFrame, services: DataFrame, flows: DataFrame) -> DataFrame:
    """What a context says after its files (``textprep.corpus_context`` ends at section 3): controllers, endpoints, services and interfaces
    of the catalog, then the queues with their consumers, as ordered lines to be united with it.

    controllers (repo, file, controller, route), endpoints (repo, file, controller, method, class_ord, method_ord, verbs[], route),
    services (repo, kind, name), flows (repo, queue, consumers, file). One line a name; equal lines of several files stay."""
    catalog = (controllers.select("repo").unionByName(endpoints.select("repo"))
               .unionByName(services.where(F.col("kind").isin("service", "interface")).select("repo")).distinct())
    route = F.coalesce("route", F.lit(""))
    ctl = _lines(controllers, 6, F.concat_ws(SEP, "file", "controller"),
                 _text("- ", F.col("controller"), F.when(route != "", _text(" (Route: ", route, ")")).otherwise("")))
    place = F.concat_ws(SEP, F.col("file"), *[F.lpad(F.col(c).cast("string"), 9, "0") for c in ("class_ord", "method_ord")])
    ends = _lines(endpoints, 8, place, _text("- ", F.array_join("verbs", ", "), " ", route, " -> ", F.col("controller"), ".", F.col("method")))
    kind = {k: _lines(services.where(F.col("kind") == k), at, F.col("name"), _text("- ", F.col("name"))) for k, at in (("service", 10), ("interface", 12))}
    queues = _lines(flows, 14, F.concat_ws(SEP, "queue", "file"), _text("- Queue: ", F.col("queue"), " -> Consumers: ", F.col("consumers")))
    return (_lines(catalog, 4, F.lit(""), F.lit("\n## Service Catalog\n"))
            .unionByName(_under(["### Controllers\n"], ctl, 6)).unionByName(_under(["\n### Endpoints\n"], ends, 8))
            .unionByName(_under(["\n### Services"], kind["service"], 10)).unionByName(_under(["\n### Interfaces"], kind["interface"], 12))
            .unionByName(_under(["\n## Messaging Flows\n"], queues, 14)))


# ------------------------------------------------------------------ T8
def catalog_document(controllers: DataFrame, services: DataFrame, spec: DataFrame, flows: DataFrame) -> DataFrame:
    """The service catalog of each repo: controllers, endpoints, the steps of every endpoint, services, interfaces and the API table.

    controllers (repo, controller, route), services (repo, kind, name), spec (repo, controller, method, verbs, route, components),
    flows (repo, controller, method, step_ord, step). Endpoints without steps say so; no list is joined into one value."""
    ep = ["repo", "controller", "method"]
    key = F.concat_ws("\u0001", "controller", "method")
    ctl = _lines(controllers, 1, F.concat_ws("\u0001", "controller", "file"),
                 _text("- ", _code("controller"), F.when(F.coalesce("route", F.lit("")) != "", _text(" (Route: ", _code("route"), ")")).otherwise("")))
    table = _lines(spec, 4, key, _text("| ", _code("controller"), " | ", _code("method"), " | ", F.col("verbs"), " | ", _code("route"), " |"))
    title = _lines(spec, 7, F.concat(key, F.lit(SEP)), _text("#### ", F.col("verbs"), " ", F.col("route"), " (", F.col("controller"), ".", F.col("method"), ")"))
    steps = _lines(flows, 7, F.concat(key, F.lit(SEP), F.lpad(F.col("step_ord").cast("string"), 9, "0")), _text("- ", F.col("step")))
    none = _lines(spec.join(flows.select(*ep).distinct(), ep, "left_anti"), 7, F.concat(key, F.lit(SEP), F.lit("0")),
                  F.lit("- No flow steps detected."))
    kinds = {k: _lines(services.where(F.col("kind") == k), at, F.col("name"), _text("- ", _code("name")))
             for k, at in (("service", 10), ("interface", 13))}
    api = _lines(spec, 16, key, _text("| ", F.col("verbs"), " | ", _code("route"), " | `", F.col("controller"), ".", F.col("method"), "` | ",
                                      F.when(F.coalesce("components", F.lit("")) != "", F.col("components")).otherwise("N/A"), " |"))
    return (_under(["## Service Catalog", "", "### Controllers", ""], ctl, 1, [""])
            .unionByName(_under(["### Endpoints", "", "| Controller | Method | HTTP | Route |", "|---|---|---|---|"], table, 4, [""]))
            .unionByName(_under(["### Endpoint Flow Details", ""], title.unionByName(steps).unionByName(none), 7, [""]))
            .unionByName(_under(["### Services / Repositories", ""], kinds["service"], 10, [""]))
            .unionByName(_under(["### Interfaces", ""], kinds["interface"], 13, [""]))
            .unionByName(_under(["## API Specifications", "", "| HTTP | Route | Controller.Method | Components/Services |", "|---|---|---|---|"],
                                api, 16)))


# FIXED VALUES: labels of a file's counts, in their order
COUNT_LABELS = {"Classes": "class_count", "Interfaces": "interface_count", "Functions": "function_count", "Enums": "enum_count",
                "Types": "type_count", "Imports": "import_count"}
CLOSING = "*This documentation was automatically generated.*"


def file_document(structure: DataFrame, texts: DataFrame, flows: DataFrame, ops: DataFrame, sends: DataFrame,
                  consumers: DataFrame) -> DataFrame:
    """The documentation of each repo, file by file: title, files per language, then under a heading for each language every file with its
    path, its text, its counts (those above 0) and its messaging, and a summary at the end.

    structure (repo, file, language, *_count; ``reports.structure_counts``), texts (repo, file, response), flows (repo, queue, consumers,
    sagas, file), ops (repo, file, op, message), sends (repo, file, endpoint), consumers (repo, file, ord, consumer, message). A file without
    a text says so; messaging of files that ``structure`` lacks is left out; every message, endpoint and consumer has a line of its own, so no
    value grows with a file. Lines of a file share the key (language, file): one range sort brings all tables together."""
    files = structure.select("repo", "file", "language")

    def at(part: int, *more: Column) -> Column:
        return F.concat_ws(SEP, F.col("language"), F.col("file"), F.lit(f"{part:02d}"), *more)
    per_lang = files.groupBy("repo", "language").agg(F.count("*").alias("n"))
    totals = per_lang.groupBy("repo").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("l"))
    out = [
        _lines(totals, 0, F.lit(""), _text("# ", F.col("repo"), " Technical Documentation\n")),
        _lines(per_lang, 1, F.col("language"), _text("- ", F.col("language"), ": ", F.col("n").cast("string"), " file(s)")),
        _lines(per_lang, 2, _text(F.col("language"), SEP), _text("\n## ", F.upper("language"), " Files\n")),
        _lines(totals, 3, F.lit("0"), F.lit("## Summary\n")),
        _lines(totals, 3, F.lit("1"), _text("- Total files processed: ", F.col("n").cast("string"))),
        _lines(totals, 3, F.lit("2"), _text("- Languages: ", F.col("l"), "\n")),
        _lines(totals, 3, F.lit("3"), F.lit("---\n")), _lines(totals, 3, F.lit("4"), F.lit(CLOSING))]
    # what a file says of itself: one row in, its lines out
    said = F.coalesce(strip_space(F.col("response")), F.lit(GENERATION_ERROR))
    name = F.element_at(F.split("file", "/"), -1)
    counted = [F.col(c) > 0 for c in COUNT_LABELS.values()]
    lines = [(0, F.lit(True), _text("### ", name, " (", F.upper("language"), ")\n")), (1, F.lit(True), _text("**Path:** ", _code("file"), "\n")),
             (2, F.lit(True), _text(said, "\n")), (3, F.greatest(*counted), F.lit("#### Code Structure\n"))]
    lines += [(4 + i, shown, _text(f"- {label}: ", F.col(c).cast("string"))) for i, ((label, c), shown) in enumerate(zip(COUNT_LABELS.items(), counted))]
    lines += [(20, F.lit(True), F.lit("\n---\n"))]
    own = F.filter(F.array(*[F.struct(at(part).alias("key"), shown.alias("shown"), line.alias("line")) for part, shown, line in lines]),
                   lambda x: x["shown"])
    whole = structure.join(texts.select("repo", "file", "response"), ["repo", "file"], "left")
    out.append(whole.select("repo", F.explode(own).alias("x")).select("repo", F.lit(2).alias("section"), F.col("x.key").alias("sort_key"), "x.line"))

    def or_none(c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("N/A")).otherwise(F.col(c))
    facts = [
        flows.select("repo", "file", F.lit(12).alias("part"), F.col("queue").alias("k"),
                     _text("- Queue ", _code("queue"), " -> Consumers: ", or_none("consumers"), "; Sagas: ", or_none("sagas")).alias("line")),
        ops.where("op = 'publish'").select("repo", "file", F.lit(13).alias("part"), F.col("message").alias("k"), _text("- Publishes: ", F.col("message")).alias("line")),
        ops.where("op = 'send'").select("repo", "file", F.lit(14).alias("part"), F.col("message").alias("k"), _text("- Sends: ", F.col("message")).alias("line")),
        sends.select("repo", "file", F.lit(15).alias("part"), F.col("endpoint").alias("k"), _text("- Send Endpoint: ", F.col("endpoint")).alias("line")),
        consumers.select("repo", "file", F.lit(16).alias("part"), F.lpad(F.col("ord").cast("string"), 9, "0").alias("k"),
                         _text("- Consumer: ", F.col("consumer"), "(", F.col("message"), ")").alias("line"))]
    told = facts[0]
    for f in facts[1:]:
        told = told.unionByName(f)
    heads = told.select("repo", "file").distinct().select("repo", "file", F.lit(11).alias("part"), F.lit("").alias("k"), F.lit("\n#### Messaging Flows\n").alias("line"))
    told = told.unionByName(heads).join(files, ["repo", "file"])
    key = F.concat_ws(SEP, "language", "file", F.col("part").cast("string"), "k")
    out.append(_lines(told, 2, key, F.col("line")))
    doc = out[0]
    for part in out[1:]:
        doc = doc.unionByName(part)
    return doc
