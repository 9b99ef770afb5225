"""Text preparation (T1-T10): chunks, chunk merging, prompt text, context,
generation attachment, documents, summaries and metrics.

Everything is row-local string / array work or a grouped aggregation; no
text is collected to the driver, and per-document folds use ``aggregate``
over the document's own line array.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# FIXED VALUES
SUMMARY_TAIL = "The documentation includes detailed explanations of classes, methods, and code structure."
SUMMARY_LANGS = ["java", "csharp", "vbnet", "fsharp", "php"]
SIZE_UNITS = ["B", "KB", "MB", "GB"]


# ------------------------------------------------------------------ T1
def chunk_text(df: DataFrame, text_col: str, size: int, overlap: int = 0) -> DataFrame:
    """Adds (chunk_index 1..n, chunk_total n, start, chunk): windows of
    ``size`` code points, each next one starting ``overlap`` before the
    previous end. size 0 or a text of at most ``size`` -> one chunk."""
    if size and overlap >= size:
        raise ValueError("chunk overlap must be smaller than the chunk size")
    overlap = max(overlap, 0)
    n_len = F.length(text_col)
    if not size:
        total = F.lit(1)
    else:
        step = size - overlap
        total = F.when(n_len <= size, F.lit(1)).otherwise(
            1 + F.ceil((n_len - size) / F.lit(step)).cast("int"))
    out = (df.withColumn("chunk_total", total.cast("long"))
           .withColumn("chunk_index", F.explode(F.sequence(F.lit(1), F.col("chunk_total").cast("int"))))
           .withColumn("chunk_index", F.col("chunk_index").cast("long")))
    if not size:
        start = F.lit(0)
        chunk = F.col(text_col)
    else:
        start = (F.col("chunk_index") - 1) * (size - overlap)
        chunk = F.when(F.col("chunk_total") == 1, F.col(text_col)).otherwise(
            F.expr(f"substring({text_col}, cast((chunk_index - 1) * {size - overlap} + 1 as int), {size})"))
    return out.withColumn("start", start.cast("long")).withColumn("chunk", chunk)


# ------------------------------------------------------------------ T2
def merge_chunk_symbols(named: DataFrame, plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge per-chunk symbols of a file.

    ``named``: (repo, file, chunk_index, kind, ord, name) records -- a record
    is kept unless its name occurred in an earlier chunk (repeats inside
    one chunk stay). ``plain``: (repo, file, chunk_index, kind, ord, value)
    -- ordered distinct values over all chunks."""
    first_chunk = Window.partitionBy("repo", "file", "kind", "name")
    keep = (named.withColumn("first", F.min("chunk_index").over(first_chunk))
            .where(F.col("chunk_index") == F.col("first")).drop("first"))
    w = Window.partitionBy("repo", "file", "kind", "value").orderBy("chunk_index", "ord")
    dedup = plain.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1).drop("r")
    return keep, dedup


# ------------------------------------------------------------------ T5
def project_of(relative_path: Column) -> Column:
    """First path segment when the path has more than one, else ``root``."""
    parts = F.split(relative_path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("root"))


def group_by_project(files: DataFrame) -> DataFrame:
    return (files.withColumn("project", project_of(F.col("relative_path")))
            .groupBy("repo", "project").agg(F.count("*").alias("files"),
                                            F.sum("size_bytes").alias("bytes")))


# ------------------------------------------------------------------ T9
def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def summary_of(text: Column) -> Column:
    """First paragraph after title / metadata lines: stops at a blank line
    after content, at a ``##`` heading, or once at least four lines are
    collected and one of the last three ends with a period. Shorter than
    50 characters -> a counted sentence about file sections."""
    init = F.struct(F.lit(False).alias("found"), F.lit(False).alias("done"),
                    F.array().cast("array<string>").alias("acc"))

    def step(st, line):
        s = _strip(line)
        skip = ((s.startswith("#") & line.contains("Technical Documentation"))
                | line.contains("Generated using") | (s == "---"))
        appended = F.concat(st["acc"], F.array(s))
        stop_after = (F.size(appended) >= 4) & F.exists(F.slice(appended, -3, 3), lambda x: x.endswith("."))
        return (F.when(st["done"] | skip, st)
                .when(s == "", F.when(st["found"], F.struct(st["found"].alias("found"), F.lit(True).alias("done"),
                                                            st["acc"].alias("acc")))
                      .otherwise(st))
                .when(s.startswith("##"), F.struct(F.lit(True).alias("found"), F.lit(True).alias("done"),
                                                   st["acc"].alias("acc")))
                .otherwise(F.struct(F.lit(True).alias("found"), stop_after.alias("done"),
                                    appended.alias("acc"))))

    folded = F.aggregate(F.split(text, "\n"), init, step)
    summary = F.trim(F.array_join(folded["acc"], " "))
    sections = (F.length(text) - F.length(F.replace(text, F.lit("### "), F.lit("")))) / 4
    langs = F.array_compact(F.array(*[F.when(text.contains(f"{x.upper()} Files"), F.lit(x))
                                      for x in SUMMARY_LANGS]))
    fallback = F.concat(F.lit("This documentation covers "), sections.cast("long").cast("string"),
                        F.lit(" source file(s) "),
                        F.when(F.size(langs) > 0, F.concat(F.lit("written in "), F.array_join(langs, ", "),
                                                           F.lit(". "))).otherwise(F.lit("")),
                        F.lit(SUMMARY_TAIL))
    return (F.when(F.coalesce(text, F.lit("")) == "", F.lit("No summary available."))
            .when(F.length(summary) < 50, fallback).otherwise(summary))


# ------------------------------------------------------------------ T10
def size_label(n: Column) -> Column:
    """``12.3 KB`` style label of a byte / character count."""
    expr = None
    for i, unit in enumerate(SIZE_UNITS):
        cond = n < F.lit(1024.0 ** (i + 1))
        val = F.concat(F.format_number(n / F.lit(1024.0 ** i), 1), F.lit(f" {unit}"))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.concat(F.format_number(n / F.lit(1024.0 ** 4), 1), F.lit(" TB")))


def doc_metrics(docs: DataFrame, group_cols: list[str], text_col: str = "text") -> DataFrame:
    """Characters and lines (newline count) per group, with a size label."""
    t = F.col(text_col)
    out = docs.groupBy(*group_cols).agg(
        F.count("*").alias("documents"),
        F.sum(F.length(t)).cast("long").alias("chars"),
        F.sum(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("lines"))
    return out.withColumn("size", F.regexp_replace(size_label(F.col("chars").cast("double")), ",", ""))


# ------------------------------------------------------------------ T3
# FIXED VALUES: prompt wording of the documentation request
PROMPT_HEAD = "Generate technical documentation for the following {language} code:\n\n"
PROMPT_TAIL = "\nPlease generate comprehensive technical documentation for this code."
SYSTEM_PROMPT = (
    "You are a technical documentation expert. Generate comprehensive, well-structured technical "
    "documentation for {language} source code.\n\nYour documentation should include:\n1. Overview and purpose\n"
    "2. Architecture and structure\n3. Key components (classes, functions, interfaces)\n4. Usage examples\n"
    "5. API documentation\n6. Dependencies and imports\n\nFormat the output in clear, professional markdown "
    "with proper headings, code blocks, and explanations.")
NS_LABEL = {"java": "Package", "csharp": "Namespace", "vbnet": "Namespace", "fsharp": "Namespace",
            "php": "Namespace"}
IMPORT_LABEL = {"java": "Imports", "vbnet": "Imports", "javascript": "Imports", "typescript": "Imports",
                "csharp": "Using statements", "php": "Use statements"}
# member counts listed under each class, per language
CLASS_COUNTS = {"java": [("method", "Methods"), ("field", "Fields")],
                "csharp": [("method", "Methods"), ("property", "Properties"), ("field", "Fields")],
                "php": [("method", "Methods"), ("property", "Properties")],
                "javascript": [("method", "Methods")],
                "typescript": [("method", "Methods"), ("property", "Properties")]}


def _lang_map(d: dict, default=None) -> Column:
    m = F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.col("language")), F.lit(default)) if default is not None \
        else F.element_at(m, F.col("language"))


def doc_prompts(files: DataFrame, units: DataFrame, imports: DataFrame, types: DataFrame,
                heritage: DataFrame, members: DataFrame, comments: DataFrame) -> DataFrame:
    """(repo, file, chunk, system_prompt, user_prompt): the documentation
    request of each (single-chunk) file, assembled from its symbol tables
    with grouped ordered lists and left joins. ``imports`` has a list of (ord, import) per file (``extract.import_lists``)."""
    key = ["repo", "file"]
    base = files.select("repo", F.col("relative_path").alias("file"), "language")
    imp = imports.select(*key, F.array_join(F.transform("i", lambda x: F.concat(F.lit("- "), x["import"])), "\n").alias("imports_txt"))
    cls = types.where(F.col("kind") == "class")
    ext = heritage.where(F.col("kind") == "class").groupBy("repo", "file", "type").agg(
        F.array_sort(F.collect_list(F.struct("ord", "relation", "parent"))).alias("h"))
    cnt = (members.where(F.col("type_kind") == "class").groupBy("repo", "file", F.col("type"))
           .pivot("member_kind", ["method", "field", "property"]).count())
    counts = {k: F.coalesce(F.col(k), F.lit(0)).cast("string") for k in ["method", "field", "property"]}
    count_lines = None
    for lang, items in CLASS_COUNTS.items():
        txt = F.concat(*[F.concat(F.lit(f"  {label}: "), counts[k], F.lit("\n")) for k, label in items])
        count_lines = F.when(F.col("language") == lang, txt) if count_lines is None \
            else count_lines.when(F.col("language") == lang, txt)
    rel = lambda r: F.filter("h", lambda x: x["relation"] == r)
    parents = lambda r: F.array_join(F.transform(rel(r), lambda x: x["parent"]), ", ")
    line = F.concat(
        F.lit("\n- "), F.col("name"),
        F.when(F.size(rel("extends")) > 0, F.concat(F.lit(" extends "), parents("extends"))).otherwise(F.lit("")),
        F.when(F.size(rel("implements")) > 0, F.concat(F.lit(" implements "), parents("implements")))
        .otherwise(F.lit("")),
        F.when(F.size(rel("inherits")) > 0, F.concat(F.lit(" : "), parents("inherits"))).otherwise(F.lit("")),
        F.lit("\n"), F.coalesce(count_lines.otherwise(F.lit("")), F.lit("")))
    cls_txt = (cls.join(ext.withColumnRenamed("type", "name"), ["repo", "file", "name"], "left")
               .withColumn("h", F.coalesce("h", F.array().cast("array<struct<ord:long,relation:string,parent:string>>")))
               .join(cnt.withColumnRenamed("type", "name"), ["repo", "file", "name"], "left")
               .select(*key, "ord", line.alias("line"))
               .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("c"))
               .select(*key, F.array_join("c.line", "").alias("classes_txt")))

    # all other kinds in one grouping; a kind that a file has not stays null
    kinds = ["interface", "enum", "type"]
    listed = types.where(F.col("kind").isin(*kinds)).groupBy(*key).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", "name")))).alias(k) for k in kinds])
    names = listed.select(*key, *[F.when(F.size(k) > 0, F.array_join(F.transform(k, lambda x: F.concat(F.lit("- "), x["name"], F.lit("\n"))), ""))
                                  .alias(f"{k}_txt") for k in kinds])
    ncom = comments.groupBy(*key).agg(F.count("*").alias("n_comments"))
    out = (base.join(units.select(*key, "namespace"), key, "left").join(imp, key, "left")
           .join(cls_txt, key, "left").join(names, key, "left").join(ncom, key, "left"))
    ns_label = _lang_map(NS_LABEL)
    imp_label = _lang_map(IMPORT_LABEL)
    user = F.concat(
        F.concat(F.lit("Generate technical documentation for the following "), F.col("language"),
                 F.lit(" code:\n\n")),
        F.when(ns_label.isNotNull(), F.concat(ns_label, F.lit(": "), F.coalesce("namespace", F.lit("")), F.lit("\n\n")))
        .otherwise(F.lit("")),
        F.when(imp_label.isNotNull() & F.col("imports_txt").isNotNull(),
               F.concat(imp_label, F.lit(":\n"), F.col("imports_txt"), F.lit("\n\n"))).otherwise(F.lit("")),
        F.when(F.col("classes_txt").isNotNull(), F.concat(F.lit("Classes:\n"), F.col("classes_txt"), F.lit("\n")))
        .otherwise(F.lit("")),
        F.when(F.col("interface_txt").isNotNull(), F.concat(F.lit("Interfaces:\n"), F.col("interface_txt"), F.lit("\n")))
        .otherwise(F.lit("")),
        F.when(F.col("enum_txt").isNotNull(), F.concat(F.lit("Enums:\n"), F.col("enum_txt"), F.lit("\n")))
        .otherwise(F.lit("")),
        F.when(F.col("type_txt").isNotNull(), F.concat(F.lit("Type Aliases:\n"), F.col("type_txt"), F.lit("\n")))
        .otherwise(F.lit("")),
        F.when(F.coalesce("n_comments", F.lit(0)) > 0,
               F.concat(F.lit("Comments found: "), F.col("n_comments").cast("string"), F.lit("\n\n")))
        .otherwise(F.lit("")),
        F.lit(PROMPT_TAIL))
    system = F.replace(F.lit(SYSTEM_PROMPT), F.lit("{language}"), F.col("language"))
    return out.select("repo", "file", F.lit(1).cast("long").alias("chunk"), system.alias("system_prompt"),
                      user.alias("user_prompt"))


# ------------------------------------------------------------------ T4
def corpus_context(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(repo, section, sort_key, line): the context text of each repo as
    ordered lines (project tree, then whole file bodies; only with
    ``max_chars`` are they cut at so many characters), never as one string: a repo of any size stays spread over tasks, and a
    writer emits the lines in (section, sort_key) order."""
    f = files.select("repo", "relative_path", "content", project_of(F.col("relative_path")).alias("project"))
    repos = f.select("repo").distinct()
    head = repos.select("repo", F.lit(0).alias("section"), F.lit("").alias("sort_key"),
                        F.lit("## Project Structure\n").alias("line"))
    proj = f.select("repo", "project").distinct().select(
        "repo", F.lit(1).alias("section"), F.concat(F.col("project"), F.lit("\u0000")).alias("sort_key"),
        F.concat(F.lit("\n### "), F.col("project"), F.lit("\n")).alias("line"))
    listing = f.select("repo", F.lit(1).alias("section"),
                       F.concat(F.col("project"), F.lit("\u0000"), F.col("relative_path")).alias("sort_key"),
                       F.concat(F.lit("- "), F.col("relative_path")).alias("line"))
    mid = repos.select("repo", F.lit(2).alias("section"), F.lit("").alias("sort_key"),
                       F.lit("\n\n## File Contents\n").alias("line"))
    body = F.col("content")
    if max_chars is not None:
        body = F.when(F.length(body) > max_chars,
                      F.concat(F.substring(body, 1, max_chars), F.lit("\n... (truncated)"))).otherwise(body)
    bodies = f.select("repo", F.lit(3).alias("section"), F.col("relative_path").alias("sort_key"),
                      F.concat(F.lit("\n### "), F.col("relative_path"), F.lit("\n```\n"), body, F.lit("\n```\n"))
                      .alias("line"))
    return head.unionByName(proj).unionByName(listing).unionByName(mid).unionByName(bodies)


def context_budget(context: DataFrame) -> DataFrame:
    """(repo, lines, context_chars): size of each repo's context text
    (lines joined by newlines)."""
    return context.groupBy("repo").agg(F.count("*").alias("lines"),
                                       (F.sum(F.length("line")) + F.count("*") - 1).cast("long").alias("context_chars"))


# ------------------------------------------------------------------ T6
# FIXED VALUES: wording of the section request
SECTION_SYSTEM = ("You are a technical documentation expert writing architecture documentation.")


def sections_rows(structure: dict) -> list[tuple]:
    """Flatten a document structure (sections with optional subsections)
    to (structure, section_id, parent_id, ord, title, prompt) rows."""
    rows = []
    k = 0
    for s in structure.get("sections", []):
        rows.append((structure.get("name", ""), s.get("id", ""), None, k, s.get("title", ""), s.get("prompt")))
        k += 1
        for sub in s.get("subsections", []) or []:
            rows.append((structure.get("name", ""), sub.get("id", ""), s.get("id", ""), k, sub.get("title", ""),
                         sub.get("prompt")))
            k += 1
    return rows


def section_array(structure: dict) -> Column:
    """The sections that have a prompt as one constant array, of any length: a JSON literal that is parsed once."""
    names = ["structure", "section_id", "parent_id", "ord", "title", "prompt"]
    rows = [dict(zip(names, r)) for r in sections_rows(structure) if r[5]]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<structure string, section_id string, parent_id string, ord long, title string, prompt string>>")


def section_prompts(repos: DataFrame, structure: dict) -> DataFrame:
    """(repo, structure, section_id, parent_id, ord, title, user_prompt_head):
    every section or subsection with a prompt, for every repo. The
    structure is configuration of bounded size, expanded per repo row by a
    generator (no join); the context is referenced by repo, not copied
    (``packing.section_requests`` gives the prompts that hold it)."""
    out = repos.select("repo", F.explode(section_array(structure)).alias("s")).select("repo", "s.*")
    head = F.concat(F.lit("# Section: "), F.col("title"), F.lit("\n\n## Instructions\n"), F.col("prompt"),
                    F.lit("\n\n## Codebase Context\n"))
    return out.select("repo", "structure", "section_id", "parent_id", "ord", "title", head.alias("user_prompt_head"))


# ------------------------------------------------------------------ T7
GENERATION_ERROR = "*Error generating content: no response*"


def attach_generations(prompts: DataFrame, responses: DataFrame, key: list[str], order_col: str) -> DataFrame:
    """(key..., chunk_total, documentation): responses joined back to their
    prompts; several chunks become '#### Chunk i/n' parts; a missing
    response becomes an error text instead of failing the run."""
    j = prompts.join(responses, key + [order_col], "left")
    w = Window.partitionBy(*key).orderBy(order_col)
    j = (j.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
         .withColumn("doc", F.coalesce("response", F.lit(GENERATION_ERROR))))
    part = F.when(F.col("n") == 1, F.col("doc")).otherwise(
        F.concat(F.lit("#### Chunk "), F.col("i").cast("string"), F.lit("/"), F.col("n").cast("string"),
                 F.lit("\n\n"), F.col("doc")))
    return (j.groupBy(*key).agg(F.max("n").cast("long").alias("chunk_total"),
                                F.array_sort(F.collect_list(F.struct("i", part.alias("p")))).alias("parts"))
            .select(*key, "chunk_total", F.array_join("parts.p", "\n\n").alias("documentation")))


# ------------------------------------------------------------------ T8
def assemble_documents(files: DataFrame) -> DataFrame:
    """(repo, section, sort_key, line): Markdown lines of each repo's
    document -- title, files per language, a section per language with
    one entry per file. Written in (section, sort_key) order."""
    f = files.select("repo", "language", "relative_path")
    repos = f.select("repo").distinct()
    title = repos.select("repo", F.lit(0).alias("section"), F.lit("").alias("sort_key"),
                         F.concat(F.lit("# "), F.col("repo"), F.lit(" Technical Documentation\n")).alias("line"))
    per_lang = f.groupBy("repo", "language").agg(F.count("*").alias("n"))
    counts = per_lang.select("repo", F.lit(1).alias("section"), F.col("language").alias("sort_key"),
                             F.concat(F.lit("- "), F.col("language"), F.lit(": "), F.col("n").cast("string"),
                                      F.lit(" file(s)")).alias("line"))
    heads = per_lang.select("repo", F.lit(2).alias("section"), F.concat(F.col("language"), F.lit("\u0000")).alias("sort_key"),
                            F.concat(F.lit("\n## "), F.upper("language"), F.lit(" Files\n")).alias("line"))
    entries = f.select("repo", F.lit(2).alias("section"),
                       F.concat(F.col("language"), F.lit("\u0000"), F.col("relative_path")).alias("sort_key"),
                       F.concat(F.lit("### "), F.col("relative_path")).alias("line"))
    return title.unionByName(counts).unionByName(heads).unionByName(entries)
