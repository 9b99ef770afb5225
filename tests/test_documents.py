"""Documents as ordered lines, rejected files, profiles in one scan."""

import os

from pyspark.sql import functions as F

from codegrid.operators import documents
from codegrid.sources import filters, tree


def _text(df):
    rows = df.collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.repo, r.section, r.sort_key)):
        out.setdefault(r.repo, []).append(r.line)
    return out


def test_catalog_document(spark):
    ctl = spark.createDataFrame([("r", "A.cs", "A", "api/a"), ("r", "B.cs", "B", "")], "repo string, file string, controller string, route string")
    svc = spark.createDataFrame([("r", "service", "AService"), ("q", "interface", "IThing")], "repo string, kind string, name string")
    spec = spark.createDataFrame([("r", "A", "Get", "GET", "api/a", "A, AService", "x"), ("r", "A", "Put", "PUT", "api/a", None, "")],
                                 "repo string, controller string, method string, verbs string, route string, components string, steps string")
    flows = spark.createDataFrame([("r", "A", "Get", i, f"step {i}") for i in range(12)], "repo string, controller string, method string, step_ord long, step string")
    got = _text(documents.catalog_document(ctl, svc, spec, flows))
    assert got["q"] == ["### Interfaces", "", "- `IThing`", ""]
    text = got["r"]
    assert text[:6] == ["## Service Catalog", "", "### Controllers", "", "- `A` (Route: `api/a`)", "- `B`"]
    at = text.index("#### GET api/a (A.Get)")
    assert text[at + 1:at + 13] == [f"- step {i}" for i in range(12)]
    assert text[at + 13:at + 15] == ["#### PUT api/a (A.Put)", "- No flow steps detected."]
    assert text[-1] == "| PUT | `api/a` | `A.Put` | N/A |" and "### Interfaces" not in text


def test_catalog_document_of_empty_tables(spark):
    def none(schema):
        return spark.createDataFrame([], schema)
    got = documents.catalog_document(
        none("repo string, file string, controller string, route string"), none("repo string, kind string, name string"),
        none("repo string, controller string, method string, verbs string, route string, components string"),
        none("repo string, controller string, method string, step_ord long, step string"))
    assert got.collect() == []


def test_report_leaves_out_empty_sections(spark):
    metrics = spark.createDataFrame([("r", 2, 4, 1, 0)], "repo string, file_count long, class_count long, dependency_count long, external_dependency_count long")
    got = _text(documents.dependency_report(
        metrics, spark.createDataFrame([], "repo string, cycle_len long, cycle string, pos long, file string"),
        spark.createDataFrame([], "repo string, file string"),
        spark.createDataFrame([("r", f"{c}.java", n, 0, n) for c, n in (("a", 9), ("b", 10), ("c", 100))],
                              "repo string, file string, dependency_count long, dependent_count long, total_coupling long"),
        spark.createDataFrame([("r", "a.java", "b.java")], "repo string, source string, target string")))["r"]
    assert "## Circular Dependencies" not in got and "## Orphaned Files" not in got
    assert got[:4] == ["# Dependency Map Analysis", "", "**Total Files:** 2", "**Total Classes:** 4"]
    assert [x[2:10] for x in got if x.startswith("| `")] == ["`c.java`", "`b.java`", "`a.java`"]
    assert got[-4:] == ["```mermaid", "graph TD", '  a_java["a.java"] --> b_java["b.java"]', "```"]


def test_every_file_is_read_or_rejected(spark, tmp_path):
    names = {"a.java": 10, "b.JAVA": 10, "big.java": 3000, "notes.xyz": 5, "node_modules/x.js": 7, "sub/c.py": 5, "sub/d.cs": 0}
    for name, size in names.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    limit = 2000 / 1024 / 1024
    read = {r.relative_path for r in tree.read_source_tree(spark, str(tmp_path), max_mb=limit).collect()}
    for probe in (False, True):
        lost = {r.relative_path: (r.size_bytes, r.reason) for r in tree.rejected_files(spark, str(tmp_path), max_mb=limit, probe=probe).collect()}
        # Spark's file sources list no empty files
        assert read | set(lost) == {n for n, size in names.items() if size} and not read & set(lost)
        assert lost["big.java"] == (3000, "oversized") and lost["notes.xyz"] == (5, "extension") and lost["node_modules/x.js"] == (7, "excluded")
    plan = tree.rejected_files(spark, str(tmp_path), max_mb=limit)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    only = tree.rejected_files(spark, str(tmp_path), include=["**/a*"], exclude=[]).where("reason = 'not included'")
    assert {r.relative_path for r in only.collect()} >= {"big.java", "node_modules/x.js"}


def test_profiles_take_one_scan_and_overlay(spark, tmp_path):
    rows = [("r", f"/x/{n}", n, n, "java") for n in ("a.java", "b.js", "c.ts", "node_modules/d.js", "e.q")]
    spark.createDataFrame(rows, "repo string, path string, relative_path string, name string, language string").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    profiles = [{"name": "all", "exclude_patterns": []}, {"name": "web", "include_patterns": ["**/*.js", "**/*.ts"], "chunk_size_chars": 500},
                {"name": "q", "extensions": {"query": [".q"]}, "chunk_overlap_chars": 7}]
    plain = filters.apply_domain_profiles(files, profiles)
    assert plain.columns == ["domain", *files.columns]
    assert plain._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r.domain, r.name): r for r in filters.apply_domain_profiles(files, profiles, overlays=True).collect()}
    assert set(got) == {("all", r[3]) for r in rows} | {("web", "b.js"), ("web", "c.ts"), ("q", "e.q")}
    assert got["q", "e.q"].language == "query" and got["q", "e.q"].chunk_overlap_chars == 7
    assert got["web", "b.js"].language == "java" and got["web", "b.js"].chunk_size_chars == 500 and got["all", "a.java"].chunk_size_chars is None
    assert plain.groupBy("domain").agg(F.count("*")).count() == 3


def test_file_document(spark):
    counts = ["class_count", "interface_count", "function_count", "enum_count", "type_count", "import_count"]
    st = spark.createDataFrame([("r", "a/A.cs", "csharp", 2, 0, 0, 1, 0, 3), ("r", "b.js", "javascript", 0, 0, 0, 0, 0, 0)],
                               "repo string, file string, language string, " + ", ".join(f"{c} long" for c in counts))
    texts = spark.createDataFrame([("r", "a/A.cs", "  text\n")], "repo string, file string, response string")
    flows = spark.createDataFrame([("r", "q", "X", "", "a/A.cs"), ("r", "q", "", "S", "gone.cs")],
                                  "repo string, queue string, consumers string, sagas string, file string")
    ops = spark.createDataFrame([("r", "a/A.cs", "send", "M"), ("r", "a/A.cs", "publish", "P"), ("r", "a/A.cs", "publish", "O")],
                                "repo string, file string, op string, message string")
    sends = spark.createDataFrame([("r", "a/A.cs", "queue:z")], "repo string, file string, endpoint string")
    cons = spark.createDataFrame([("r", "a/A.cs", 0, "C", "M")], "repo string, file string, ord long, consumer string, message string")
    got = _text(documents.file_document(st, texts, flows, ops, sends, cons))
    assert got == {"r": [
        "# r Technical Documentation\n", "- csharp: 1 file(s)", "- javascript: 1 file(s)", "\n## CSHARP Files\n", "### A.cs (CSHARP)\n",
        "**Path:** `a/A.cs`\n", "text\n", "#### Code Structure\n", "- Classes: 2", "- Enums: 1", "- Imports: 3", "\n#### Messaging Flows\n",
        "- Queue `q` -> Consumers: X; Sagas: N/A", "- Publishes: O", "- Publishes: P", "- Sends: M", "- Send Endpoint: queue:z", "- Consumer: C(M)",
        "\n---\n", "\n## JAVASCRIPT Files\n", "### b.js (JAVASCRIPT)\n", "**Path:** `b.js`\n", "*Error generating content: no response*\n", "\n---\n",
        "## Summary\n", "- Total files processed: 2", "- Languages: csharp, javascript\n", "---\n", "*This documentation was automatically generated.*"]}
    empty = documents.file_document(*(t.limit(0) for t in (st, texts, flows, ops, sends, cons)))
    assert empty.count() == 0
