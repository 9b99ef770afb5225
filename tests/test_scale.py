"""Work that must not grow beyond its input: scans, plans and tasks of the findings of round 3."""
import os
import time

from pyspark.sql import functions as F

from codegrid.functions import body
from codegrid.functions.body import scan_cs_services
from codegrid.operators import catalog, deps, extract
from codegrid.plans.materialize import checkpoint
from codegrid.plans.registry import Catalog, Graph, REGISTRY
from codegrid.sources import tree
from codegrid.sources.tables import files_from
from codegrid.streaming import files as streaming


def make_files(spark, rows):
    df = spark.createDataFrame(rows, "rel string, content string")
    return files_from(df, F.lit("r"), F.col("rel"), F.col("content"))


SHOP = [("C.cs", '[ApiController]\n[Route("api/[controller]")]\npublic class AController\n{\n[HttpGet("x")]\npublic int Get()\n{\nPublish(new Placed(1));\n}\n}'),
        ("S.cs", "public class IOrderService\n{\n}"), ("W.cs", "public class W : IConsumer<Placed>\n{\n}")]


def test_long_attribute_is_searched_once():
    at = time.time()
    assert scan_cs_services("[" + "A" * 60 + "(\nclass X {\n}")[0][0] == "X"
    assert time.time() - at < 5


def test_scan_sends_rows_on_in_pieces():
    import pandas as pd
    code = "public class X { " + "public int M() { } " * 3000 + "}"
    batch = pd.DataFrame({"repo": ["r"] * 3, "file": ["a", "b", "c"], "content": [code] * 3})
    pieces = [len(p) for p in catalog._scan_batches([batch]) if len(p)]
    assert pieces == [3000, 3000, 3000]


def test_services_scan_files_once(spark):
    df = catalog.services_and_interfaces(catalog.parse_csharp_services(make_files(spark, SHOP)))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {(r.kind, r.name) for r in df.collect()} == {("service", "IOrderService"), ("interface", "IOrderService")}


def test_app_sequence_keeps_endpoints_apart(spark):
    c = Catalog(make_files(spark, SHOP))
    df = catalog.app_sequence(c.controllers, c.scan, c.endpoints, c.ctrl_deps, checkpoint(c.flows))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("strategy=broadcast") >= 2  # what is one row a repo
    assert [(r.src, r.dst, r.label) for r in df.orderBy("pos").collect()] == [
        ("Client", "AController", "GET api a x"), ("AController", "IOrderService", "Handle"), ("IOrderService", "AController", "Result"),
        ("AController", "RabbitMQ", "Publish Send Placed"), ("RabbitMQ", "W", "Consume Placed"), ("AController", "Client", "Response")]


def test_checkpoint_is_a_table_of_columns(spark):
    df = checkpoint(spark.range(10).withColumn("text", F.lit("x" * 50)))
    assert all(f.endswith(".parquet") for f in df.inputFiles()) and df.inputFiles()
    assert df.agg(F.sum("id")).first()[0] == 45


def test_package_imports_go_straight_into_the_result(spark, monkeypatch):
    monkeypatch.setattr(deps, "_FAN", 2)
    rows = [(f"p/{i}.java", f"package p;\npublic class P{i} {{\n}}\n") for i in range(7)]
    rows += [("q/A.java", "package q;\nimport p.*;\nimport p.P3;\nimport none.X;\nclass A {\n}\n"), ("q/B.java", "package q;\nimport p.*;\nclass B {\n}\n")]
    g = Graph(make_files(spark, rows))
    got = sorted((r.file, r["import"], r.rule, r.target) for r in g.resolved.collect())
    files = [f"p/{i}.java" for i in range(7)]
    assert got == sorted([("q/A.java", "p.*", 3, f) for f in files] + [("q/B.java", "p.*", 3, f) for f in files] + [("q/A.java", "p.P3", 1, "p/3.java")])
    assert [tuple(r) for r in g.external().collect()] == [("r", "q/A.java", "none.X")]
    assert {r.rule for r in g.rules.collect()} == {1, 3} and g.rules.count() == 2  # one row per distinct import, no pairs


def write(root, names):
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}"), exist_ok=True)
        with open(f"{root}/{n}", "w") as f:
            f.write("x")


def test_small_files_share_tasks(spark, tmp_path):
    root = str(tmp_path)
    write(root, [f"d{i % 3}/f{i}.java" for i in range(32 * 8 * tree.TASKS // 4)])
    most = tree.TASKS * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))  # a task a file
    try:
        assert tree.read_source_tree(spark, root).rdd.getNumPartitions() <= most
        assert tree.rejected_files(spark, root).rdd.getNumPartitions() <= most
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_glob_reads_what_its_expansion_reads(spark, tmp_path):
    root = str(tmp_path / "g")
    write(root, ["a/main/en/1.txt", "a/main/en/deep/2.txt", "a/main/en/_dir/3.txt", "a/main/en/_4.txt", "b/main/.git/5.txt", "b/main/top.txt", "b/main/fr/.6", "a/other/en/7.txt"])
    for glob in ("/*/main/*/*", "/*/main/*", "/a/main/e?/*"):
        want = tree._scan(spark, root + glob, 10)
        got = tree._scan_glob(spark, root + glob, 10)
        assert sorted(r.path for r in got.collect()) == sorted(r.path for r in want.collect()), glob


def test_stream_lists_files_in_few_tasks(spark, tmp_path):
    root = str(tmp_path / "in")
    write(root, [f"f{i}.java" for i in range(1200)])
    seen = []
    s = streaming.stream_files(spark, root)
    out = streaming.run_available_now(s.select("relative_path"), "few", foreach_batch=lambda b, e, p: (seen.append(b.rdd.getNumPartitions()), streaming.write_epoch(b, e, p)), settings=streaming.FILE_SETTINGS)
    assert spark.read.parquet(out).count() == 1200
    assert len(seen) == 1 and seen[0] <= 12  # one batch, some hundred files a task
    assert spark.conf.get("spark.sql.files.openCostInBytes") != "256k"


def test_distinct_imports_are_found_once(spark, monkeypatch):
    seen, rules = [], deps.import_rules
    monkeypatch.setattr(deps, "import_rules", lambda wanted, *rest: (seen.append(wanted), rules(wanted, *rest))[1])
    g = Graph(make_files(spark, [("p/A.java", "package p;\nimport p.B;\nclass A {\n}\n"), ("p/B.java", "package p;\nimport p.B;\nclass B {\n}\n")]))
    assert [(r.imp, r.rule, r.target) for r in g.rules.collect()] == [("p.B", 1, "p/B.java")]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # staged, so that no rule searches the imports again


def test_prompts_build_their_corpus_once(spark, sf_dir):
    plan = REGISTRY["txt_prompts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and plan.count("MapInPandas") == 1


def test_import_lists_of_repeated_files(spark):
    files = make_files(spark, [("A.java", "import b.C;\nimport a.D;\nclass A {\n}\n"), ("A.java", "import z.Z;\n"), ("B.java", "class B {\n}\n")])
    got = [(r.file, [tuple(x) for x in r.i]) for r in extract.import_lists(extract.symbol_table(files)).collect()]
    assert got == [("A.java", [(0, "b.C"), (0, "z.Z"), (1, "a.D")])]


def test_text_in_front_of_headers_is_not_searched():
    at = time.time()
    assert list(body.scan_members("java", " " * 40000 + "x")) == []
    assert time.time() - at < 1
    for code in ("class A { int x; }", "import subclass.X;\n  final \n class A { int x; } enum E {A, B}", "public  interface I { void f() { } }\nclass", "x class\nclass\tB { }"):
        for d in body.LANGUAGES["java"]:
            assert [m.span() for m in body._headers(d.header, code)] == [m.span() for m in d.header.finditer(code)]
