"""Folders that tasks list: the files Spark's own sources find, whatever the driver can hold (findings of round 4)."""
import os
import time

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codegrid.sources import listing, tree
from codegrid.streaming import files as streaming

NAMES = ["a/1.java", "a/b/c/d/2.java", "a/_3.java", "a/.4.java", "a/_x=1/5.java", "a/_y/6.java", ".git/7.java", "_metadata/8.java", "_metadata.java",
         "a/9.java._COPYING_", "a b/10%20.java", "ü/11é.java", "12.JAVA", "a/_z=.java", "13.txt", "node_modules/14.java", "e/f/15.java"]


def write(root, names, text="x"):
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}"), exist_ok=True)
        with open(f"{root}/{n}", "w") as f:
            f.write(text + n)


@pytest.fixture
def root(tmp_path):
    root = str(tmp_path / "in")
    write(root, NAMES)
    open(f"{root}/empty.java", "w").close()
    os.symlink(f"{root}/e", f"{root}/linked")
    os.symlink(f"{root}/nothing", f"{root}/broken.java")
    with open(f"{root}/bad.java", "wb") as f:
        f.write(b"class \xff\xfe A")
    with open(os.fsencode(root) + b"/\xff.java", "wb") as f:
        f.write(b"x")
    return root


def by_spark(spark, location):
    df = spark.read.format("binaryFile").schema(tree.BINARY_SCHEMA).option("recursiveFileLookup", "true").load(location)
    return sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in df.collect())


@pytest.mark.parametrize("few, cores", [(10_000, 8), (3, 8), (0, 1)])
def test_tasks_list_what_spark_lists(spark, root, monkeypatch, few, cores):
    monkeypatch.setattr(listing, "FEW", few)
    want = by_spark(spark, root)
    got = sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in listing.with_content(listing.listed(spark, [root], 3)).collect())
    assert got == want and len(want) > 10
    under = sorted(x for s in listing.shares([root], False, 4 * cores) for x in listing.entries(*s))
    assert [p for p, *_ in under] == [p for p, *_ in want]


def test_readers_list_nothing_in_the_driver(spark, root):
    for df in (tree.read_source_tree(spark, root), tree.read_source_tree(spark, "file://" + root), tree.rejected_files(spark, root),
               tree.read_single_file(spark, root + "/*/*"), tree.read_repo_snapshots(spark, root, with_branch=False)):
        assert not df.inputFiles() and "binaryFile" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count()
    got = {r.relative_path: r.content for r in tree.read_source_tree(spark, root, max_mb=1).collect()}
    assert got["bad.java"] == "class  A" and "13.txt" not in got and "linked/f/15.java" in got
    assert [r.name for r in tree.read_single_file(spark, root + "/13.txt").collect()] == ["13.txt"]
    for missing in (root + "/none", root + "/none/*", root + "/*/none/*"):
        with pytest.raises(AnalysisException):
            tree.read_single_file(spark, missing).collect()


def test_texts_are_held_in_pieces(spark, root, monkeypatch):
    # texts over the limit are files the filter drops before they are read
    write(root, ["big.java"], "y" * 2_000_000)
    sizes = {r.name: r.size_bytes for r in tree.read_source_tree(spark, root, max_mb=1).collect()}
    assert "big.java" not in sizes and {r.reason for r in tree.rejected_files(spark, root, max_mb=1).where("relative_path = 'big.java'").collect()} == {"oversized"}
    b = pa.RecordBatch.from_pydict({"path": ["a", "b", "c"]})
    out = listing._filled(b, [0, 2], [b"1", b"3"])
    assert out.to_pydict() == {"path": ["a", "c"], "content": [b"1", b"3"]}


def run(spark, root, folder, most=streaming.MAX_FILES):
    seen = []
    s = streaming.stream_files(spark, root, max_files_per_trigger=most).select("relative_path", "content")
    out = streaming.run_available_now(s, "inv", foreach_batch=lambda b, e, p: (seen.append(b.count()), streaming.write_epoch(b, e, p)), folder=folder, settings=streaming.FILE_SETTINGS)
    return sorted(r.relative_path for r in spark.read.parquet(out).collect()), [n for n in seen if n]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    root, first, other = (str(tmp_path / n) for n in ("in", "out", "other"))
    write(root, [f"d{i % 3}/f{i}.java" for i in range(20)])
    want = sorted(f"d{i % 3}/f{i}.java" for i in range(20))
    got, batches = run(spark, root, first, most=4)
    assert got == want and max(batches) <= 4 and sum(batches) == 20
    write(root, ["d0/f1.java", "late.java"])
    assert run(spark, root, first, most=4)[0] == sorted([*want, "d0/f1.java", "late.java"])
    os.remove(f"{root}/late.java")  # gone before another query comes to it
    got, batches = run(spark, root, other)
    assert got == sorted([*want, "d0/f1.java"]) and sum(batches) == 21
    assert run(spark, root, other)[1] == []


def test_running_stream_sees_files_that_come_later(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "WAIT", 1)
    monkeypatch.setattr(listing, "_FOLLOWED", {})
    root = str(tmp_path / "in")
    write(root, ["a.java"])
    s = streaming.stream_files(spark, root).select("relative_path", F.length("content").alias("n"))
    q = (s.writeStream.format("memory").queryName("later").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start())
    try:
        def until(want):
            end = time.time() + 60
            while time.time() < end and {r[0] for r in spark.table("later").collect()} != want:
                time.sleep(0.5)
            assert sorted(r[0] for r in spark.table("later").collect()) == sorted(want)
        until({"a.java"})
        write(root, ["sub/b.java"])
        until({"a.java", "sub/b.java"})
    finally:
        q.stop()
