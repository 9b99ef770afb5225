"""Keyed state, replayed epochs, restarts, tables that are folders."""
import time

from pyspark.sql import functions as F

from codegrid.plans import registry
from codegrid.streaming import files as streaming

SCHEMA = "k string, v long, t timestamp, p string"


def deliver(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "k string, v long, s long, p string").select("k", "v", F.timestamp_seconds("s").alias("t"), "p")
    df.coalesce(1).write.parquet(f"{folder}/{name}")


def view(spark, out):
    return {r.k: (r.v, r.p) for r in streaming.latest_view(spark, out, "k", "v", "t", ["p"]).collect()}


def test_latest_version_over_restarts_and_evictions(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def run(ttl):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
        return streaming.run_available_now(streaming.latest_version(stream, "k", "v", "t", ["p"], ttl_seconds=ttl), "latest", "update", streaming.write_epoch, folder=out, settings=streaming.LATEST_SETTINGS)
    deliver(spark, src, "a", [("x", 1, 10, "one"), ("y", 5, 10, "five"), ("x", 2, 5, "two"), (None, 9, 9, "none"), ("z", None, 9, "none")])
    deliver(spark, src, "b", [("x", 1, 10, "one"), ("y", 6, 1, "late but newer"), ("w", 1, 1, "b"), ("w", 1, 1, "a")])
    log = run(3600)
    assert view(spark, log) == {"x": (2, "two"), "y": (6, "late but newer"), "w": (1, "b")}
    rows = spark.read.parquet(log).count()
    # a restart with nothing but re-delivered rows: state is kept, nothing passes
    deliver(spark, src, "c", [("x", 2, 5, "two"), ("y", 5, 10, "five"), ("w", 1, 1, "a")])
    run(3600)
    assert spark.read.parquet(log).count() == rows
    deliver(spark, src, "d", [("x", 3, 1, "three")])
    run(3600)
    assert view(spark, log)["x"] == (3, "three") and spark.read.parquet(log).count() == rows + 1


def test_evicted_state_does_not_change_the_view(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src)
        return streaming.run_available_now(streaming.latest_version(stream, "k", "v", "t", ["p"], ttl_seconds=1), "latest", "update", streaming.write_epoch, folder=out, settings=streaming.LATEST_SETTINGS)
    deliver(spark, src, "a", [("x", 2, 10, "two")])
    log = run()
    time.sleep(2)
    deliver(spark, src, "b", [("x", 1, 10, "one")])  # its state is gone: an old version passes
    run()
    assert spark.read.parquet(log).count() == 2 and view(spark, log) == {"x": (2, "two")}


def test_events_in_a_folder_of_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in registry.REGISTRY["str_latest"](spark, str(tmp_path)).collect()}
    want = events.groupBy("user_id").agg(F.max(F.struct("event_id", "ts", "event_type")).alias("m")).select("user_id", "m.*")
    assert got == {tuple(r) for r in want.collect()}


def test_replayed_epochs_count_once(spark, sf_dir, tmp_path):
    files = registry.fixtures.fx_mq(spark, sf_dir)
    cands = registry.messaging.messaging_candidates(files).persist()
    parts = [cands.where(F.pmod(F.xxhash64("relative_path"), F.lit(2)) == i) for i in (0, 1)]
    write, out = streaming.write_tables(registry.MQ_TABLES), str(tmp_path / "data")
    for epoch in (0, 1, 1, 0):
        write(parts[epoch], epoch, out)
    for name, rows in streaming.read_tables(spark, out, registry.MQ_TABLES).items():
        whole = registry.MQ_TABLES[name](cands)
        assert rows.columns == whole.columns and rows.exceptAll(whole).count() == 0 and whole.exceptAll(rows).count() == 0, name
