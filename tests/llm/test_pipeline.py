"""The pipeline and the queries that SQL can express."""
import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from codegrid.llm.oracles import ORACLES
from codegrid.llm.queries import QUERIES


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if i < 3:
            assert 0 < docs.count() <= seen
            seen = docs.count()
    assert docs.where("NOT restored").count() == 0


def test_near_duplicates_go_by_row(spark, sf_dir):
    a, b, c = (" ".join(f"{w}{i}" for i in range(80)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (None, c), (None, c), (None, c + " more"), (None, a), (3, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == corpus_pipeline.COLUMNS and len(kept) == 5
    assert {(1, a), (2, b), (3, None), (4, None)} < set(kept) and [t for i, t in kept if i is None][0] in (c, c + " more")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    want = sorted(tuple(r[i] for i in order) for r in want.fetchall())
    got = sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).select(*columns).collect())
    assert got == want and got


def test_tasks_give_memory_back():
    """What a Python worker keeps of its tasks stands beside the executor's heap through all later stages."""
    code = """
import numpy as np, pandas as pd, pyarrow as pa
from codegrid.llm import minhash, suffix

def held():
    return sum(int(l.split()[1]) for l in open("/proc/self/smaps_rollup") if l.startswith("Pss_Anon")) / 1024

def frames():
    draw = np.random.default_rng(7)
    words = [f"w{i}x" for i in range(20000)]
    for a in range(0, 6000, 3000):
        texts = [" ".join(words[i] for i in draw.integers(0, 20000, 450)) for _ in range(3000)]
        yield pd.DataFrame({"id": np.arange(a, a + 3000), "dup": 0, "no_id": False, "text": texts, "raw": [t.encode() for t in texts]})

def run(task):
    return sum(len(pdf) for pdf in task(frames()))

run(lambda rows: rows)
before = held()
assert run(minhash._signatures(5)) == 6000 and run(suffix._all_runs(50, 8)) > 0
print(held() - before)
"""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout.split()[-1]) < 70
