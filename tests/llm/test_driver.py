"""What must not pass the driver: findings of round 4."""
import numpy as np

from codegrid.llm import vectors
from codegrid.llm.common import connected_components


def test_vectors_are_never_sent_whole(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    x[1::2] = x[::2] + rng.normal(size=(300, 8)) * 0.01
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    staged, plans = vectors.staged, []
    monkeypatch.setattr(vectors, "staged", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), staged(df, name))[1])
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cosine=0.99)
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert {"itq-links", "itq-comp", "out"} <= {name for name, _ in plans}
    for name, plan in plans:
        assert "BroadcastExchange" not in plan, name
    got = {r.vec_id: r.component_id for r in out.collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 600, 2)) >= 270


def test_components_by_merged_joins(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (9, 9)], "a long, b long")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    for by in (None, "merge"):
        assert {r.id: r.component for r in connected_components(edges, by=by).collect()} == want
