"""Models and searches: held-out accuracy, brute force, small cases."""
import os
from fractions import Fraction

import numpy as np
import pytest

from codegrid.llm import html, queries, quality, topk, toxicity, urls, vectors


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_quality_held_out(spark, sf_dir):
    sf = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    rows = queries.op4_quality_classifier(spark, sf).where("held_out").join(_table(spark, sf, "labels"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}


def test_toxicity_held_out(spark, sf_dir):
    sf = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    docs, labels = _table(spark, sf, "documents"), queries.toxicity_labels(spark, sf)
    rows = toxicity.score_documents(docs, labels.where("doc_id % 4 <> 1")).join(labels.where("doc_id % 4 = 1").withColumnRenamed("toxic", "told"), "doc_id").collect()
    assert np.mean([r.toxic for r in rows if r.told]) > 0.85 and np.mean([r.toxic for r in rows if not r.told]) < 0.01


def test_toxicity_edge_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, low_quality int, toxic int")
    rows = toxicity.score_documents(docs, none).collect()
    assert len(rows) == docs.count() and not any(r.toxic for r in rows)


@pytest.fixture(scope="module")
def some_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centre[i % 40] + rng.normal(size=16) * (0.05 + 0.4 * (i % 3))], i % 3) for i in range(400)]
    rows += [(400 + i, rows[i][1], rows[i][2]) for i in range(20)]  # copies
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None),
             (None, rows[0][1], 0), (600, [float("inf")] * 16, 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_near_vectors(some_vectors):
    rows, df = some_vectors
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    good = [r for r in rows if r[0] is not None and r[0] < 500]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in good])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    links = near.sum(axis=1) - 1
    found = np.array([got[r[0]].n_links for r in good])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum() > 0
    assert all(got[i].n_links == 0 and got[i].kept for i in (500, 501, 502, 503, 504, 600))


def test_near_vectors_recall_in_large_groups(spark):
    """Groups of near copies of 2 to 400 vectors, and exact copies, in 64 dimensions."""
    rng = np.random.default_rng(11)
    rows = []
    for size in (2, 5, 30, 400):
        centre = rng.normal(size=64)
        rows += [(len(rows) + i, (centre + 0.2 * rng.normal(size=64)).tolist(), size % 3) for i in range(size)]
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(60)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    links = ((x @ x.T >= 0.93) & (label[:, None] == label)).sum() - len(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert links >= vectors.near_duplicates(table).groupBy().sum("n_links").first()[0] >= 0.9 * links > 0


def _near_rows(rng, n, d, label, first, common=0.0):
    """n vectors and for each a partner at a cosine of 0.93 to 0.96, none equal; ``common`` is the cosine of unrelated ones."""
    x = rng.normal(size=(n, d))
    x = np.sqrt(1 - common) * x / np.linalg.norm(x, axis=1)[:, None] + np.sqrt(common) * np.ones(d) / np.sqrt(d)
    x /= np.linalg.norm(x, axis=1)[:, None]
    w = rng.normal(size=(n, d))
    w -= (w * x).sum(axis=1)[:, None] * x
    t = rng.uniform(0.93, 0.96, size=(n, 1))
    y = t * x + np.sqrt(1 - t * t) * w / np.linalg.norm(w, axis=1)[:, None]
    return [(first + i, v.tolist(), label) for i, v in enumerate(np.stack([x, y], axis=1).reshape(-1, d))]


def _recall(spark, rows):
    """Links found and links there are, over vectors none of which are equal; no row may have more links than there are."""
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    there = {r[0]: 0 for r in rows}
    for d, label in {(len(r[1]), r[2]) for r in rows}:
        part = [r for r in rows if (len(r[1]), r[2]) == (d, label)]
        x = np.array([r[1] for r in part])
        x /= np.linalg.norm(x, axis=1)[:, None]
        there.update(zip([r[0] for r in part], ((x @ x.T >= 0.93).sum(axis=1) - 1).tolist()))
    assert len(got) == len(rows) and all(got[i] <= there[i] for i in got)
    return got, there


def test_near_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows = _near_rows(rng, 300, 48, 0, 0) + _near_rows(rng, 300, 48, 1, 600)
    rows += _near_rows(rng, 300, 64, 0, 2000) + _near_rows(rng, 20, 24, 1, 4000)
    got, there = _recall(spark, rows)
    for low, high in ((0, 2000), (2000, 4000), (4000, 5000)):
        assert sum(n for i, n in got.items() if low <= i < high) >= 0.9 * sum(n for i, n in there.items() if low <= i < high) > 0


@pytest.mark.parametrize("common", [0.0, 0.8, 0.9])
def test_near_vectors_with_a_common_direction(spark, common):
    got, there = _recall(spark, _near_rows(np.random.default_rng(4), 1000, 64, 0, 0, common))
    assert sum(got.values()) >= 0.9 * sum(there.values()) > 0


def test_topk(some_vectors):
    rows, df = some_vectors
    got = [tuple(r) for r in topk.search(df, k=5, every=50).orderBy("query_id", "rank").collect()]
    good = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i % 50 == 0:
            best = sorted(((-int(q @ v), j) for j, v in good if j != i))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want) and topk.search(df.where("false")).count() == 0


def test_topk_keeps_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    rows[10], rows[20] = (10, [200000.0] + rows[10][1][1:]), (20, [-200000.0] + rows[20][1][1:])
    rows += [(60 + i, [float(x) for x in rng.normal(size=8) * 10.0 ** (4 + 2 * i)]) for i in range(10)]
    rows += [(70, [1e30] * 8), (71, [-1e30] * 8), (72, [1e300, -1e307] + [0.5] * 6), (80, [1e30, -2e30, 0.25]), (81, [float("inf")] * 8)]
    whole = [(i, [int(Fraction(x) * 1024 // 1) for x in v]) for i, v in rows if i != 81]
    want = []
    for i, q in whole:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)[:10]
            want += [(i, r + 1, j, -s if -2 ** 63 <= -s < 2 ** 63 else None) for r, (s, j) in enumerate(best)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, every=10)
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == sorted(want, key=lambda r: r[:2])
    assert any(s is not None and abs(s) > 2 ** 54 for *_, s in want) and any(s is None for *_, s in want)


def test_urls(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.site.net/x/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows + [(90, None), (91, "nothing"), (92, "https://A.Example.ORG/es/1?q#f"), (93, "http://example.org"),
                                          (94, "http://x.com/fr/1"), (95, "http://notexample.org/es/1"), (90, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(60)], "page_id long, block boolean")
    got = {r.page_id: r for r in urls.judge(pages, labels, queries.URL_RULES, min_support=0.1, min_confidence=0.8).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(60))
    assert (got[90].host, got[90].path, got[90].verdict) == ("", "", "allow") and got[91].host == ""
    assert (got[92].host, got[92].path, got[92].rule, got[92].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[93].rule is None and got[94].rule == "com/fr/" and got[95].rule == "org/"
    assert urls.judge(pages.where("false"), labels.where("false"), queries.URL_RULES).count() == 0


def test_html_marginals_by_enumeration():
    import itertools
    page = html.Page("<body><nav><a href=x>a</a></nav><div class=content><p>one two three four<p>five <b>six</b></div></body>")
    m = html.Model().ready()
    follow, words, links, places = m.p
    total, on = 0.0, np.zeros(len(page.parent))
    for s in itertools.product((0, 1), repeat=len(page.parent)):
        w = 1.0
        for i in range(1, len(s)):
            looks = page.looks[i]
            w *= follow[html.KINDS if looks else page.kind[i]][s[page.parent[i]]][s[i]]
            if looks:
                w *= words[s[i]][looks[0]] * links[s[i]][looks[1]] * places[s[i]][looks[2]]
        total, on = total + w, on + w * np.array(s)
    assert np.allclose(m.marginals(page), on / total)


def test_html_cases(spark):
    m = html.Model().ready()
    assert m.extract(None) == m.extract("") == m.extract("<p") == ""
    text = m.extract("<header><h1>Site</h1></header><aside><p>Some long text in the side bar that goes on for long.</p></aside><article><h2>T &amp; U</h2>"
                     "<script>var t='</p>';</script><p>One  two<br>three four five six.<p>Seven <b>eight nine ten eleven.</article><footer>c</footer>")
    assert text == "T & U\nOne two three four five six.\nSeven eight nine ten eleven."
    pages = spark.createDataFrame([(1, "u", None), (None, None, "<article><p>A text of some length stands here.</article>")], "page_id long, url string, html string")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sorted(len(r.text) == r.n_chars and r.n_chars for r in html.extract_pages(pages, docs).collect()) == [0, 34]
