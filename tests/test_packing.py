"""Contexts cut to a budget against plain Python, and the sections that follow the files."""

import random

import pytest

from codegrid.operators import documents, packing
from codegrid.plans.materialize import checkpoint

SCHEMA = "repo string, section int, sort_key string, line string"


def _expected(rows, budget):
    texts = {}
    for repo, section, key, line in sorted(((r, s, k, li or "") for r, s, k, li in rows)):
        texts.setdefault(repo, []).append(line)
    return {(repo, i // budget): (-(-len(t) // budget), t[i:i + budget])
            for repo, t in ((r, "\n".join(ls)) for r, ls in texts.items()) for i in range(0, len(t), budget)}


def _got(spark, rows, budget):
    df = packing.context_parts(spark.createDataFrame(rows, SCHEMA), checkpoint, budget)
    return {(r.repo, r.part): (r.n_parts, r.context_part) for r in df.collect()}


@pytest.mark.parametrize("budget", [1, 7, 50, 100_000])
def test_parts_are_the_cut_text(spark, budget):
    draw = random.Random(budget)
    rows = [("hot" if draw.random() < 0.7 else f"r{draw.randrange(4)}", draw.randrange(3), f"k{draw.randrange(60)}",
             "".join(draw.choice("ab\n é\U0001f600") for _ in range(draw.choice([0, 1, 5, 30])))) for _ in range(400)]
    rows += [("hot", 1, "long", "x" * 3000), ("hot", 1, "none", None), ("hot", 1, "none", None), ("one", 0, "", "y")]
    assert _got(spark, rows, budget) == _expected(rows, budget)


def test_empty_contexts(spark):
    assert _got(spark, [], 5) == {}
    assert _got(spark, [("r", 0, "", "")], 5) == {}
    assert _got(spark, [("r", 0, "", ""), ("r", 0, "", None)], 5) == {("r", 0): (1, "\n")}
    with pytest.raises(ValueError):
        packing.context_parts(spark.createDataFrame([], SCHEMA), checkpoint, 0)


def test_requests_hold_every_part_for_every_section(spark):
    structure = {"name": "s", "sections": [{"id": f"i{i}", "title": f"T'{i}", "prompt": f'say "{i}"'} for i in range(11_000)]
                 + [{"id": "none", "title": "no prompt", "subsections": [{"id": "sub", "title": "Sub", "prompt": "p"}]}]}
    parts = spark.createDataFrame([("r", 0, 2, "abc"), ("r", 1, 2, "d")], "repo string, part long, n_parts long, context_part string")
    got = packing.section_requests(parts, structure).collect()
    assert len(got) == 2 * 11_001
    last = [r for r in got if r.section_id == "sub" and r.part == 1][0]
    assert (last.parent_id, last.ord, last.n_parts) == ("none", 11_001, 2)
    assert last.user_prompt == "# Section: Sub\n\n## Instructions\np\n\n## Codebase Context\nd"


def test_context_sections_without_a_catalog_say_nothing(spark):
    ctl = spark.createDataFrame([("a", "F.cs", "F", None), ("a", "G.cs", "G", "api/g")], "repo string, file string, controller string, route string")
    eps = spark.createDataFrame([], "repo string, file string, controller string, method string, class_ord long, method_ord long, verbs array<string>, route string")
    svc = spark.createDataFrame([("b", "interface", "IX")], "repo string, kind string, name string")
    flows = spark.createDataFrame([("c", "q", "X, Y", "f.cs")], "repo string, queue string, consumers string, file string")
    rows = documents.context_sections(ctl, eps, svc, flows).collect()
    text = {}
    for r in sorted(rows, key=lambda r: (r.repo, r.section, r.sort_key)):
        text.setdefault(r.repo, []).append(r.line)
    assert text == {"a": ["\n## Service Catalog\n", "### Controllers\n", "- F", "- G (Route: api/g)"],
                    "b": ["\n## Service Catalog\n", "\n### Interfaces", "- IX"],
                    "c": ["\n## Messaging Flows\n", "- Queue: q -> Consumers: X, Y"]}
