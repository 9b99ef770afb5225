"""The divergence audit against counts and sums in plain Python."""
import random
import re
from collections import Counter, defaultdict

import pytest

from codegrid.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        words = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        mine = [s for g, s in groups if g == lang]

        def weights(count):
            below = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (count[t] + 1) // below for t in kept}
        whole = weights(sum((counts[lang, s] for s in mine), Counter()))
        each = {s: weights(counts[lang, s]) for s in mine}
        for s in mine:
            pairs = [(-sum((each[s][t] - each[o][t]) ** 2 // each[o][t] for t in kept), o.encode(), o) for o in mine if o != s]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))}
            terms = [(-((each[s][t] - whole[t]) ** 2 // whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and each[s][t] > whole[t]]
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])}
    return out


def corpus():
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["ÜBER", "über", "Zeit", "\U0001f600x", "é"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "e", None, ""]), " ".join(rng.choices(words, k=rng.randrange(40)))) for _ in range(160)]
    rows += [("en", "hot", "the same, THE same; the-same 7 times")] * 80  # repeated rows
    rows += [("fr", "alone", "un deux"), ("fr", "bare", None), ("fr", "none", ""), ("xx", "only", "\x00\t\n 12")]
    return rows


@pytest.mark.parametrize("groups,terms", [(divergence.GROUPS, divergence.TERMS), (2, 7)])
def test_against_brute_force(spark, monkeypatch, groups, terms):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, term int, p string, rank long")
    for top in (200, 3):
        got = [tuple(r) for r in divergence.audit(df, top_terms=top).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, top=top)


def test_long_text_in_slices(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 5)
    text = "Some words, and é more ".encode() * 50
    assert sum((list(w) for w in divergence._words(text)), []) == text.lower().replace(b",", b" ").split()


def test_empty_table(spark):
    out = divergence.audit(spark.createDataFrame([], "lang string, source string, text string"))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0
