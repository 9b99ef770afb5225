"""Operators on texts against brute force, with nulls, empties, ties, repeats and empty tables."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codegrid.llm import minhash, mixing, pieces, suffix

MODEL = pieces.default_model()


def _sets(text, width):
    w = (text or "").encode().lower().split()
    return set(zip(*[w[i:] for i in range(width)])) if len(w) >= width else ({tuple(w)} if w else set())


def test_near_duplicates(docs):
    got = minhash.near_duplicates(docs, width=3, percent=85).collect()
    rows = [r for r in docs.collect() if r.doc_id is not None]
    comp = {r.doc_id: r.doc_id for r in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                x, y = _sets(a.text, 3), _sets(b.text, 3)
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    comp[a.doc_id] = comp[b.doc_id] = min(comp[a.doc_id], comp[b.doc_id])
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            text = next(x.text for x in rows if x.doc_id == r.doc_id)
            assert (r.n_shingles, r.component_id, r.kept) == (len(_sets(text, 3)), comp[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_index_finds_all_pairs_within_the_radius():
    import numpy as np
    rng = np.random.default_rng(3)
    d = minhash.radius(85)
    plan = minhash.key_plan(d)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, minhash.K).astype(np.uint16)
        b = a.copy()
        b[rng.choice(minhash.K, d, replace=False)] ^= 1
        x, y = minhash.index_keys(np.stack([a, b]), plan)
        assert set(x) & set(y)


def test_a_pair_is_taken_under_one_shared_key(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    plan = minhash.key_plan(minhash.radius(85))
    rows = []
    for n in range(60):
        a = rng.integers(0, 1 << 16, minhash.K).astype(np.uint16)
        b = a.copy()
        b[rng.choice(minhash.K, n % 25, replace=False)] ^= rng.integers(1, 1 << 16, n % 25).astype(np.uint16)
        x, y = minhash.index_keys(np.stack([a, b]), plan)
        lanes = [s.astype("<u2").view("<i8").tolist() for s in (a, b)]
        rows += [(n, int(j), *lanes[0], *lanes[1]) for j in np.flatnonzero(x == y)]
    cols = ["pair", "j"] + [f"{side}_{c}" for side in "ab" for c in minhash.LANES]
    df = spark.createDataFrame(rows, cols).select("pair", *[F.struct(F.col("j"), *[F.col(f"{side}_{c}").alias(c) for c in minhash.LANES]).alias(side) for side in "ab"])
    met = df.groupBy("pair").agg(F.count_if(minhash._first_shared("a", "b", plan)).alias("n")).collect()
    assert len(met) > 40 and all(r.n == 1 for r in met)


def test_pairs_just_below_the_threshold_are_not_confirmed(spark, monkeypatch):
    core = " ".join(f"core{i}" for i in range(100))
    # any two of a group have 98 of 122 shingles in common, 0.80; the last ones are near copies of some of the group
    rows = [(i, core + " " + " ".join(f"own{i}x{n}" for n in range(12))) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(f"own{i}x11", "other")) for i in (7, 31, 58)]
    asked, before = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: (asked.append(pairs.distinct().count()), before(pairs, *rest))[1])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - 100 if i >= 100 else i for i, _ in rows}
    assert sum(asked) < 10 * len(rows)  # of 1953 pairs


def test_parities_differ_in_no_more_bits_than_the_sets_in_shingles():
    import numpy as np
    rng = np.random.default_rng(5)
    for n in (1, 40, 300, 3000):
        both, a, b = (rng.integers(0, 1 << 64, k, dtype=np.uint64) for k in (n, n // 7, n // 5))
        x, y = (minhash.parities(np.union1d(both, own)) for own in (a, b))
        differing = int((x != y).sum())
        assert differing <= len(a) + len(b) and (n > 300 or differing >= 0.8 * (len(a) + len(b)))


def _spans(rows, depth):
    first = {}
    for i, t in rows:
        b, rank = (t or "").encode(), float("inf") if i is None else i
        for k in range(len(b) - depth + 1):
            s = b[k:k + depth]
            first[s] = min(first.get(s, rank), rank)
    for i, t in rows:
        b, rank = (t or "").encode(), float("inf") if i is None else i
        gone = [False] * len(b)
        for k in range(len(b) - depth + 1):
            if first[b[k:k + depth]] < rank:
                gone[k:k + depth] = [True] * depth
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()


def _got_spans(df, depth):
    out = suffix.dedup_spans(df, depth=depth).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    return sorted(map(tuple, out.collect()), key=repr)


def test_repeated_spans(docs):
    assert _got_spans(docs, 50) == sorted(_spans([(r.doc_id, r.text) for r in docs.collect()], 50), key=repr)


def test_repeated_spans_of_random_splices(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randint(30, 140))) for _ in range(12)]
    rows = [(rng.choice([None, *range(25)]), "".join(rng.choice(pool) for _ in range(rng.randint(0, 5)))) for _ in range(60)]
    assert _got_spans(spark.createDataFrame(rows, "doc_id long, text string"), 50) == sorted(_spans(rows, 50), key=repr)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-9
    assert sum(t for _, t in by) == pytest.approx(total)
    for (_, t), part in by.items():
        assert abs(sum(r.taken for r in part) - t) <= max(r.size for r in part)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert mixing.emitted(docs).columns == docs.columns


def test_pieces_match_the_library(docs):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    enc = pieces.encode(docs, MODEL)
    for r in enc.collect():
        assert r.ids == (None if texts[r.doc_id] is None else lib.encode(texts[r.doc_id]))
    for r in pieces.decode(enc, MODEL).collect():
        assert r.text == texts[r.doc_id]
    m = pieces.Model(open(MODEL, "rb").read())
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", "日", "😀", "①", "th", "the", "<s>", "<0x0A>", "\x00", "    ", "ing", "aa", ""]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 15)))
        ids = lib.encode(t)
        assert m.encode(t).tolist() == ids and m.decode(ids) == lib.decode(ids)


def test_pieces_with_clashing_columns_and_bounded_caches(spark, monkeypatch):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, i, "x", None, True) for i, t in enumerate(["one two", None, "", "three  four ", "word " * 50_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, row string, n_ids int, restored boolean")
    got = pieces.round_trip(df, MODEL)
    assert got.columns == ["doc_id", "row", "ids", "n_ids", "restored"]
    for r, t in zip(got.orderBy("doc_id").collect(), [t for _, t, *_ in rows]):
        assert r.ids == (None if t is None else lib.encode(t)) and r.n_ids == len(r.ids or []) and r.restored == (None if t is None else True)
    back = pieces.decode(got.withColumn("text", pieces.F.lit("old")), MODEL)
    assert [r.text for r in back.orderBy("doc_id").collect()] == [t for _, t, *_ in rows]
    assert pieces.encode(df.select("text"), MODEL).columns == ["ids"]
    # a cache that holds a few words only gives the same ids
    monkeypatch.setattr(pieces, "CACHE", 4000)
    m = pieces.Model(open(MODEL, "rb").read())
    texts = [" ".join(random.Random(k).choices(["alpha", "beta", "the", "ofing", "zzz", "naïve"], k=40)) for k in range(20)]
    assert all(m.encode(t).tolist() == lib.encode(t) for t in texts + texts)


def test_empty_tables(docs):
    none = docs.where("false")
    for df in (minhash.near_duplicates(none), suffix.dedup_spans(none), mixing.mix(none), pieces.encode(none, MODEL)):
        assert df.count() == 0
