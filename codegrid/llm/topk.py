"""Exact search by inner product: term-at-a-time accumulation over all rows.

Components become integers floor(scale * x). Rows are packed in blocks with the postings of every dimension (places and weights of
its non-zero components). For a block of rows and a block of queries, each dimension's posting list is scattered, weighted by the
queries' components, into a dense array of scores; partition selection keeps each query's k best of the block, and the blocks'
answers are merged by rank, in partial steps before the shuffle (window group limit). All integer arithmetic, so exact.

The queries are a stated set (ids divisible by ``every``). They travel in blocks of about ``QUERIES``, rows meet every block of them, and no task
or driver holds all queries, rows or answers.

Rows whose vector is null, or holds a null or non-finite component, take no part; null ids neither. Vectors of different lengths score
over the shorter. Rows of a repeated id are candidates of their own, but never for their own id. Ties go to the smaller id.

Scores are 64-bit where the largest component of the block, that of the query and the dimensions cannot exceed it, and Python integers
otherwise; rows with large components stand in blocks of their own, so that the others keep to 64 bits. Ranks are exact at any size; a score
that fits no long is null in the result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from codegrid.llm.common import partitions, staged

QUERIES, ROWS = 1024, 2048
_LARGE = 1 << 27  # components from which on a row stands in other blocks
_WHOLE = float(1 << 53)  # components up to which the scaled values travel as longs, above as the doubles they were
_LONG = 1 << 63


def _integers(values, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, also where the product leaves the doubles."""
    return np.array([math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in map(float, values)], object)


def _block(ids: np.ndarray, vectors: list, kind) -> pd.DataFrame:
    width = max(map(len, vectors), default=0)
    x = np.zeros((width, len(vectors)), kind)
    for i, v in enumerate(vectors):
        x[:len(v), i] = v
    dim, place = np.nonzero(x)
    return pd.DataFrame({"ids": [ids.tobytes()], "offsets": [np.searchsorted(dim, np.arange(width + 1)).astype(np.int64).tobytes()],
                         "places": [place.astype(np.int32).tobytes()], "weights": [x[dim, place].tobytes()], "raw": [kind is np.float64]})


def _postings(frames):
    """Rows in blocks: ids, and for each dimension with non-zero weights its places and weights, end to end. Rows with large components,
    and those that come unscaled (``raw``), make blocks of their own."""
    for pdf in frames:
        for a in range(0, len(pdf), ROWS):
            part = pdf.iloc[a:a + ROWS]
            ids = part["id"].to_numpy(np.int64)
            group = np.array([2 if x is None else int(len(x) and max(x.max(), -x.min()) >= _LARGE) for x in part["x"]])
            for g, column, kind in ((0, "x", np.int64), (1, "x", np.int64), (2, "raw", np.float64)):
                at = np.flatnonzero(group == g)
                if len(at):
                    yield _block(ids[at], [part[column].iat[i] for i in at], kind)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of a query's k best: those above the k-th score, and of those equal to it the smallest ids."""
    if len(scores) <= k:
        return np.arange(len(scores))
    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, level = np.flatnonzero(scores > kth), np.flatnonzero(scores == kth)
    need = k - len(above)
    return np.concatenate([above, level[np.argsort(ids[level], kind="stable")[:need]]])


def _key(score: int) -> bytes | None:
    """Bytes in the order of the scores, for those of one sign that fit no long."""
    if -_LONG <= score < _LONG:
        return None
    size = (abs(score).bit_length() + 7) // 8
    out = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return out if score > 0 else bytes(255 - b for b in out)


def _search(k: int, scale: int):
    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                ids, off = np.frombuffer(row.ids, np.int64), np.frombuffer(row.offsets, np.int64)
                places = np.frombuffer(row.places, np.int32)
                weights = _integers(np.frombuffer(row.weights), scale) if row.raw else np.frombuffer(row.weights, np.int64)
                width = max(len(off) - 1, 0)
                asked = [(q["id"], (_integers(q["raw"], scale) if q["x"] is None else q["x"])[:width]) for q in row.queries]
                top = int(np.abs(weights).max(initial=0))
                long = [top < _LONG and top * int(np.abs(v).max(initial=0)) * width < _LONG and v.dtype != object for _, v in asked]
                for kind in (np.int64, object):
                    mine = [q for q, fits in zip(asked, long) if fits == (kind is np.int64)]
                    w = weights.astype(kind) if mine else None
                    out = []
                    for a in range(0, len(mine), 128):
                        part = mine[a:a + 128]
                        q = np.zeros((len(part), width), kind)
                        for i, (_, v) in enumerate(part):
                            q[i, :len(v)] = v
                        acc = np.zeros((len(part), len(ids)), kind)
                        for d in range(width):
                            s = slice(off[d], off[d + 1])
                            if s.stop > s.start:
                                acc[:, places[s]] += q[:, d, None] * w[None, s]
                        for (query, _), scores in zip(part, acc):
                            other = ids != query
                            best = _best(scores[other], ids[other], k)
                            out.append((np.full(len(best), query), ids[other][best], scores[other][best]))
                    if out:
                        query_id, vec_id, score = map(np.concatenate, zip(*out))
                        found = pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": 0, "beyond": 0, "key": None})
                        if kind is object:
                            found["score"] = pd.array([s if -_LONG <= s < _LONG else None for s in score], dtype="Int64")
                            found["beyond"] = [int(s >= _LONG) - int(s < -_LONG) for s in score]
                            found["key"] = pd.Series([_key(s) for s in score], dtype=object)
                        else:
                            found["score"] = score
                        yield found
    return run


def search(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    raw = F.transform("embedding", lambda v: v.cast("double"))
    ok = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    whole = F.forall("embedding", lambda v: F.abs(v.cast("double") * scale) < _WHOLE)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(ok)
    rows = staged(rows.select(F.col("vec_id").cast("long").alias("id"), F.when(whole, F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))).alias("x"),
                              F.when(~whole, raw).alias("raw")), "topk-rows")
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "x", "raw")).alias("queries"))
    posted = rows.repartition(partitions(spark)).mapInPandas(_postings, "ids binary, offsets binary, places binary, weights binary, raw boolean")
    posted = posted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    best = posted.join(asked, "block").repartition(partitions(spark)).mapInPandas(_search(k, scale), "query_id long, vec_id long, score long, beyond int, key binary")
    order = [F.desc("beyond"), F.desc("score"), F.desc("key"), F.col("vec_id")]
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
