"""Near-duplicate vectors by iterative quantisation and a multi-index Hamming join.

Codes: vectors are scaled to length 1 and centred, rotated to principal axes, then by the rotation that brings them closest to the corners of
the cube (alternating codes and an orthogonal Procrustes step), so bits are balanced; the sign of each axis is a bit. Mean, covariance come
from sums over all vectors; the rotation is learned from at most ``SAMPLE`` of them, drawn by a hash (a documented bound). Every vector is indexed.

Retrieval: the bits of a code are cut into ``TABLES`` chunks; every vector is entered under each of its chunks and looks up each chunk and
all its one-bit neighbours, together with its label. A pair is taken up at the first chunk that brings it together, if the codes differ in at
most ``radius`` bits, then reranked: the exact cosine, in double precision, decides.

Recall: centring takes away what vectors have in common, so a cosine at the threshold can be any angle between codes. The quantiser therefore
tries itself on up to ``TRIALS`` vectors of its sample, each with two partners exactly at the threshold (one in a random direction, one in that
of another vector), and adds codes with rotations of their own until ``RECALL`` of both kinds of pairs are found. If ``CODES`` codes are not
enough, all pairs of a label are compared, block by block. Pairs near the threshold can still be missed by the index; ``tests/llm`` measures
its recall over distinct vectors against brute force, also where unrelated vectors have a high cosine.

Equal vectors of one label are one class with a count, so copies cost nothing. Vectors that are null, zero or hold null or non-finite
components, and those without a label, link with nothing. Null ids take no part but keep their row. Repeated ids are one node of the graph.
Only vectors of equal length have a cosine: each length has its own quantiser and index; lengths of at most ``FEW`` classes, too few to learn
from, are compared pair by pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codegrid.llm.common import connected_components, staged

SAMPLE = 20_000
TABLES, RADIUS = 5, 18
CODES, RECALL, TRIALS = 4, 0.95, 4000
ROUNDS = 40
FEW = 256
BLOCK = 1 << 20  # components of a block in which all pairs are compared
#: joins by id or by chunk are between tables as large as the vectors; a table just small enough to be sent whole, or judged so by its size before
#: its rows are entered under all their chunks, would pass the driver
BY_ID = "merge"


def _sums(frames):
    total, n = None, 0
    for pdf in frames:
        if len(pdf):
            x = np.stack(pdf["u"])
            m = np.column_stack([np.ones(len(x)), x])
            total = m.T @ m if total is None else total + m.T @ m
    if total is not None:
        yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})


def trial_pairs(x: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """x and partners of its rows exactly at the cosine: away in random directions, and in those of other rows."""
    rng = np.random.default_rng(11)
    noise = rng.normal(size=x.shape)
    out = []
    for w in (noise, x[rng.permutation(len(x))]):
        w = w - (w * x).sum(axis=1)[:, None] * x
        far = np.linalg.norm(w, axis=1) > 1e-6
        w = w[far] / np.linalg.norm(w[far], axis=1)[:, None]
        if len(w):
            out.append((x[far], cosine * x[far] + np.sqrt(1 - cosine ** 2) * w))
    return out


class Quantiser:
    """Centre of the codes, a rotation for each, and the distance up to which pairs are taken; ``recall`` is that of the trial pairs."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, sample: np.ndarray, cosine: float) -> None:
        d = len(mean)
        bits = min(64, d)
        _, axes = np.linalg.eigh(cov)
        axes = axes[:, ::-1][:, :bits]
        v = (sample - mean) @ axes
        self.mean, self.maps, self.bits, self.recall = mean, [], bits, 0.0
        trials = trial_pairs(sample[:TRIALS], cosine)
        while self.recall < RECALL and len(self.maps) < CODES:
            r = np.linalg.qr(np.random.default_rng(7 + len(self.maps)).normal(size=(bits, bits)))[0]
            for _ in range(ROUNDS if len(v) else 0):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            self.maps.append(axes @ r)
            self.recall = self._try(trials)

    def _try(self, trials: list) -> float:
        """Share of the trial pairs found, of the worse kind; sets the radius."""
        found, apart = [], []
        for x, y in trials:
            z = [self._bits(x, m) != self._bits(y, m) for m in self.maps]
            found.append(np.any([z[c][:, lo:hi].sum(axis=1) <= 1 for c, lo, hi in self.chunks()], axis=0))
            apart.append(np.sum([b.sum(axis=1) for b in z], axis=0))
        self.radius = max([RADIUS] + [int(np.quantile(a, 0.998, method="higher")) for a in apart])
        return min((float((f & (a <= self.radius)).mean()) for f, a in zip(found, apart)), default=0.0)

    def _bits(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ m >= 0

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The codes of each vector, one row per vector."""
        places = np.arange(self.bits, dtype=np.uint64)
        return np.stack([(self._bits(x, m).astype(np.uint64) << places).sum(axis=1, dtype=np.uint64).view(np.int64) for m in self.maps], axis=1)

    def chunks(self) -> list[tuple[int, int, int]]:
        """(code, first bit, last bit + 1) of every table."""
        cut = np.linspace(0, self.bits, min(TABLES, self.bits) + 1).round().astype(int).tolist()
        return [(c, lo, hi) for c in range(len(self.maps)) for lo, hi in zip(cut[:-1], cut[1:])]


def _unit(v) -> F.Column:
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / norm)


def learn(units: DataFrame, d: int, n: int, cosine: float) -> Quantiser:
    """The quantiser of ``units``, n vectors of length d."""
    m = np.zeros((d + 1) ** 2)
    for r in units.mapInPandas(_sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # (d + 1) ** 2 numbers
        m[r.at] = r.value
    m = m.reshape(d + 1, d + 1)
    mean = m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
    share = min(1.0, SAMPLE / n)
    sample = units.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("id", "u").collect()  # at most about SAMPLE
    return Quantiser(mean, cov, np.array([r.u for r in sorted(sample, key=lambda r: r.id)]).reshape(-1, d), cosine)


def _chunk(code, lo: int, hi: int):
    return F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def candidates(coded: DataFrame, q: Quantiser) -> DataFrame:
    """(a, b) of the pairs that the index brings together; coded: id, label, codes."""
    chunks, n = q.chunks(), len(q.maps)
    names = [f"c{c}" for c in range(n)]
    coded = coded.select("id", "label", *[F.col("codes")[c].alias(name) for c, name in enumerate(names)])
    own = [F.struct(F.lit(i).alias("t"), _chunk(F.col(names[c]), lo, hi).alias("v")) for i, (c, lo, hi) in enumerate(chunks)]
    near = own + [F.struct(F.lit(i).alias("t"), _chunk(F.col(names[c]), lo, hi).bitwiseXOR(F.lit(1 << j)).alias("v"))
                  for i, (c, lo, hi) in enumerate(chunks) for j in range(hi - lo)]
    base = coded.select("id", "label", *names, F.explode(F.array(*own)).alias("k")).select("id", "label", *names, "k.*").alias("x")
    look = coded.select("id", "label", *names, F.explode(F.array(*near)).alias("k")).select("id", "label", *names, "k.*").alias("y")
    apart = [F.col(f"x.{name}").bitwiseXOR(F.col(f"y.{name}")) for name in names]
    bits = F.lit(0)
    for a in apart:
        bits = bits + F.bit_count(a)
    # not at an earlier chunk already
    first = F.lit(True)
    for i, (c, lo, hi) in enumerate(chunks[:-1]):
        first = first & ((F.col("x.t") <= i) | (F.bit_count(_chunk(apart[c], lo, hi)) > 1))
    on = ((F.col("x.label") == F.col("y.label")) & (F.col("x.t") == F.col("y.t")) & (F.col("x.v") == F.col("y.v"))
          & (F.col("x.id") < F.col("y.id")) & (bits <= q.radius) & first)
    return base.join(look.hint(BY_ID), on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def compared(units: DataFrame, d: int, cosine: float) -> DataFrame:
    """(a, b) of all pairs of one label that reach the cosine: every block of vectors against itself and every other."""
    blocks = units.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / max(256, BLOCK // max(d, 1))).cast("int").alias("blocks"))
    dealt = (units.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "u"))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x, y = ((p["id"].to_numpy(), np.stack(p["u"]) if len(p) else np.zeros((0, d))) for p in (pdf[pdf["block"] == i], pdf[pdf["block"] == j]))
        out = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(x[0]), 256):
            m, k = np.nonzero(x[1][at:at + 256] @ y[1].T >= cosine - 1e-9)
            m += at
            if i == j:
                m, k = m[x[0][m] < y[0][k]], k[x[0][m] < y[0][k]]
            for c in range(0, len(m), 1 << 16):
                p, q = m[c:c + (1 << 16)], k[c:c + (1 << 16)]
                near = np.einsum("ij,ij->i", x[1][p], y[1][q]) >= cosine
                out.append(np.sort(np.stack([x[0][p][near], y[0][q][near]]), axis=0))
        return pd.DataFrame(dict(zip("ab", np.concatenate(out, axis=1))))

    return dealt.groupBy("label", "i", "j").applyInPandas(pairs, "a long, b long")


def _links(units: DataFrame, d: int, n: int, cosine: float) -> DataFrame:
    """(a, b) of the pairs of ``units`` (id, label, u), n vectors of length d, that reach the cosine."""
    q = learn(units, d, n, cosine) if n > FEW else None
    if q is None or q.recall < RECALL:
        return staged(compared(units, d, cosine), "itq-links")

    @F.pandas_udf("array<long>")
    def codes(u: pd.Series) -> pd.Series:
        return pd.Series(list(q.codes(np.stack(u))) if len(u) else [], dtype=object)

    u = units.select("id", "u")
    pairs = candidates(staged(units.select("id", "label", codes("u").alias("codes")), "itq-codes"), q)
    pairs = (pairs.join(u.withColumnsRenamed({"id": "a", "u": "ua"}).hint(BY_ID), "a")
             .join(u.withColumnsRenamed({"id": "b", "u": "ub"}).hint(BY_ID), "b"))

    @F.pandas_udf("double")
    def cosines(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", np.stack(x), np.stack(y)) if len(x) else [], dtype="float64")

    return staged(pairs.where(cosines("ua", "ub") >= cosine).select("a", "b"), "itq-links")


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    sound = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
             & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
             & F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumn("u", F.when(sound, _unit("embedding"))).withColumn("sound", F.forall("u", lambda x: F.abs(x) <= 1))
    rows = rows.withColumns({"h1": F.when(F.col("sound"), F.xxhash64("embedding", "label")), "h2": F.when(F.col("sound"), F.hash("embedding"))})
    rows = staged(rows.select("vec_id", "label", F.when(F.col("sound"), F.col("u")).alias("u"), "h1", "h2"), "itq-rows")
    # equal vectors of one label are one class
    classes = staged(rows.where("u IS NOT NULL").groupBy("h1", "h2", "label").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("u").alias("u")), "itq-classes")
    links = classes.where("false").select(F.col("id").alias("a"), F.col("id").alias("b"))
    for r in classes.groupBy(F.size("u").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect():  # one row a length
        links = links.union(_links(classes.where(F.size("u") == r.d).select("id", "label", "u"), r.d, r.n, cosine))
    comp = staged(connected_components(links, by=BY_ID), "itq-comp")
    size = classes.select("id", "n").hint(BY_ID)
    both = links.where("a <> b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = (both.join(size.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "id"))
    info = (classes.select("h1", "h2", "label", "id", "n").join(degree.hint(BY_ID), "id", "left").join(comp.hint(BY_ID), "id", "left")
            .select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("label").alias("cl"),
                    (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")))
    out = rows.join(info.hint(BY_ID), (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("label") == F.col("cl")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
