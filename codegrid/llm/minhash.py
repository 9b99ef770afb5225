"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming join, links confirmed on full sets.

A signature has ``K`` components of 16 bits. Two sets of Jaccard similarity ``s`` differ in a binomial(K, 1 - s) number
of components, so a signature distance of ``radius()`` keeps every pair at the threshold but for a chance below
``MISS``. The join finds *all* pairs within that distance d: the components are cut into (d + 1) / 2 chunks, rounded
up; by the pigeonhole principle a pair within the radius has a chunk with at most one differing component, and each
document is entered under every chunk with each single component left out (the allowed errors enumerated), so such a
pair meets under an equal key.

Work for copies stays linear. Documents of equal sets are one class. Within a key, members are compared with the
smallest one (each with that of the key it shares most with); what these stars link is one component, and only members of
*different* components under a key are then paired, each pair under the first key it shares only, filtered by size, by parities
and by the distance of a longer signature of one-bit components (both made for these members alone) and confirmed, so no link
between different texts is lost. The parities bound the shingles in which two sets differ from below, so they drop no link;
for sets of up to about ``FULL`` shingles they leave little but pairs at the threshold, where the longer signature would let
through most of a group whose texts lie a little below it. Larger sets are left to the longer signature.

Nulls and texts without words have an empty set: 0 shingles, own component. A null doc_id counts as no row of the
graph: it keeps its own row with a null component and is kept. Repeated rows of a doc_id are one document if their
texts agree; if not, each text links under the same doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codegrid.llm.common import U64, batches, binomial_tail, bucketed, connected_components, drop, lean, mix, partitions, shingle_sets, staged

K = 64  # components that the index is made of
FULL = 1024  # one-bit components of the longer signature, which filters the last pairs
MISS = 1e-6
_SEED = np.random.default_rng(20240607)
_MUL = _SEED.integers(0, 1 << 63, FULL, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _SEED.integers(0, 1 << 63, FULL, dtype=np.uint64)
LANES = [f"s{i}" for i in range(K // 4)]
BITS = [f"w{i}" for i in range(FULL // 64)]
PARITIES = [f"x{i}" for i in range(FULL // 64)]
_PER_TASK = 2000


def radius(percent: int, k: int = K, differ: float = 1.0) -> int:
    """Smallest distance of k components that a pair at the threshold exceeds with a chance of at most MISS; ``differ`` is the chance that
    components of different shingles differ (one half for one-bit components)."""
    return next(d for d in range(k) if binomial_tail(k, differ * (1 - percent / 100), d) <= MISS)


def key_plan(distance: int) -> list[list[int]]:
    """The components that make each key: every chunk with each single component left out."""
    bounds = np.linspace(0, K, (distance + 2) // 2 + 1).round().astype(int)
    return [[i for i in range(a, b) if i != out] for a, b in zip(bounds[:-1], bounds[1:]) for out in range(a, b)]


def signature(shingles: np.ndarray, k: int = K) -> np.ndarray:
    low = np.full(k, np.iinfo(np.uint64).max, U64)
    for i in range(0, len(shingles), 256):
        h = shingles[i:i + 256][None, :] * _MUL[:k, None] + _ADD[:k, None]
        h ^= h >> U64(31)
        h *= U64(0x94D049BB133111EB)
        np.minimum(low, h.min(axis=1), out=low)
    return (mix(low) & U64(0xFFFF)).astype(np.uint16)


def parities(shingles: np.ndarray) -> np.ndarray:
    """``FULL`` bits, each the parity of the shingles that fall to it. The bits in which two sets differ are the parities of their symmetric
    difference, so they are never more than the shingles in which the sets differ."""
    return (np.bincount((shingles % U64(FULL)).astype(np.int64), minlength=FULL) & 1).astype(np.uint8)


def index_keys(sigs: np.ndarray, plan: list[list[int]]) -> np.ndarray:
    """The keys of each signature, one row per document."""
    s = sigs.astype(U64)
    out = np.empty((len(s), len(plan)), U64)
    for j, kept in enumerate(plan):
        packed = np.full(len(s), 1, U64)
        for i in kept:
            packed = packed * U64(65537) + s[:, i]
        out[:, j] = mix(packed + U64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64)))
    return out.view(np.int64)


def _signatures(width: int):
    @lean
    def run(frames):
        for pdf in batches(frames, 500_000):
            sets = shingle_sets(pdf["text"].tolist(), width)
            yield pd.DataFrame({
                "id": pdf["id"], "no_id": pdf["no_id"], "n_shingles": [len(s) for s in sets],
                "h1": np.array([int(s.sum(dtype=U64)) if len(s) else 0 for s in sets], U64).view(np.int64),
                "h2": np.array([int(np.bitwise_xor.reduce(mix(s + U64(7)))) if len(s) else 0 for s in sets], U64).view(np.int64),
                "sig": [signature(s).tobytes() if len(s) else None for s in sets]})
    return run


def _long_signatures(width: int):
    """The components of the index, four in a long, the lowest bits of the longer signature and the parities, 64 in a long."""
    @lean
    def run(frames):
        for pdf in batches(frames, 500_000):
            sets = shingle_sets(pdf["text"].tolist(), width)
            sigs = np.array([signature(s, FULL) for s in sets])
            lanes = np.ascontiguousarray(sigs[:, :K]).astype("<u2").view("<i8")
            bits = np.packbits((sigs & 1).astype(np.uint8), axis=1, bitorder="little").view("<i8")
            odd = np.packbits(np.array([parities(s) for s in sets]), axis=1, bitorder="little").view("<i8")
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "n_shingles": [len(s) for s in sets],
                                **{c: lanes[:, i] for i, c in enumerate(LANES)}, **{c: bits[:, i] for i, c in enumerate(BITS)},
                                **{c: odd[:, i] for i, c in enumerate(PARITIES)}})
    return run


def _entries(plan: list[list[int]]):
    @lean
    def run(frames):
        for pdf in frames:
            if len(pdf):
                keys = index_keys(np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, K), plan)
                yield pd.DataFrame({"key": keys.ravel(), "j": np.tile(np.arange(len(plan), dtype=np.int16), len(pdf)),
                                    "id": np.repeat(pdf["id"].to_numpy(), keys.shape[1])})
    return run


def _bit_distance(a: str, b: str, columns: list[str]):
    """Bits of the columns that differ, computed in the join."""
    total = F.lit(0)
    for c in columns:
        total = total + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return total


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _first_shared(a: str, b: str, plan: list[list[int]]):
    """Whether no key before ``a.j`` is shared: a pair meets under every key it shares and is taken under the first. Component 4 i + l
    is bit 16 l + i of the differing ones, a key is shared if none of its components differs."""
    differing = F.lit(0).cast("long")
    for i, c in enumerate(LANES):
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        for step in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differing = differing.bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(0x0001000100010001)), i))
    masks = F.array(*[F.lit(_signed(sum(1 << (16 * (k % 4) + k // 4) for k in kept))).cast("long") for kept in plan])
    earlier = F.slice(masks, F.lit(1), F.col(f"{a}.j").cast("int"))
    # the array of one value binds it, so that it is computed once for all keys
    return ~F.exists(F.array(differing), lambda d: F.exists(earlier, lambda m: d.bitwiseAND(m) == 0))


def _best(pairs: DataFrame) -> DataFrame:
    """For each a the b with which it shares most keys."""
    return (pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("a").agg(F.max(F.struct("n", -F.col("b"))).alias("m"))
            .select("a", (-F.col("m.col2")).alias("b")))


def _set_blobs(width: int):
    @lean
    def run(frames):
        for pdf in batches(frames, 500_000):
            yield pd.DataFrame({"id": pdf["id"], "blob": [s.tobytes() for s in shingle_sets(pdf["text"].tolist(), width)]})
    return run


def _compare(percent: int):
    @lean
    def run(frames):
        hub, base = None, None
        for pdf in frames:
            linked_a, linked_b = [], []
            for b, a, member, blob in zip(pdf["b"], pdf["a"], pdf["member"], pdf["blob"]):
                if not member:
                    hub, base = b, np.frombuffer(blob, U64)
                elif b == hub:
                    other = np.frombuffer(blob, U64)
                    lo, hi = sorted((len(base), len(other)))
                    if 100 * lo < percent * hi:
                        continue
                    at = np.searchsorted(base, other)
                    both = int((base[np.minimum(at, len(base) - 1)] == other).sum())
                    if 100 * both >= percent * (len(base) + len(other) - both):
                        linked_a.append(int(a))
                        linked_b.append(int(b))
            yield pd.DataFrame({"a": np.array(linked_a, np.int64), "b": np.array(linked_b, np.int64)})
    return run


def confirmed(pairs: DataFrame, reps: DataFrame, width: int, percent: int, known: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold, after those known. Each b's set is sent once per ``_PER_TASK`` of its
    partners, so a hub with many partners is dealt over many tasks."""
    pairs = staged(pairs.select("a", "b").distinct(), "mh-pairs")
    need = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = staged(reps.join(need, "id").select("id", "text").mapInPandas(_set_blobs(width), "id long, blob binary"), "mh-sets")
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / _PER_TASK).cast("int").alias("salts"))
    members = (pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
               .join(sets.withColumnRenamed("id", "a"), "a").select("b", "salt", "a", F.lit(True).alias("member"), "blob"))
    hubs = (salts.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
            .join(sets.withColumnRenamed("id", "b"), "b").select("b", "salt", F.lit(0).cast("long").alias("a"), F.lit(False).alias("member"), "blob"))
    links = (members.union(hubs).repartition("b", "salt").sortWithinPartitions("b", "salt", "member")
             .mapInPandas(_compare(percent), "a long, b long"))
    links = staged(links if known is None else known.union(links), "mh-links")
    drop(pairs, sets)
    return links


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    limit = radius(percent)
    parts = partitions(docs.sparkSession)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"),
                      F.col("text").cast("string").alias("text"))
    # kept by id, so that no confirmation moves the texts again
    src = bucketed(src.repartition(parts, F.col("id")), "id", parts, "mh_texts")
    sigs = staged(src.mapInPandas(_signatures(width), "id long, no_id boolean, n_shingles long, h1 long, h2 long, sig binary"), "mh-sigs")
    real = sigs.where("sig IS NOT NULL AND NOT no_id")
    # one class per distinct set; its smallest id stands for it
    rep = staged(real.groupBy("h1", "h2", "n_shingles").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "mh-reps")
    texts = src.where("NOT no_id")
    plan = key_plan(limit)
    entries = rep.select("id", "sig").repartition(parts).mapInPandas(_entries(plan), "key long, j short, id long")
    groups = entries.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b")
    # only keys with company go on
    shared = staged(entries.join(groups, "key").select("key", "j", "id", "b"), "mh-shared")
    links = confirmed(_best(shared.where("id <> b").select(F.col("id").alias("a"), "b")), texts, width, percent)
    comp = staged(connected_components(links), "mh-comp")
    # once more among members of different components under one key, with the first and with the last of them
    open_ = shared.select("key", "j", "id")
    for end in (F.min, F.max):
        open_ = open_.select("key", "j", "id").join(comp, "id", "left").select("key", "j", "id", F.coalesce("component", "id").alias("c"))
        mixed = open_.groupBy("key").agg(end(F.struct("c", "id")).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
        open_ = staged(open_.join(mixed.select("key", "m"), "key").select("key", "j", "id", "c", "m"), "mh-open")
        again = _best(open_.where("c <> m.c").select(F.col("id").alias("a"), F.col("m.id").alias("b")))
        links = confirmed(again, texts, width, percent, links)
        comp = staged(connected_components(links), "mh-comp")
    # what is still apart: every pair under a key that its sizes, its parities and its longer signature let through
    step = math.log(100 / percent)
    x = open_.select("key", "j", "id").join(comp, "id", "left").select("key", "j", "id", F.coalesce("component", "id").alias("c"))
    mixed = x.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    x_keys = staged(x.join(mixed, "key", "left_semi"), "mh-apart")
    need = x_keys.select("id").distinct()
    long_ = staged(texts.join(need, "id", "left_semi").select("id", "text").mapInPandas(
        _long_signatures(width), "id long, n_shingles long, " + ", ".join(f"{c} long" for c in (*LANES, *BITS, *PARITIES))).distinct(), "mh-long")
    x = x_keys.join(long_, "id").withColumn("size", F.floor(F.log("n_shingles") / step))
    # the sizes of a pair are at most one class apart
    p = x.alias("p")
    q = x.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).alias("q")
    near = ((F.col("p.key") == F.col("q.key")) & (F.col("p.size") == F.col("q.size")) & (F.col("p.c") < F.col("q.c"))
            & (100 * F.least("p.n_shingles", "q.n_shingles") >= percent * F.greatest("p.n_shingles", "q.n_shingles"))
            # sets of n shingles in all that differ in d reach the threshold if 100 * (n - d) >= percent * (n + d)
            & ((100 + percent) * _bit_distance("p", "q", PARITIES) <= (100 - percent) * (F.col("p.n_shingles") + F.col("q.n_shingles")))
            & (_bit_distance("p", "q", BITS) <= radius(percent, FULL, 0.5)) & _first_shared("p", "q", plan))
    pairs = p.join(q, near).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    links = confirmed(pairs, texts, width, percent, links)
    comp = staged(connected_components(links), "mh-comp")
    drop(src, shared, open_, x_keys, long_, links)
    classes = (rep.join(comp, "id", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "id").alias("component_id")))
    out = sigs.join(classes, ["h1", "h2", "n_shingles"], "left")
    doc_id = F.when(~F.col("no_id"), F.col("id"))
    own = F.when(F.col("no_id"), F.lit(None)).when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(doc_id.alias("doc_id"), "n_shingles", own.cast("long").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
