"""Helpers shared by the operators: table access, staging in the shared folder, hashing of words, graph components."""

from __future__ import annotations

import ctypes
import functools
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codegrid.session import ensure_checkpoint_dir

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: lineage ends there, every executor
    sees the files, and a lost executor costs nothing that was staged."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of what has just been written: it does so when their driver objects are
    collected, which a driver with little to do would leave for half an hour."""
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key`` under the shared checkpoint folder: joins on the key read it in place."""
    spark = df.sparkSession
    table_name = f"llm_{name}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{table_name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table_name, format="parquet")
    _release(spark)
    out = spark.table(table_name)
    out._staged_at = path
    return out


def partitions(spark: SparkSession, *, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand. With them the polynomial hash of any
    slice is one difference of prefix sums and one product."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, b, U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


POWERS = Powers()
# fixed values: ASCII letters to lower case; white space is 0x20 and 0x09-0x0D
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums C with C[j] - C[i] = sum of (byte + 1) * base**k over i <= k < j (modulo 2**64)."""
    up, _ = POWERS.get(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[:len(buf)], out=out[1:])
    return out


def slice_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each slice; equal bytes give equal values wherever they stand."""
    _, down = POWERS.get(len(c))
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(U64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in a row, and for each text the offset of its first word
    (one offset more at the end)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    space = _IS_SPACE[buf]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(space & ~before)
    limits = np.cumsum([0] + [len(r) + 1 for r in raw])
    return slice_hash(prefix_hash(buf), start, end), np.searchsorted(start, limits)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; fewer words than ``width`` make one shingle, no words
    none."""
    words, off = word_hashes(texts)
    k = [U64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(width)]
    n = len(words) - width + 1
    whole = np.zeros(0, U64)
    if n > 0:
        whole = words[:n] * k[0]
        for i in range(1, width):
            whole = whole + words[i:i + n] * k[i]
        whole = mix(whole)
    out = []
    for a, b in zip(off[:-1], off[1:]):
        if b - a >= width:
            out.append(np.unique(whole[a:b - width + 1]))
        elif b > a:
            out.append(mix(np.sum(words[a:b] * np.array(k[:b - a], U64), keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def batches(rows, size: int):
    """Cut the pandas frames of a map task further, so that one call handles at most about ``size`` characters."""
    for pdf in rows:
        if not len(pdf):
            continue
        n = pdf["text"].str.len().fillna(0).to_numpy()
        cut = (np.cumsum(n) // size).astype(int)
        for _, part in pdf.groupby(cut, sort=True):
            yield part


def lean(task):
    """A map task over frames that gives freed memory back to the system when it ends. Spark reuses Python workers: what one keeps of
    an operator's arrays stands beside the executor's heap through all later stages."""
    @functools.wraps(task)
    def run(frames):
        try:
            yield from task(frames)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
            if trim:
                trim(0)
    return run


# ------------------------------------------------------------- components

def connected_components(edges: DataFrame, name: str = "cc", by: str | None = None) -> DataFrame:
    """Components of an undirected graph given as (a, b); returns (id, component) with the smallest id of each
    component, for every id that has an edge.

    Large-star and small-star steps alternate until the edges form stars, O(log^2) rounds whatever the diameter. A hub
    is only ever the key of an aggregation with map-side partial results or of a join whose skewed side AQE splits; the
    driver sees two numbers a round. ``by`` is a join hint for tables that may be as large as the graph: one that AQE finds
    just small enough to be sent whole passes the driver.
    """
    def hinted(df: DataFrame) -> DataFrame:
        return df.hint(by) if by else df
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .where("u <> v").distinct(), name)
    state = _fingerprint(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(hinted(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(hinted(low2), "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
        e = staged(pairs.select("p.*").where("u <> v").distinct(), name)
        now = _fingerprint(e)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _fingerprint(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def binomial_tail(n: int, p: float, d: int) -> float:
    """P(more than d of n)."""
    return sum(math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(d + 1, n + 1))
