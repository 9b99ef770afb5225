"""Reuse and lineage.

``reuse`` keeps a table that several branches of one job read (symbol
tables, resolved imports) in executor memory / local disk; if an executor
is lost its blocks are recomputed from lineage, so this is safe.
``checkpoint`` cuts lineage for iterative jobs (the SCC loop) and for
tables many later plans start from (symbol tables, resolved imports,
edges): the data goes as Parquet to the shared folder named by
``spark.checkpoint.dir`` (reliable, survives executor loss), and the plans
built on it stay small, so planning time does not grow with the lineage.
Columns take a fraction of the bytes of row blocks, nothing is kept beside
them in memory or on local disk, and a plan reads the columns it needs only.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reuse(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)
