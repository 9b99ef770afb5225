"""Fixed schemas of the tables every operator exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# One row per source file. ``relative_path`` is the key inside ``repo``;
# it is also the order key wherever "first" / "last wins" matters
# (files are ordered by relative_path within a repo).
FILES_SCHEMA = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("relative_path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("modified_at", T.TimestampType()),
])

FILE_COLUMNS = [f.name for f in FILES_SCHEMA.fields]


def require_files(df: DataFrame) -> DataFrame:
    """Check a user-supplied DataFrame has the ``files`` columns."""
    missing = [c for c in FILE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"files table lacks columns: {missing}")
    return df.select(*FILE_COLUMNS)
