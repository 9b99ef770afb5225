"""Reading source trees (S1-S3): listed by tasks (``listing``), or with the ``binaryFile`` source where only Spark reaches them.

Listing, suffix, include / exclude and size filters run on the file
metadata columns (``path``, ``length``) *before* the content column is
read or decoded, so the bytes of
oversized files are never read. Decoding is lossy UTF-8 (invalid bytes are
dropped) and never fails a task.
"""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT_MAX_FILE_MB
from ..schemas import FILE_COLUMNS
from . import listing
from .filters import excluded_by, filter_extensions, filter_paths, known_extension, not_included
from .tables import language_of, suffix_of

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


TASKS = 8  # tasks a core that read a tree


def _raw(spark: SparkSession, location) -> DataFrame:
    """The binary files under a folder; what tasks have listed comes without ``content``, which ``_files`` reads after the filters. Spark puts 32 small
    files into a task; here the tasks are some to each core, whatever the number of files."""
    folder = listing.local_folder(spark, location)
    if folder is not None:
        return listing.listed(spark, [folder], TASKS * spark.sparkContext.defaultParallelism)
    df = spark.read.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").load(location)
    return df.coalesce(TASKS * spark.sparkContext.defaultParallelism)


def _scan(spark: SparkSession, location, max_mb: float) -> DataFrame:
    # pushed into the scan: oversized files are skipped by metadata
    return _raw(spark, location).where(F.col("length") <= F.lit(int(max_mb * 1024 * 1024)))


def _scan_glob(spark: SparkSession, path: str, max_mb: float) -> DataFrame:
    """``_scan`` of a path or glob. A glob that ends in ``/*`` and else holds only ``*`` and ``?`` is read folder by folder: expanded, every
    file would be a path of its own to list, and its listing would pass the driver."""
    parent = path[:-2]
    if not path.endswith("/*") or not parent.rsplit("/", 1)[-1] or re.search(r"[\[\]{}\\,]", path):
        return _scan(spark, path, max_mb)
    local = listing.local_folders(spark, parent)
    if local is not None:
        if not any(listing.has_entries(f) for f in local):
            return _scan(spark, path, max_mb)  # raises, as the listing does
        df = listing.listed(spark, local, TASKS * spark.sparkContext.defaultParallelism, every=True)
        return df.where(F.col("length") <= F.lit(int(max_mb * 1024 * 1024)))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(parent).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.globStatus(hadoop.Path(parent)) or [] if s.isDirectory()]
    if not any(fs.listStatusIterator(f).hasNext() for f in folders):
        return _scan(spark, path, max_mb)  # raises, as the listing does
    # a recursive listing passes over hidden folders, which the glob names
    hidden = [s.getPath().toString() for p in "_." for s in fs.globStatus(hadoop.Path(f"{parent}/{p}*")) or [] if s.isDirectory()]
    depth = re.sub(r"^file:(//)?", "", parent).replace("*", "\0").replace("?", "\1")
    under = "^" + re.escape(depth).replace("\0", "[^/]*").replace("\1", "[^/]") + "/"
    return _scan(spark, [f.toString() for f in folders] + hidden, max_mb).where(_strip_scheme(F.col("path")).rlike(under))


def _strip_scheme(path):
    return F.regexp_replace(path, r"^file:(//)?", "")


def _clean_root(root: str) -> str:
    """The root as it stands in front of stripped paths."""
    return re.sub(r"^file:(//)?", "", root).rstrip("/")


def decode_utf8(content):
    """Lossy UTF-8 decode: invalid byte sequences are dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def _files(df: DataFrame, repo, relative) -> DataFrame:
    if "content" not in df.columns:
        df = listing.with_content(df, gone=df.isStreaming)
    ext = suffix_of(relative)
    return df.select(
        repo.alias("repo"),
        F.col("path"),
        relative.alias("relative_path"),
        F.element_at(F.split(relative, "/"), -1).alias("name"),
        ext.alias("ext"),
        language_of(ext).alias("language"),
        decode_utf8(F.col("content")).alias("content"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    ).select(*FILE_COLUMNS)


def _normalize_relative(rel):
    """POSIX normalisation of a relative path: ``//`` collapsed, ``./``
    segments and a trailing ``/`` dropped."""
    rel = F.regexp_replace(rel, "/{2,}", "/")
    rel = F.regexp_replace(rel, r"(^|/)\./", "$1")
    return F.regexp_replace(rel, "/$", "")


def tree_files(raw: DataFrame, root: str, repo: str | None = None,
               include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
               max_mb: float = DEFAULT_MAX_FILE_MB,
               extensions: dict[str, list[str]] | None = None) -> DataFrame:
    """The S1 transformation on a raw ``binaryFile`` frame, or one of listed files (batch or stream)."""
    root_clean = _clean_root(root)
    repo = repo or root_clean.rsplit("/", 1)[-1]
    df = raw.where(F.col("length") <= F.lit(int(max_mb * 1024 * 1024)))
    df = df.withColumn("path", _strip_scheme(F.col("path")))
    df = filter_extensions(df, extensions)
    df = filter_paths(df, include, exclude)
    rel = _normalize_relative(F.expr(f"substring(path, {len(root_clean) + 2})"))
    return _files(df, F.lit(repo), rel)


def read_source_tree(spark: SparkSession, root: str, repo: str | None = None,
                     include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
                     max_mb: float = DEFAULT_MAX_FILE_MB,
                     extensions: dict[str, list[str]] | None = None) -> DataFrame:
    """Every regular file under ``root`` whose suffix is configured,
    included, not excluded and not oversized, as a ``files`` table."""
    root_clean = _clean_root(root)
    repo = repo or root_clean.rsplit("/", 1)[-1]
    df = _scan(spark, root_clean, max_mb)
    df = df.withColumn("path", _strip_scheme(F.col("path")))
    df = filter_extensions(df, extensions)
    df = filter_paths(df, include, exclude)
    rel = _normalize_relative(F.expr(f"substring(path, {len(root_clean) + 2})"))
    return _files(df, F.lit(repo), rel)


def rejected_files(spark: SparkSession, root: str, repo: str | None = None,
                   include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
                   max_mb: float = DEFAULT_MAX_FILE_MB,
                   extensions: dict[str, list[str]] | None = None, probe: bool = False) -> DataFrame:
    """(repo, path, relative_path, size_bytes, modified_at, reason): the files under ``root`` that ``read_source_tree`` with the same
    arguments gives no row for, with the first reason that holds: ``extension``, ``not included``, ``excluded``, ``oversized``. The scan
    reads file metadata only. With ``probe`` the other files are read once with unreadable ones skipped, and those that came back without
    content are rows of the reason ``unreadable``. Together with the rows read, every file that is not empty is accounted for once; Spark's
    file sources list no files of zero bytes, so these are in neither."""
    root_clean = _clean_root(root)
    meta = (_raw(spark, root_clean)
            .select(_strip_scheme(F.col("path")).alias("path"), "modificationTime", "length"))
    path = F.col("path")
    reason = (F.when(~known_extension(path, extensions), "extension").when(not_included(path, include), "not included")
              .when(excluded_by(path, exclude), "excluded").when(F.col("length") > F.lit(int(max_mb * 1024 * 1024)), "oversized"))
    rel = _normalize_relative(F.expr(f"substring(path, {len(root_clean) + 2})"))
    judged = meta.select(F.lit(repo or root_clean.rsplit("/", 1)[-1]).alias("repo"), "path", rel.alias("relative_path"),
                         F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), reason.alias("reason"))
    out = judged.where("reason IS NOT NULL")
    if not probe:
        return out
    read = (spark.read.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true")
            .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root_clean)
            .where((F.col("length") <= F.lit(int(max_mb * 1024 * 1024))) & F.col("content").isNotNull())
            .select(_strip_scheme(F.col("path")).alias("path")))
    lost = judged.where("reason IS NULL").join(read, "path", "left_anti").withColumn("reason", F.lit("unreadable"))
    return out.unionByName(lost)


def read_single_file(spark: SparkSession, path: str, include: Sequence[str] | None = None,
                     exclude: Sequence[str] | None = None,
                     max_mb: float = DEFAULT_MAX_FILE_MB) -> DataFrame:
    """One file (or a glob of files) read without the suffix test;
    excluded, not included or oversized files give no row. A missing path
    raises, as listing does."""
    df = _scan_glob(spark, path, max_mb).withColumn("path", _strip_scheme(F.col("path")))
    df = filter_paths(df, include, exclude)
    name = F.element_at(F.split("path", "/"), -1)
    # a single file has no relative path of its own: its name is used
    return _files(df, F.lit("single"), name).withColumn("relative_path", F.col("path"))


def read_repo_snapshots(spark: SparkSession, root: str, with_branch: bool = True,
                        include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
                        max_mb: float = DEFAULT_MAX_FILE_MB) -> DataFrame:
    """S3: checked-out repositories laid out as ``root/<repo>/<branch>/...``
    (or ``root/<repo>/...``); ``repo`` and ``branch`` come from the path."""
    root_clean = _clean_root(root)
    df = _scan(spark, root_clean, max_mb).withColumn("path", _strip_scheme(F.col("path")))
    df = filter_extensions(df)
    df = filter_paths(df, include, exclude)
    under = F.expr(f"substring(path, {len(root_clean) + 2})")
    depth = 2 if with_branch else 1
    parts = F.split(under, "/", depth + 1)
    out = _files(df.withColumn("_parts", parts), F.col("_parts")[0],
                 _normalize_relative(F.element_at(F.col("_parts"), depth + 1)))
    if with_branch:
        out = out.withColumn("branch", F.split(F.expr(f"substring(path, {len(root_clean) + 2})"), "/")[1])
    return out


def write_corpus(files: DataFrame, root: str) -> None:
    """Write each file row to ``root/<repo>/<relative_path>`` from the
    executors (pyarrow file system from the URI, so the shared checkpoint
    folder may be any file system pyarrow reaches)."""
    import pandas as pd

    def writer(batches):
        from pyarrow import fs
        filesystem, base = fs.FileSystem.from_uri(root)
        made = set()
        for b in batches:
            n = 0
            for repo, rel, content in zip(b["repo"], b["relative_path"], b["content"]):
                target = f"{base}/{repo}/{rel}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    filesystem.create_dir(parent, recursive=True)
                    made.add(parent)
                with filesystem.open_output_stream(target) as out:
                    out.write(content.encode("utf-8"))
                n += 1
            yield pd.DataFrame({"written": [n]})

    total = (files.select("repo", "relative_path", "content")
             .mapInPandas(writer, "written long").agg(F.sum("written")).collect()[0][0])
    if total is None:
        total = 0
    return total
