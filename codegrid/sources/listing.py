"""Listing of local or mounted folders by tasks, and the texts of the files they find.

Spark's file sources keep the status of every file in the driver, some kB each, and a folder of millions of small files fills it. Here
the driver opens the upper folders only as far as they hold few entries; tasks go through the rest entry by entry and give rows (path, modificationTime,
length), which are dealt out and read by other tasks. The files found are those that Spark's sources find: no hidden names, nothing
empty, links followed. Folders of other file systems, which only Spark's readers may reach, are listed by Spark as before.

A stream reads an *inventory*: the rows listed so far, as pieces of Parquet under ``spark.checkpoint.dir``, one folder per listing and one inventory
per root. A listing adds what the inventory does not hold, so a query that starts again on its checkpoint reads what has come since.
"""

from __future__ import annotations

import hashlib
import os
import re
import threading
import time
import uuid
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import ensure_checkpoint_dir

META = "path string, modificationTime timestamp, length long"
#: entries of a folder that the driver opens to find the folders in it; larger ones are left to a task as they are
FEW = 10_000
#: rows and bytes of texts that a reading task holds
ROWS, BYTES = 1000, 16 << 20
#: files of a piece of an inventory
PIECE = 500
#: seconds between looks for streams that wait for files
WAIT = 10


# ------------------------------------------------------------------ what Spark's sources find
def _no_data(name: str) -> bool:
    return (name.startswith("_") and "=" not in name) or name.startswith(".")


def _hidden(name: str) -> bool:
    return (_no_data(name) or name.endswith("._COPYING_")) and not name.startswith(("_common_metadata", "_metadata"))


def _opened(folder: str) -> Iterator[os.DirEntry]:
    """Entries of a folder, one by one; a folder that is gone by now has none, and names that are no UTF-8 are passed over."""
    try:
        found = os.scandir(folder)
    except FileNotFoundError:
        return
    with found:
        for e in found:
            if e.name.isascii() or not any("\udc80" <= c <= "\udcff" for c in e.name):
                yield e


def entries(folder: str, deep: bool, every: bool) -> Iterator[tuple[str, int, int]]:
    """(path, modification time in ms, length) of the files of a folder; ``deep`` goes into its folders, ``every`` into those of the
    first level whose names are hidden, too."""
    todo = [folder]
    while todo:
        at = todo.pop()
        for e in _opened(at):
            if e.is_dir():
                if deep and (not _hidden(e.name) or (every and at == folder)):
                    todo.append(e.path)
            elif not _hidden(e.name) and not _no_data(e.name):
                try:
                    s = e.stat()
                except FileNotFoundError:  # gone, or a link to nothing
                    continue
                if s.st_size:
                    yield "file:" + e.path, s.st_mtime_ns // 1_000_000, s.st_size


# ------------------------------------------------------------------ folders of the driver's file system
def _local(spark: SparkSession, location: str) -> str | None:
    """The path of a location in the local (or mounted) file system, None if it lies in another."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def local_folder(spark: SparkSession, location) -> str | None:
    """The path of a folder that tasks can list, None for what Spark lists itself: files, patterns, lists, other file systems."""
    if not isinstance(location, str) or re.search(r"[\[\]{}\\*?]", location):
        return None
    path = _local(spark, location)
    return path if path is not None and os.path.isdir(path) else None


def local_folders(spark: SparkSession, pattern: str) -> list[str] | None:
    """The folders that match a pattern of ``*`` and ``?``, None if they lie in another file system."""
    path = _local(spark, pattern)
    if path is None:
        return None
    found = ["/"]
    for part in path.strip("/").split("/"):
        if "*" in part or "?" in part:
            name = re.compile(re.escape(part).replace(r"\*", ".*").replace(r"\?", "."), re.S)
            found = [e.path for f in found for e in _opened(f) if name.fullmatch(e.name) and e.is_dir()]
        else:
            found = [p for f in found if os.path.isdir(p := os.path.join(f, part))]
    return found


def has_entries(folder: str) -> bool:
    return next(_opened(folder), None) is not None


# ------------------------------------------------------------------ listing
def _below(folder: str, every: bool) -> list[str] | None:
    """The folders in a folder, None if it holds more than ``FEW`` entries."""
    out = []
    for i, e in enumerate(_opened(folder)):
        if i >= FEW:
            return None
        if e.is_dir() and (every or not _hidden(e.name)):
            out.append(e.path)
    return out


def shares(folders: list[str], every: bool, want: int) -> list[tuple[str, bool, bool]]:
    """(folder, deep, every) for ``entries``: together what lies under ``folders``, in about ``want`` shares if there are as many folders."""
    todo, done = deque((f, every) for f in folders), []
    while todo and len(todo) + len(done) < want:
        folder, first = todo.popleft()
        below = _below(folder, first)
        done.append((folder, not below, first and not below))
        todo.extend((f, False) for f in below or [])
    return done + [(f, True, first) for f, first in todo]


def _list(batches):
    for b in batches:
        rows = []
        for share in zip(*(c.to_pylist() for c in b.columns)):
            for row in entries(*share):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield _listed_batch(rows)
                    rows = []
        yield _listed_batch(rows)


def _listed_batch(rows: list) -> pa.RecordBatch:
    path, ms, length = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(ms, pa.int64()), pa.array(length, pa.int64())], ["path", "ms", "length"])


def listed(spark: SparkSession, folders: list[str], tasks: int, every: bool = False) -> DataFrame:
    """(path, modificationTime, length) of the files under local folders, dealt over ``tasks``."""
    apart = spark.createDataFrame(shares(folders, every, 4 * spark.sparkContext.defaultParallelism), "folder string, deep boolean, every boolean")
    rows = apart.mapInArrow(_list, "path string, ms long, length long")
    return rows.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length").repartition(tasks, "path")


# ------------------------------------------------------------------ texts
def with_content(df: DataFrame, gone: bool = False) -> DataFrame:
    """``df`` with the bytes of the file at ``path`` in ``content``, a few MB of them at a time; ``gone``: files that are there no more give no row."""
    def read(batches):
        for b in batches:
            at, texts, size = [], [], 0
            for i, path in enumerate(b.column("path").to_pylist()):
                try:
                    with open(re.sub(r"^file:(//)?", "", path), "rb") as f:
                        texts.append(f.read())
                except FileNotFoundError:
                    if not gone:
                        raise
                    continue
                at.append(i)
                size += len(texts[-1])
                if len(at) >= ROWS or size >= BYTES:
                    yield _filled(b, at, texts)
                    at, texts, size = [], [], 0
            yield _filled(b, at, texts)
    return df.mapInArrow(read, StructType([*df.schema.fields, StructField("content", BinaryType())]))


def _filled(b: pa.RecordBatch, at: list, texts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.take(pa.array(at, pa.int64())) for c in b.columns] + [pa.array(texts, pa.binary())], [*b.schema.names, "content"])


# ------------------------------------------------------------------ inventories
_LISTING = threading.Lock()
_FOLLOWED: dict[str, dict[str, int]] = {}  # application: root, piece


def inventory(spark: SparkSession, root: str, piece: int = PIECE) -> str | None:
    """The inventory of a local root, brought up to date; None if Spark has to list the root. One driver at a time lists a root."""
    folder = local_folder(spark, root)
    if folder is None:
        return None
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/listings/{hashlib.sha256(folder.encode()).hexdigest()[:32]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tasks = spark.sparkContext.defaultParallelism
    with _LISTING:
        fs.mkdirs(path(at))
        new = listed(spark, [folder], tasks)
        if len(fs.listStatus(path(at))):  # one folder per listing
            seen = spark.read.schema(META).option("recursiveFileLookup", "true").parquet(at).select("path")
            new = new.join(seen.hint("merge"), "path", "left_anti").repartition(tasks, "path")
        draft = f"{at}-{uuid.uuid4().hex}"
        new.write.option("compression", "zstd").option("maxRecordsPerFile", piece).parquet(draft)
        if spark.read.schema(META).parquet(draft).limit(1).count():
            fs.rename(path(draft), path(f"{at}/{uuid.uuid4().hex}"))
        else:
            fs.delete(path(draft), True)
    return at


def follow(spark: SparkSession, root: str, piece: int) -> None:
    """List a root again whenever streams of this application wait for data, so that a running query sees files that come later."""
    app = spark.sparkContext.applicationId
    started, roots = app in _FOLLOWED, _FOLLOWED.setdefault(app, {})
    roots[root] = piece
    if started:
        return

    def look() -> None:
        while True:
            time.sleep(WAIT)
            try:
                if spark.sparkContext._jsc is None or spark.sparkContext.applicationId != app:
                    return
                waiting = [q for q in spark.streams.active if not q.status["isDataAvailable"] and not q.status["isTriggerActive"]]
                for r, n in list(roots.items()) if waiting else []:
                    inventory(spark, r, n)
            except Exception:  # the session has ended
                if spark.sparkContext._jsc is None:
                    return
    threading.Thread(target=look, name="codegrid-listing", daemon=True).start()
