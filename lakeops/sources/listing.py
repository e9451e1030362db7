"""File listings made by tasks: folders are listed level by level, each by the task that holds it.

The driver learns how many folders a level has, never a file's name. Every level is written to the shared folder before
the next one starts, so a lost executor costs one level at most.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.session import cut_lineage_counted, small_frame

_ENTRY = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("folder", pa.bool_())])
_ENTRY_DDL = "path string, size bigint, modified timestamp, folder boolean"
#: Entries in one batch that a task hands over.
BATCH = 8192


def _skipped(name: str) -> bool:
    """Names that Spark's own readers leave out: hidden files and what writers keep for themselves."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def folder_entries(folder: str, hidden: bool = False) -> Iterator[tuple[str, int, int, bool]]:
    """(path, size, modified in microseconds, is folder) of one folder; links to folders are not followed."""
    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        path = "/" + (folder.removeprefix("file:") if parts.scheme else folder).lstrip("/")
        if os.path.isfile(path):  # a root may be a file
            stat = os.stat(path)
            yield "file:" + path, stat.st_size, stat.st_mtime_ns // 1000, False
            return
        with os.scandir(path) as entries:
            for e in entries:
                if hidden or not _skipped(e.name):
                    stat = e.stat(follow_symlinks=False)
                    yield "file:" + e.path, stat.st_size, stat.st_mtime_ns // 1000, e.is_dir(follow_symlinks=False)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}{quote(parts.path)}")
    base = folder.rstrip("/")
    at = store.get_file_info(path)
    if at.is_file:
        yield folder, at.size or 0, (at.mtime_ns or 0) // 1000, False
        return
    for info in store.get_file_info(fs.FileSelector(path)):
        if hidden or not _skipped(info.base_name):
            yield f"{base}/{info.base_name}", info.size or 0, (info.mtime_ns or 0) // 1000, info.type == fs.FileType.Directory


def _lister(hidden: bool, missing_ok: bool):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = folder_entries(folder, hidden)
                try:
                    while rows := list(islice(found, BATCH)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)
                except FileNotFoundError:
                    # a folder that went away since its parent was listed holds no files
                    if not missing_ok:
                        raise

    return entries


def list_files(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """Files below ``root`` (a local path or a URI that Arrow's file systems know): file_path, size_bytes, modified.

    One round per level of folders. Entries of one folder are streamed by one task; a folder is never split, as stores
    list them in order. A missing root is an error, an empty one gives no rows.
    """
    level, files, first = small_frame(spark, [(root,)], "path string"), None, True
    while True:
        listed, folders = cut_lineage_counted(level.mapInArrow(_lister(hidden, not first), _ENTRY_DDL), "listing", F.col("folder"))
        files = listed if files is None else files.unionByName(listed)
        if not folders:
            break
        # folders of one parent spread over all tasks
        level, first = listed.where("folder").select("path").repartition("path"), False
    return files.where("not folder").select(F.col("path").alias("file_path"), F.col("size").alias("size_bytes"), "modified")
