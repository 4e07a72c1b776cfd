"""Folders that the driver and all executors see, and files in them, by Arrow's file systems."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as afs
from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir (a local one only where that is unset, as in tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/glyphmill-{uuid.uuid4().hex}"


def file_system(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path or URI (local, s3, gs, hdfs) and the path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path):
        return afs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return afs.LocalFileSystem(), path


def files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files with a suffix below a folder, by path; hidden ones left out."""
    system, where = file_system(path)
    info = system.get_file_info(where)
    if info.type == afs.FileType.File:
        return [(where, info.size)]
    found = system.get_file_info(afs.FileSelector(where, recursive=True))
    shown = [f for f in found if f.type == afs.FileType.File and f.path.endswith(suffix) and not re.search(r"/[._]", f.path[len(where) :])]
    return sorted((f.path, f.size) for f in shown)
