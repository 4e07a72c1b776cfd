"""Files of one export, written by tasks and committed as one: parts, their digests, then the manifest that makes them valid."""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from glyphmill.operators.rules import Refused
from glyphmill.sources import shared

MANIFEST = "manifest.json"
FILES = "path string, bytes long, sha256 string, rows long"


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class Part:
    """One file of an export as it is written: raw contents one after the other, or members of an archive."""

    def __init__(self, system: afs.FileSystem, staged: str, name: str):
        self.system, self.staged, self.name, self.rows = system, staged, name, 0
        self.path = f"{staged}/{uuid.uuid4().hex}"
        self.out = system.open_output_stream(self.path)
        self.sha, self.size = hashlib.sha256(), 0
        self.zip = zipfile.ZipFile(self, "w", zipfile.ZIP_DEFLATED) if name.endswith(".zip") else None

    def write(self, data: bytes) -> int:
        self.sha.update(data)
        self.size += len(data)
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass

    def add(self, member: str | None, content: bytes) -> None:
        self.rows += 1
        if self.zip:
            self.zip.writestr(zipfile.ZipInfo(member or str(self.rows)), content, zipfile.ZIP_DEFLATED)
        else:
            self.write(content)

    def close(self) -> dict:
        if self.zip:
            self.zip.close()
        self.out.close()
        return {"staged": self.path, "path": self.name, "bytes": self.size, "sha256": self.sha.hexdigest(), "rows": self.rows}


class Bundle(DataSource):
    """A sink for rows (name, member, content) whose names lie together and in order in their partition.

    Options: path; fresh (JSON of bundle path to the digest its manifest must still have at commit).
    """

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        if schema.names != ["name", "member", "content"]:
            raise Refused(f"a bundle has the columns name, member and content, not {schema.names}")
        return Writer(self.options, overwrite)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.fresh = json.loads(options.get("fresh", "{}"))
        system, top = shared.file_system(self.path)
        if not overwrite and system.get_file_info(f"{top}/{MANIFEST}").type != afs.FileType.NotFound:
            raise Refused(f"{self.path} is written already")
        self.top, self.staged = top, f"{top}/_staged-{uuid.uuid4().hex}"
        system.create_dir(self.staged, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A task's files, staged; what a failed attempt leaves there goes with the staging folder."""
        system, _ = shared.file_system(self.path)
        done, part = [], None
        for b in iterator:
            for name, member, content in zip(*(c.to_pylist() for c in b.columns)):
                if part is None or part.name != name:
                    if part:
                        done.append(part.close())
                    if not name or name.startswith(("/", "_")) or ".." in name.split("/") or name == MANIFEST:
                        raise Refused(f"unsafe file name {name!r}")
                    part = Part(system, self.staged, name)
                part.add(member, content or b"")
        if part:
            done.append(part.close())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """Move all parts to their names, then write the manifest; inputs that changed meanwhile refuse the export."""
        system, _ = shared.file_system(self.path)
        for path, digest in self.fresh.items():
            if manifest_digest(path) != digest:
                self.abort(messages)
                raise Refused(f"{path} changed after it was read")
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["path"])
        if twice := [a["path"] for a, b in zip(files, files[1:]) if a["path"] == b["path"]]:
            self.abort(messages)
            raise Refused(f"{twice[0]} comes from two tasks")
        if self.overwrite:
            for f in read_manifest(self.path):
                if system.get_file_info(f"{self.top}/{f['path']}").type == afs.FileType.File:
                    system.delete_file(f"{self.top}/{f['path']}")
        for f in files:
            to = f"{self.top}/{f['path']}"
            system.create_dir(to.rpartition("/")[0], recursive=True)
            system.move(f.pop("staged"), to)
        with system.open_output_stream(f"{self.top}/{MANIFEST}") as out:
            out.write("".join(json.dumps(f, sort_keys=True) + "\n" for f in files).encode())
        system.delete_dir(self.staged)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of a failed export stays but a folder without a manifest, and none if it is new."""
        system, _ = shared.file_system(self.path)
        if system.get_file_info(self.staged).type == afs.FileType.Directory:
            system.delete_dir(self.staged)
        if not system.get_file_info(afs.FileSelector(self.top)):
            system.delete_dir(self.top)


def read_manifest(path: str) -> list[dict]:
    """The files of a committed export; an export without a manifest has none."""
    system, top = shared.file_system(path)
    if system.get_file_info(f"{top}/{MANIFEST}").type == afs.FileType.NotFound:
        return []
    with system.open_input_file(f"{top}/{MANIFEST}") as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def manifest_digest(path: str) -> str:
    """What names the whole content of an export."""
    return hashlib.sha256(json.dumps(read_manifest(path), sort_keys=True).encode()).hexdigest()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, rows) of the files of a committed export."""
    return spark.read.schema(FILES).json(f"{path.rstrip('/')}/{MANIFEST}")


def csv_lines(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """(pos, content): a table as lines of CSV in the given order of its rows, its header first; True and False for booleans."""
    kinds = dict(df.dtypes)
    cells = [F.initcap(F.col(c).cast("string")) if kinds[c] == "boolean" else F.col(c) for c in df.columns]
    line = F.to_csv(F.struct(*(x.alias(c) for x, c in zip(cells, df.columns))), {"escape": '"', "emptyValue": ""})
    head = df.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(",".join(df.columns)).alias("line"))
    rows = df.select(F.lit(1).alias("kind"), F.to_json(F.struct(*order)).alias("key"), line.alias("line"))
    return head.unionByName(rows).select(F.struct("kind", "key").alias("pos"), F.encode(F.concat("line", F.lit("\n")), "UTF-8").alias("content"))


def write(rows: DataFrame, path: str, order: str = "pos", overwrite: bool = False, fresh: Mapping[str, str] | None = None) -> None:
    """rows (name, content; member in archives) as files below a new folder, all in one job with one commit.

    A name is a file, its contents in the given order; one whose end is .zip is an archive. A file is written by
    one task as its rows stream, so a large table has several names. If any task fails, or an input of
    `fresh` (bundle and its digest) has changed at the end, nothing stays.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Bundle)
    member = F.col("member") if "member" in rows.columns else F.lit(None).cast("string")
    parts = rows.repartition("name").sortWithinPartitions("name", order)
    parts = parts.select("name", member.alias("member"), F.col("content").cast("binary").alias("content"))
    sink = parts.write.format(Bundle.name()).option("path", path).option("fresh", json.dumps(dict(fresh or {})))
    sink.mode("overwrite" if overwrite else "append").save()
