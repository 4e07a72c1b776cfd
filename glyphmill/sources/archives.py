"""Zip archives as a data source: the central directory as a table, members dealt to tasks and inflated there."""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from glyphmill.operators.rules import Refused
from glyphmill.sources import shared

#: Compressed bytes of one partition's members; bytes read from an archive at once; bytes of members in one batch.
PARTITION_BYTES, READ, BATCH_BYTES = 64 << 20, 1 << 20, 8 << 20
DIRECTORY = "archive string, path string, file string, kind string, bytes long, compressed long, crc long, offset long, method int"
MEMBERS = "archive string, path string, file string, kind string, bytes long, sha256 string, content binary"
_HEADER = struct.Struct("<4s5H3L2H")  # fixed values: the local header of the public zip format


class Members(InputPartition):
    def __init__(self, entries: list[tuple]):
        self.entries = entries


def entries(path: str) -> Iterator[tuple]:
    """DIRECTORY rows of the archives at a path; only their central directories are read. Folders are left out."""
    system, _ = shared.file_system(path)
    for archive, _ in shared.files(path, ".zip"):
        with system.open_input_file(archive) as f:
            try:
                found = zipfile.ZipFile(f).infolist()
            except zipfile.BadZipFile as e:
                raise Refused(f"{archive}: {e}") from None
        for i in found:
            name = i.filename.replace("\\", "/")
            if i.is_dir() or name.startswith("__MACOSX/"):
                continue
            link = (i.external_attr >> 16) & 0o170000 == 0o120000
            if i.flag_bits & 1:
                raise Refused(f"{name} is encrypted")
            yield archive, name, name.rpartition("/")[2], "symlink" if link else "file", i.file_size, i.compress_size, i.CRC, i.header_offset, i.compress_type


def inflated(f, offset: int, compressed: int, method: int) -> Iterator[bytes]:
    """The bytes of the member whose local header is at an offset, piece by piece."""
    f.seek(offset)
    head = _HEADER.unpack(f.read(_HEADER.size))
    if head[0] != b"PK\x03\x04":
        raise Refused("no member where the directory has one")
    f.seek(offset + _HEADER.size + head[-2] + head[-1])
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise Refused(f"compression method {method} is not supported")
    z = zlib.decompressobj(-15) if method else None
    while compressed:
        piece = f.read(min(READ, compressed))
        if not piece:
            raise Refused("the archive ends inside a member")
        compressed -= len(piece)
        yield z.decompress(piece) if z else piece
    if z:
        yield z.flush()


class Archives(DataSource):
    """Options: path; listing (true: DIRECTORY rows only); partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return DIRECTORY if self.options.get("listing") == "true" else MEMBERS

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options, schema)


class Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.listing = options.get("listing") == "true"
        self.room = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Members]:
        """Runs of an archive's members, in the order in which they lie, of about as many compressed bytes each."""
        out, size = [], 0
        for e in sorted(entries(self.path), key=lambda e: (e[0], e[7])):
            if not out or size + e[5] > self.room or out[-1].entries[-1][0] != e[0]:
                out.append(Members([]))
                size = 0
            out[-1].entries.append(e)
            size += e[5]
        return out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(self.schema)
        if self.listing:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*partition.entries), kind.types)], schema=kind)
            return
        system, _ = shared.file_system(self.path)
        held, size = [], 0
        with system.open_input_file(partition.entries[0][0]) as f:
            for archive, path, file, what, n, compressed, crc, offset, method in partition.entries:
                sha, parts, total, check = hashlib.sha256(), [], 0, 0
                for piece in inflated(f, offset, compressed, method):
                    total, check = total + len(piece), zlib.crc32(piece, check)
                    if total > n:
                        raise Refused(f"{path} is larger than its directory entry")
                    sha.update(piece)
                    parts.append(piece)
                if total != n or check != crc:
                    raise Refused(f"{path}: size or checksum differs from the directory")
                held.append(dict(zip(kind.names, (archive, path, file, what, n, sha.hexdigest(), b"".join(parts)))))
                size += n
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, kind)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, kind)


def _source(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(Archives)
    return spark.read.format(Archives.name()).options(path=path, **options).load()


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, file, kind, bytes, compressed, crc, offset, method) of all members, none inflated."""
    return _source(spark, path, listing="true")


def members(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(archive, path, file, kind, bytes, sha256, content) of all members of an archive, or of all archives below a folder.

    One archive is read by as many tasks as its compressed bytes call for; a member is one row, checked against
    the size and checksum of the directory.
    """
    return _source(spark, path, partition_bytes=str(partition_bytes))
