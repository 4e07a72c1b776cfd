"""Parquet row groups as a data source: one partition each, footers read once, digests kept while rows stream."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from glyphmill.operators.rules import Refused
from glyphmill.sources import shared

#: Rows of a batch, and footers that are read at a time.
BATCH, READERS = 512, 16
#: Columns that the source adds: the file below the path, the number of the row group in it, the row's place in the group.
ADDED = T.StructType([T.StructField("file", T.StringType()), T.StructField("row_group", T.IntegerType()), T.StructField("pos", T.LongType())])
#: What the digests of groups are given as.
DIGESTS = T.StructType([*ADDED.fields[:2], T.StructField("n_rows", T.LongType()), T.StructField("total_bytes", T.LongType()), T.StructField("digest", T.StringType())])


class Group(InputPartition):
    def __init__(self, path: str, file: str, group: int):
        self.path, self.file, self.group = path, file, group


class RowGroups(DataSource):
    """Options: path; columns (comma-separated, all by default); groups (numbers to read); digest (comma-separated columns
    whose bytes are hashed row by row); pins (JSON of "file:group" to [SHA-256, bytes]); only_digests."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> T.StructType:
        if self.options.get("only_digests") == "true":
            return DIGESTS
        found = shared.files(self.options["path"], ".parquet")
        if not found:
            raise Refused(f"no Parquet file below {self.options['path']}")
        system, _ = shared.file_system(self.options["path"])
        own = from_arrow_schema(pq.read_schema(found[0][0], filesystem=system))
        if wanted := self.options.get("columns"):
            own = T.StructType([own[c] for c in wanted.split(",")])
        return T.StructType([*own.fields, *ADDED.fields])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options, schema)


def value(x: pa.Scalar) -> bytes:
    """A text's or binary's bytes; of a struct those of its field `bytes`; nulls have none."""
    x = x.as_py()
    x = x.get("bytes") if isinstance(x, dict) else x
    return x if isinstance(x, bytes) else (x or "").encode()


class Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.only = options.get("only_digests") == "true"
        self.hashed = [c for c in options.get("digest", "").split(",") if c]
        self.pins = json.loads(options.get("pins", "{}"))
        self.groups = {int(g) for g in options["groups"].split(",") if g} if "groups" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Groups asked for by number are the only ones planned; all other filters go back to Spark."""
        for f in filters:
            if isinstance(f, (In, EqualTo)) and f.attribute == ("row_group",):
                asked = {int(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                self.groups = asked if self.groups is None else self.groups & asked
            else:
                yield f

    def partitions(self) -> list[Group]:
        """The row groups to read, from each file's footer, read once."""
        system, top = shared.file_system(self.path)
        found = [p for p, _ in shared.files(self.path, ".parquet")]
        with ThreadPoolExecutor(READERS) as pool:
            counts = list(pool.map(lambda p: pq.read_metadata(p, filesystem=system).num_row_groups, found))
        if self.groups is not None and (unknown := self.groups - set(range(max(counts, default=0)))):
            raise Refused(f"unknown row groups: {sorted(unknown)}")
        name = lambda p: p[len(top) :].lstrip("/") or p.rpartition("/")[2]
        return [Group(p, name(p), g) for p, n in zip(found, counts) for g in range(n) if self.groups is None or g in self.groups]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, _ = shared.file_system(self.path)
        own = [f.name for f in self.schema.fields if f.name not in ADDED.names]
        columns = list(dict.fromkeys([*([] if self.only else own), *self.hashed]))
        sha, size, rows = hashlib.sha256(), 0, 0
        kind = to_arrow_schema(self.schema)
        with system.open_input_file(partition.path) as f:
            for b in pq.ParquetFile(f).iter_batches(BATCH, row_groups=[partition.group], columns=columns):
                for cells in zip(*(b.column(c) for c in self.hashed)):
                    for cell in cells:
                        x = value(cell)
                        sha.update(x)
                        size += len(x)
                if not self.only:
                    n = b.num_rows
                    added = [pa.array([partition.file] * n), pa.array([partition.group] * n, pa.int32()), pa.array(range(rows, rows + n), pa.int64())]
                    table = pa.Table.from_arrays([*(b.column(c) for c in own), *added], names=kind.names)
                    yield from table.cast(kind).to_batches()
                rows += b.num_rows
        pin = self.pins.get(f"{partition.file}:{partition.group}")
        if self.pins and pin != [sha.hexdigest(), size]:
            raise Refused(f"{partition.file} row group {partition.group}: digest or bytes differ from the pin")
        if self.only:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (partition.file, partition.group, rows, size, sha.hexdigest())))], kind)


def _source(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(RowGroups)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(RowGroups.name()).options(path=path, **options).load()


def digests(spark: SparkSession, path: str, columns: Sequence[str], groups: Sequence[int] | None = None) -> DataFrame:
    """(file, row_group, n_rows, total_bytes, digest) of the row groups: SHA-256 over the columns' bytes, row after row.

    A group is one task, which holds a batch of it; groups not asked for are not read.
    """
    asked = {} if groups is None else {"groups": ",".join(map(str, groups))}
    return _source(spark, path, digest=",".join(columns), only_digests="true", **asked)


def read(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, pins: Mapping[tuple[str, int], tuple[str, int]] | None = None, digest: Sequence[str] = ("image", "text"), groups: Sequence[int] | None = None
) -> DataFrame:
    """Rows with file, row_group and pos of the groups asked for; a filter on row_group plans only those groups.

    With pins (by file and group: SHA-256 and byte total of the `digest` columns) every group read is hashed as
    its rows pass, and one that differs, or has no pin, ends the job: nothing of it reaches a finished result.
    """
    options = {} if columns is None else {"columns": ",".join(columns)}
    if groups is not None:
        options["groups"] = ",".join(map(str, groups))
    if pins is not None:
        options |= {"pins": json.dumps({f"{f}:{g}": list(p) for (f, g), p in pins.items()}), "digest": ",".join(digest)}
    return _source(spark, path, **options)


def write(df: DataFrame, path: str, rows: int) -> None:
    """df as Parquet whose row groups have `rows` rows each (a file's last one fewer)."""
    df.write.option("parquet.block.row.count.limit", rows).parquet(path)
