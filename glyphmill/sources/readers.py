"""Readers with contracts: pinned corpora, own data with transcripts, manifests, stage states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators.curate import group_digest, sample_split
from glyphmill.operators.rules import Refused
from glyphmill.sources import archives, rowgroups

# What own data may consist of.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
TRANSCRIPTS = "transcripts.csv"
MAX_IMAGES, MAX_BYTES = 500, 1_000_000_000


def read_groups(spark: SparkSession, path: str, pins: Mapping[int, tuple[str, int]], groups: Sequence[int] | None = None) -> DataFrame:
    """The row groups of a corpus stored by group (column row_group, pos, image.bytes, text), after their check.

    pins has each group's SHA-256 and byte total; an unknown group, a missing or a differing one
    is refused before anything is returned. The group filter prunes partitions of the scan.
    """
    wanted = sorted(pins) if groups is None else list(groups)
    if unknown := [g for g in wanted if g not in pins]:
        raise Refused(f"unknown row groups: {unknown}")
    rows = spark.read.parquet(path).where(F.col("row_group").isin(*wanted))
    found = {r.row_group: (r.digest, r.total_bytes) for r in group_digest(rows.withColumn("_data", F.col("image.bytes")), "row_group", "pos", "_data").collect()}
    for g in wanted:
        if found.get(g) != tuple(pins[g]):
            raise Refused(f"row group {g}: digest or bytes differ from the pin")
    return rows


def sample_dataset(spark: SparkSession, path: str, pins: Mapping[tuple[str, int], tuple[str, int]], sizes: Mapping[str, int], seed: int = 42) -> DataFrame:
    """A seeded split of the records of a corpus's own Parquet row groups, each group hashed against its pin as it is read."""
    rows = rowgroups.read(spark, path, ["image", "text"], pins=pins)
    return sample_split(read_corpus(rows), sizes, seed)


def read_corpus(groups: DataFrame, prefix: str = "line", per_group: int = 100) -> DataFrame:
    """Records of row groups: ids count skipped rows too; rows without a text go."""
    text = tx.normalise("text")
    at = F.col("row_group") * per_group + F.col("pos")
    out = groups.select(F.concat_ws("-", F.lit(prefix), at.cast("string")).alias("id"), "image", text.alias("text"), F.col("row_group").alias("source_row_group"), at.alias("pos"))
    return out.where("text != ''")


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(file, path, bytes, sha256, content) of the files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    raw = raw.where(~F.col("path").contains("/__MACOSX/"))
    return raw.select(F.regexp_replace("path", "^.*/", "").alias("file"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def zip_listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, bytes, kind) of an archive's members by its directory, flattened; none is inflated.

    Refused if they would expand to over MAX_BYTES.
    """
    listed = archives.directory(spark, path)
    if (listed.agg(F.sum("bytes")).first()[0] or 0) > MAX_BYTES:
        raise Refused("the archive exceeds 1 GB expanded")
    return listed.select("file", "path", "bytes", "kind")


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, bytes, sha256, content, kind) of an archive's members; tasks share them by compressed size."""
    return archives.members(spark, path).select("file", "path", "bytes", "sha256", "content", "kind")


def file_violations(files: DataFrame, strict: bool = False) -> DataFrame:
    """(rule, file, message) of broken rules over read_files() or read_zip() members, rules in order.

    strict adds the rules of single-level folders: image extensions only, no nesting or unsafe
    member names, no symlinks, one to MAX_IMAGES images. Names compare in folded case there.
    """
    name = F.lower("file") if strict else F.col("file")
    twice = files.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n > 1")
    out = twice.select(F.lit(1).alias("rule"), "file", F.concat(F.lit("two files are named "), "file").alias("message"))
    if strict:
        p = F.col("path")
        tests = [
            (2, p.startswith("/") | p.rlike(r"(^|/)\.\.(/|\z)") | p.contains(":"), "unsafe member "),
            (4, (F.col("file") != TRANSCRIPTS) & ~F.lower("file").rlike(r"(" + "|".join(e.replace(".", r"\.") for e in IMAGE_EXTENSIONS) + r")\z"), "unsupported file "),
        ]
        if "kind" in files.columns:
            tests.append((3, F.col("kind") == "symlink", "symlink refused "))
        else:
            tests = tests[1:]
        for rule, broken, message in tests:
            out = out.unionByName(files.where(broken).select(F.lit(rule).alias("rule"), "file", F.concat(F.lit(message), p).alias("message")))
        images = files.where(F.col("file") != TRANSCRIPTS).agg(F.count("*").alias("n"))
        out = out.unionByName(images.where(~F.col("n").between(1, MAX_IMAGES)).select(F.lit(5).alias("rule"), F.lit(None).cast("string").alias("file"), F.lit(f"1..{MAX_IMAGES} images are supported").alias("message")))
    return out


def parse_transcripts(files: DataFrame) -> DataFrame:
    """(row, file, text, id) of transcripts.csv among files; a byte-order mark is fine, a malformed table is refused.

    A small control file (the members' names and texts): read on the driver, then distributed.
    """
    import csv
    import io

    rows = files.where(F.col("file") == TRANSCRIPTS).select("content").limit(2).collect()
    if len(rows) != 1:
        raise Refused(f"data must include one {TRANSCRIPTS} with the columns file and text")
    table = [r for r in csv.reader(io.StringIO(bytes(rows[0].content).decode("utf-8-sig"))) if r]
    head = table[0] if table else []
    if twice := sorted({h for h in head if head.count(h) > 1}):
        raise Refused(f"{TRANSCRIPTS} has duplicate column names: {twice}")
    if len(table) < 2 or not {"file", "text"} <= set(head):
        raise Refused(f"{TRANSCRIPTS} must have the columns file and text")
    for n, r in enumerate(table[1:], 1):
        if len(r) != len(head):
            raise Refused(f"{TRANSCRIPTS} row {n} has {len(r)} fields but the header has {len(head)}")
    data = []
    for n, r in enumerate(table[1:]):
        x = dict(zip(head, r))
        data.append((n, x["file"].strip().rpartition("/")[2], x["text"], x.get("id", "").strip()))
    return files.sparkSession.createDataFrame(data, "row long, file string, text string, id string")


def completeness(transcripts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, problem) of transcripts without an image and images without a transcript."""
    images = files.where(F.col("file") != TRANSCRIPTS).select(F.col("file"), F.lit(True).alias("_i"))
    rows = transcripts.select("file", F.lit(True).alias("_t")).distinct()
    both = rows.join(images, "file", "full_outer")
    problem = F.when(F.col("_i").isNull(), "missing image").when(F.col("_t").isNull(), "image without a transcript row")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def load_own_data(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Records (pos, id, file, text, image.data, source_sha256) of a folder or zip of images with transcripts.csv."""
    zipped = path.lower().endswith(".zip")
    files = read_zip(spark, path) if zipped else read_files(spark, path, recursive=not strict)
    named = zip_listing(spark, path) if zipped else files.drop("content", "sha256")
    if bad := file_violations(named, strict).orderBy("rule", "file").first():
        raise Refused(bad.message)
    rows = parse_transcripts(files)
    if bad := completeness(rows, files).orderBy("problem", "file").first():
        raise Refused(f"{bad.problem}: {bad.file}")
    rid = F.when(F.col("id") != "", F.col("id")).otherwise(F.col("file") if strict else tx.id_from_file("file"))
    out = rows.join(files.select("file", "content", "sha256"), "file").select(
        F.col("row").alias("pos"), rid.alias("id"), "file", "text", F.struct(F.col("content").alias("data")).alias("image"), F.col("sha256").alias("source_sha256")
    )
    if strict:
        ids = out.groupBy(F.lower("id").alias("k")).count().where("count > 1").limit(1).count()
        if ids or out.where(~tx.safe_identifier("id")).limit(1).count():
            raise Refused("ids must be unique and safe")
    return out


def manifest_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) of manifest files (path, bytes, sha256) that are missing or differ on disk, in path order."""
    have = files.select(F.col("path").alias("_p"), F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    joined = manifest.join(have, F.col("path") == F.col("_p"), "left")
    problem = F.when(F.col("_p").isNull(), "missing").when(F.col("bytes") != F.col("_b"), "size").when(F.col("sha256") != F.col("_s"), "sha256")
    return joined.select("path", problem.alias("problem")).where("problem is not null")


def verify_snapshot(manifest: DataFrame, files: DataFrame, model_id: str, revision: str) -> DataFrame:
    """One row (n_files, total_bytes) of a snapshot manifest (modelId, revision, files), or Refused at the first problem."""
    head = manifest.first()
    if head is None or head.modelId != model_id or head.revision != revision:
        raise Refused(f"the manifest is not of {model_id}@{revision}")
    listed = manifest.select(F.explode("files").alias("f")).select("f.*")
    if bad := manifest_problems(listed, files).orderBy("path").first():
        raise Refused(f"{bad.path}: {bad.problem}")
    return listed.agg(F.count("*").alias("n_files"), F.sum("bytes").alias("total_bytes"))


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest files that are not on disk: the plan of a download."""
    return manifest.join(files.select("path"), "path", "left_anti")


def recorded_digest(manifest: DataFrame, path: str) -> str | None:
    row = manifest.where(F.col("path") == path).select("sha256").first()
    return row and row[0]


def recorded_digests(manifests: DataFrame, path: str) -> DataFrame:
    """(root, sha256) of every snapshot in manifests(root, pos, path, sha256): what the first entry of path records, null if none does."""
    at = F.when(F.col("path") == path, F.col("pos"))
    return manifests.groupBy("root").agg(F.min_by("sha256", at).alias("sha256"))


def load_state(spark: SparkSession, path: str, hint: str = "run the earlier steps first") -> DataFrame:
    """A stage's saved table; a missing one is refused with a hint."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise Refused(f"{path} is missing: {hint}") from None


def load_json_state(spark: SparkSession, path: str, schema: str, hint: str = "run the earlier steps first") -> DataFrame:
    """load_state() of a JSON table, read with its schema (without one the whole table would be read for its types)."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise Refused(f"{path} is missing: {hint}") from None


def int_keys(column: str) -> Column:
    """A map whose keys are numbers as text, as JSON has them, with whole numbers as keys."""
    return F.transform_keys(column, lambda k, _: k.cast("long"))


def reload_split(lines: DataFrame, recorded: DataFrame) -> DataFrame:
    """lines (id, digest, ...) of a split, each with the digest that was recorded for it; a difference raises."""
    r = recorded.select(F.col("id").alias("_id"), F.col("digest").alias("_d"))
    joined = lines.join(r, F.col("id") == F.col("_id"), "left")
    same = F.col("digest").eqNullSafe(F.col("_d"))
    digest = F.when(same, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("staged image differs: "), "id")).cast("string"))
    return joined.withColumn("digest", digest).drop("_id", "_d")
