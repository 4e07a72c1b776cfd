"""Writers: dataset tables, fixed-field CSV, reports, run history, fresh exports."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators.rules import Refused
from glyphmill.sources import bundle


def dataset_table(records: DataFrame) -> DataFrame:
    """id, file, width, height, chars, words, text, source_row_group of records, texts normalised."""
    t = tx.normalise("text")
    group = F.col("source_row_group") if "source_row_group" in records.columns else F.lit(None).cast("int")
    return records.select("id", F.concat("id", F.lit(".jpg")).alias("file"), "width", "height", F.length(t).alias("chars"), F.size(tx.words(t, lower=False)).alias("words"), t.alias("text"), group.alias("source_row_group"))


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "error") -> None:
    """CSV of the given fields (absent ones empty); booleans print as True and False, quotes double."""
    kinds = dict(df.dtypes)
    cols = []
    for f in fields or df.columns:
        c = F.lit(None).cast("string") if f not in kinds else F.initcap(F.col(f).cast("string")) if kinds[f] == "boolean" else F.col(f)
        cols.append(c.alias(f))
    df.select(*cols).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_dataset_csv(records: DataFrame, path: str, mode: str = "error") -> None:
    write_csv(dataset_table(records), path, mode=mode)


def save_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def save_json_state(df: DataFrame, path: str) -> None:
    """A stage's table as JSON lines; nulls keep their fields, so that it loads with the same columns."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def table_digest(df: DataFrame) -> str:
    """An order-independent digest of a table: row hashes added up, with the number of rows."""
    h = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(30,0)")).alias(f"p{i}") for i in range(8)]
    return df.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(x.cast("string") for x in parts)), 256)).first()[0]


def check_fresh(now: Mapping[str, str | None], recorded: Mapping[str, str | None], rerun: str) -> None:
    """Refused if an input's digest is another than the one a summary recorded."""
    if changed := sorted(n for n, d in now.items() if recorded.get(n) != d):
        raise Refused(f"{', '.join(changed)} changed after the summary; run {rerun} again")


def stale_inputs(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Names (name, digest) whose digest is another than the recorded one, or has none recorded: check_fresh() of a table."""
    r = recorded.select(F.col("name").alias("_n"), F.col("digest").alias("_d"))
    return now.join(r, F.col("name") == F.col("_n"), "left").where(~F.col("digest").eqNullSafe(F.col("_d"))).select("name")


def bundle_rows(tables: Mapping[str, DataFrame], reports: Mapping[str, DataFrame], pages: DataFrame | None = None) -> DataFrame:
    """(name, pos, content) of an export: tables as CSV files, reports as JSON lines, pages (page_id, ...) as a JSON file each.

    Rows are in the order of their values.
    """
    line = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    none = F.struct(F.lit(1).alias("kind"), F.lit(None).cast("string").alias("key"))
    parts = [bundle.csv_lines(df, df.columns).select(F.lit(f"{name}.csv").alias("name"), "pos", "content") for name, df in tables.items()]
    for name, df in reports.items():
        df = df.drop("rows")
        parts.append(df.select(F.lit(f"{name}.json").alias("name"), none.withField("key", line(df)).alias("pos"), F.encode(F.concat(line(df), F.lit("\n")), "UTF-8").alias("content")))
    if pages is not None:
        name = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit("/page.json"))
        parts.append(pages.select(name.alias("name"), none.withField("key", line(pages)).alias("pos"), F.encode(F.concat(line(pages), F.lit("\n")), "UTF-8").alias("content")))
    return functools.reduce(DataFrame.unionByName, parts)


def export_bundle(
    tables: Mapping[str, DataFrame],
    reports: Mapping[str, DataFrame],
    path: str,
    now: Mapping[str, str | None] | None = None,
    recorded: Mapping[str, str | None] | None = None,
    pages: DataFrame | None = None,
    fresh: Mapping[str, str] | None = None,
) -> None:
    """bundle_rows() as files of one new folder, in one job that commits them as one, after the freshness check.

    fresh names earlier bundles and their digests, which are checked again at the commit.
    """
    check_fresh(now or {}, recorded or {}, "the summary")
    bundle.write(bundle_rows(tables, reports, pages), path, fresh=fresh)


def missing_outputs(required: DataFrame, found: DataFrame) -> DataFrame:
    """Required paths that were not written."""
    return required.join(found.select("path"), "path", "left_anti")


def append_history(spark: SparkSession, row: Mapping[str, object], schema: str, path: str) -> None:
    spark.createDataFrame([tuple(row.values())], schema).write.mode("append").parquet(path)


def result_name(history: DataFrame, key: str, stem: str) -> str:
    """A name no earlier run has: the first keeps the stem, reproductions get their pass number."""
    n = history.where(F.col("key") == key).count()
    return stem if not n else f"{stem}-pass{n + 1}"


def write_runs(df: DataFrame, path: str, run_id: str) -> None:
    """A run's rows in a partition of their own."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def invalidate(spark: SparkSession, run_id: str, reason: str, path: str) -> None:
    """A status row that marks a run's outputs as refused."""
    append_history(spark, {"run_id": run_id, "status": "refused", "reason": reason}, "run_id string, status string, reason string", path)


def report(frozen: DataFrame, adapted: DataFrame) -> DataFrame:
    """Per line both systems' texts and rates as one JSON value."""
    a = frozen.select("id", "reference", F.struct("hypothesis", "cer", "wer").alias("frozen"))
    b = adapted.select("id", F.struct("hypothesis", "cer", "wer").alias("adapted"))
    return a.join(b, "id").select("id", F.to_json(F.struct("id", "reference", "frozen", "adapted")).alias("line"))
