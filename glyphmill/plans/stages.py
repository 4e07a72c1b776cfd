"""Stages of a comparison: named tables that are made again when their inputs change, and written together."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from graphlib import TopologicalSorter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import compare, metrics
from glyphmill.operators.rules import Refused
from glyphmill.sources import sinks
from glyphmill.sources.readers import load_state


def baselines(train: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    return {"empty": metrics.empty_baseline(records), "constant": metrics.constant_baseline(train, records)}


def comparison(said: DataFrame, a: str, b: str) -> dict[str, DataFrame]:
    """said (id, system, reference, hypothesis, truncated, markup) -> result, metric, disagreement and markup tables."""
    scored = metrics.pair_metrics(said)
    categories = compare.disagreement(scored, a, b)
    return {
        "results": compare.result_rows(scored).join(categories, "id"),
        "metrics": compare.system_summary(scored),
        "disagreement": categories.groupBy("disagreement_category").agg(F.count("*").alias("n")),
        "markup_sensitivity": compare.markup_sensitivity(said),
    }


def structure(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Element counts of pages (page_id, markup) against their expectations."""
    return compare.structure_rows(expected, compare.observed_counts(pages))


def export(tables: Mapping[str, DataFrame], inputs: Mapping[str, DataFrame], recorded: Mapping[str, str], path: str) -> None:
    """All tables as CSV, unless an input is another than the one recorded when they were computed."""
    now = {name: sinks.table_digest(df) for name, df in inputs.items()}
    sinks.export_bundle(tables, {}, path, now, recorded)


class Stage(NamedTuple):
    """A table worked out from given tables and those of other stages, by name; run takes them in order."""

    name: str
    inputs: tuple[str, ...]
    run: Callable[..., DataFrame]


RUNS = "run long, stage string, status string, rows long, digest string, inputs map<string, string>, path string, reason string"


def run_stages(spark: SparkSession, stages: Sequence[Stage], given: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Run the stages whose inputs are others than when they last ran; one row a stage (run, stage, status, rows, digest, reason).

    What a stage makes is a table below folder, and a row of the runs table there says which digests of its inputs it was
    made from. So a stage is `kept` if the content of all its inputs is the same, though they were worked out anew.
    A stage that refuses its input is `refused`; those that need it are `blocked` and their old tables no longer count.
    """
    known = {s.name: s for s in stages}
    log = f"{folder.rstrip('/')}/runs"
    try:
        past = load_state(spark, log)
    except Refused:
        past = spark.createDataFrame([], RUNS)
    number = 1 + (past.agg(F.max("run")).first()[0] or 0)
    last = {r.stage: r for r in past.groupBy("stage").agg(F.max_by(F.struct(*past.columns), "run").alias("r")).select("r.*").collect()}
    digests = {name: sinks.table_digest(df) for name, df in given.items()}
    tables, rows = dict(given), []
    for name in TopologicalSorter({s.name: [i for i in s.inputs if i in known] for s in stages}).static_order():
        stage, before = known[name], last.get(name)
        if unknown := [i for i in stage.inputs if i not in known and i not in given]:
            raise Refused(f"{name} needs {unknown}, which nothing gives")
        if missing := [i for i in stage.inputs if i not in digests]:
            rows.append((number, name, "blocked", None, None, {}, None, f"{missing[0]} is missing"))
            continue
        now = {i: digests[i] for i in stage.inputs}
        if before and before.digest and before.inputs == now:
            path, digest, n, status = before.path, before.digest, before.rows, "kept"
        else:
            path, status = f"{folder.rstrip('/')}/{name}-{number}", "ran"
            try:
                sinks.save_state(stage.run(*(tables[i] for i in stage.inputs)), path)
            except Refused as e:
                rows.append((number, name, "refused", None, None, now, None, str(e)))
                continue
            made = load_state(spark, path)
            digest, n = sinks.table_digest(made), made.count()
        tables[name], digests[name] = load_state(spark, path), digest
        rows.append((number, name, status, n, digest, now, path, None))
    done = spark.createDataFrame(rows, RUNS)
    done.coalesce(1).write.mode("append").parquet(log)
    return done.drop("inputs", "path")


def workshop(a: str, b: str) -> list[Stage]:
    """The comparison of two systems as stages over said (id, system, reference, hypothesis, truncated, markup), page_said
    (page_id, model, reference, hypothesis, truncated), drawn (page_id, markup), expected (page_id, element_type, expected_count) and runs."""
    return [
        Stage("results", ("said",), lambda said: compare.result_rows(metrics.pair_metrics(said)).join(compare.disagreement(metrics.pair_metrics(said), a, b), "id")),
        Stage("metrics", ("said",), lambda said: compare.system_summary(metrics.pair_metrics(said))),
        Stage("disagreement", ("results",), lambda r: r.groupBy("disagreement_category").agg(F.count_distinct("id").alias("n"))),
        Stage("sensitivity", ("said",), compare.markup_sensitivity),
        Stage("structure", ("drawn", "expected"), structure),
        Stage("pages", ("page_said",), compare.page_rows),
        Stage("inspect", ("page_said",), lambda p: compare.word_diff(p.select("page_id", "model", "reference", "hypothesis"), 8)),
        Stage("resources", ("runs", "said", "page_said"), lambda r, s, p: compare.resources(r, s.withColumnRenamed("system", "model"), p)),
        Stage("summary", ("pages",), compare.page_means),
    ]
