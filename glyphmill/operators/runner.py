"""The recogniser boundary: any callable over Arrow batches, checked and post-processed around it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import text as tx
from glyphmill.operators import places
from glyphmill.operators.rules import Refused, check_parameters

#: Most rows of one call of a recogniser.
MAX_BATCH = 64

Runner = Callable[[pd.DataFrame], pd.DataFrame]


def batches(records: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """records with batch (0, 1, ...): rows in order, `size` at a time, the last batch shorter."""
    placed = places.numbered(records, F.floor(F.col(pos) / 65536), pos, name="_place")
    return placed.withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames that hold whole batches only, and where each batch starts, with the end; rows come sorted by batch."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        edges = [0, *((frame["batch"].to_numpy()[1:] != frame["batch"].to_numpy()[:-1]).nonzero()[0] + 1).tolist()]
        held = frame.iloc[edges[-1] :]
        if len(edges) > 1:
            yield frame.iloc[: edges[-1]].reset_index(drop=True), edges
    if held is not None and len(held):
        yield held.reset_index(drop=True), [0, len(held)]


def whole_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One frame for each value of batch; rows come sorted by it, and a batch goes on from one frame to the next."""
    for frame, edges in _whole(frames):
        for a, b in zip(edges, edges[1:]):
            yield frame.iloc[a:b].reset_index(drop=True)


def with_progress(spark: SparkSession, action: Callable[[], object], progress: Callable[[int, int], None], every: float = 0.2) -> object:
    """The result of an action; meanwhile progress(done, total) is told the tasks of its jobs so far."""
    group, over = f"glyphmill-{uuid.uuid4().hex}", threading.Event()
    tracker = spark.sparkContext.statusTracker()

    def told() -> tuple[int, int]:
        jobs = [j for i in tracker.getJobIdsForGroup(group) if (j := tracker.getJobInfo(i))]
        stages = [s for j in jobs for i in j.stageIds if (s := tracker.getStageInfo(i))]
        return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)

    def watch() -> None:
        last = None
        while not over.wait(every):
            if (now := told()) != last:
                last = now
                progress(*now)

    watcher = InheritableThread(watch, session=spark)
    spark.sparkContext.setJobGroup(group, "watched")
    watcher.start()
    try:
        out = action()
    finally:
        over.set()
        watcher.join()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    done, _ = told()
    progress(done, done)  # stages that were skipped have no tasks to come
    return out


def transcribe(records: DataFrame, make_runner: Callable[[], Runner], stop: str = "", budget: int = 1024, batch_size: int = 8, pos: str = "pos") -> DataFrame:
    """records with batch, text and new_tokens of a recogniser, text cleaned, truncated at the budget.

    Batches are those of batches(): rows in the order of pos over the whole table, batch_size at a time. A batch
    is whole in one partition and in one call, wherever the borders of Arrow batches fall.

    make_runner builds the recogniser once in each task, on its first batch; it maps a frame of
    records to a frame of text and new_tokens, one row each. Another number of rows or a column
    missing raises. Rows keep their own columns; text of the input is called reference.
    """
    check_parameters({"batch_size": batch_size, "budget": budget}, {"batch_size": (1, MAX_BATCH), "budget": (1, 4096)}, ("batch_size", "budget"))
    columns = records.columns
    records = batches(records, batch_size, pos).repartition("batch").sortWithinPartitions("batch", pos)
    keep = [c for c in [*columns, "batch"] if c != "text"]
    fields = [records.schema[c] for c in keep]
    has_reference = "text" in records.columns
    fields += [T.StructField("reference", T.StringType())] * has_reference + [T.StructField("text", T.StringType()), T.StructField("new_tokens", T.IntegerType())]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = None
        for whole, edges in _whole(frames):
            texts, tokens = [], []
            for a, b in zip(edges, edges[1:]):
                part = whole.iloc[a:b].reset_index(drop=True)
                runner = runner or make_runner()
                got = runner(part)
                if len(got) != len(part) or not {"text", "new_tokens"} <= set(got.columns):
                    raise Refused(f"the recogniser gave {len(got)} rows {list(got.columns)} for {len(part)} records")
                texts.append(got["text"].to_numpy())
                tokens.append(got["new_tokens"].to_numpy())
            out = whole[keep].copy()
            if has_reference:
                out["reference"] = whole["text"]
            out["text"], out["new_tokens"] = np.concatenate(texts), np.concatenate(tokens)
            yield out

    said = records.mapInPandas(run, T.StructType(fields))
    clean = tx.clean_output("text", stop) if stop else tx.collapse("text")
    return said.withColumn("text", clean).withColumn("truncated", tx.truncated("new_tokens", budget))


def parity(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """One row (n, identical): outputs of a model and of its reloaded copy on the same lines."""
    b = before.select(key, F.col("text").alias("_b"))
    a = after.select(key, F.col("text").alias("_a"))
    return b.join(a, key, "full_outer").agg(F.count("*").alias("n"), F.sum(F.col("_b").eqNullSafe(F.col("_a")).cast("long")).alias("identical"))
