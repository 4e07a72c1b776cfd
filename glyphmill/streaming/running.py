"""Micro error rates of a stream of scored lines: sums, so a stream's state is one row a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.metrics import pair_metrics


def running_rates(pairs: DataFrame, *by: str) -> DataFrame:
    """Corpus rates so far of a streaming (or plain) table of reference and hypothesis, by group; complete mode."""
    return pair_metrics(pairs).groupBy(*by).agg(
        F.count("*").alias("n"),
        (F.sum("char_edits") / F.sum("ref_chars")).alias("cer"),
        (F.sum("word_edits") / F.sum("ref_words")).alias("wer"),
    )
