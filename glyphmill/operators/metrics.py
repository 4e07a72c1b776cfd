"""Per-pair and corpus error rates, baselines, bootstrap intervals."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as tx

#: Training texts that compete for the constant baseline, and lines from which a verdict is `measured`.
MEDOID_POOL, MEASURED_LINES = 120, 50


def pair_metrics(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", compose: bool = False, collapsed: bool = False) -> DataFrame:
    """pairs with the columns of one scored pair.

    Rates of an empty reference are null, exact then means an empty hypothesis; compose adds NFC;
    collapsed tells that neither text has white space but single spaces between words, and none is looked for.
    """
    norm = tx.normalise if compose else F.col if collapsed else tx.collapse
    work = pairs.withColumn("_said", F.coalesce(F.col(hypothesis), F.lit("")))
    work = work.withColumns({"_r": norm(reference), "_h": norm("_said")})
    work = work.withColumns({
        "ref_chars": F.length("_r").cast("long"),
        "hyp_chars": F.length("_h").cast("long"),
        "ref_words": F.size(tx.collapsed_words("_r")).cast("long"),
        "char_edits": tx.char_distance("_r", "_h").cast("long"),
        "word_edits": tx.text_word_distance(F.lower("_r"), F.lower("_h")).cast("long"),
        "exact": F.col("_r") == F.col("_h"),
    })
    some = F.col("ref_chars") > 0
    return work.withColumns({
        "cer": F.when(some, F.col("char_edits") / F.col("ref_chars")),
        "wer": F.when(some, F.col("word_edits") / F.col("ref_words")),
        "length_ratio": F.when(some, F.col("hyp_chars") / F.col("ref_chars")),
        "rate_reason": F.when(~some, F.lit("Empty reference: rates have zero denominators")),
    }).drop("_said", "_r", "_h")


def join_hypotheses(records: DataFrame, hypotheses: DataFrame, key: str = "id") -> DataFrame:
    """records (key, text) one to one with hypotheses (key, text) as reference and hypothesis.

    Both sides must hold the same keys once each; a missing or repeated key raises when the
    row is computed, so no pair is dropped in silence.
    """
    r = records.select(key, F.col("text").alias("reference"), F.lit(1).alias("_in_r"))
    h = hypotheses.select(key, F.col("text").alias("hypothesis"), F.lit(1).alias("_in_h"), *(c for c in hypotheses.columns if c not in (key, "text")))
    both = r.join(h, key, "full_outer")
    n = F.count("*").over(Window.partitionBy(key))
    bad = F.col("_in_r").isNull() | F.col("_in_h").isNull() | (n > 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("records and hypotheses differ at "), F.col(key).cast("string")))).otherwise(F.col("reference"))
    return both.withColumn("reference", checked).drop("_in_r", "_in_h")


def corpus_metrics(scored: DataFrame, *by: str | Column, more: Sequence[Column] = ()) -> DataFrame:
    """Corpus rates of pair_metrics() rows, over all or by group: micro, macro, percentiles, counts; and more sums of the same pass.

    Exact percentiles hold a group's different rates with their counts; there are at most as
    many as fractions of line lengths, whatever the number of lines.
    """
    s = lambda c: F.sum(c)
    return scored.groupBy(*by).agg(
        *more,
        F.count("*").alias("n"),
        (s("char_edits") / s("ref_chars")).alias("cer"),
        (s("word_edits") / s("ref_words")).alias("wer"),
        F.avg("cer").alias("cer_macro"),
        F.avg("wer").alias("wer_macro"),
        F.avg(F.col("exact").cast("double")).alias("exact_match"),
        F.percentile("cer", F.lit(0.5)).alias("median_cer"),
        F.percentile("cer", F.lit(0.9)).alias("p90_cer"),
        s("char_edits").alias("char_edits"),
        s("ref_chars").alias("ref_chars"),
        s("hyp_chars").alias("hyp_chars"),
        s("word_edits").alias("word_edits"),
        s("ref_words").alias("ref_words"),
        (s("hyp_chars") / s("ref_chars")).alias("length_ratio"),
    )


def ocr_metrics(pairs: DataFrame) -> DataFrame:
    """Corpus rates with composed texts; an empty reference raises."""
    r = F.when(tx.normalise("reference") == "", F.raise_error(F.lit("a record has an empty reference"))).otherwise(F.col("reference"))
    return corpus_metrics(pair_metrics(pairs.withColumn("reference", r), compose=True))


def with_constant(records: DataFrame, value: str | DataFrame) -> DataFrame:
    """Every record's text as reference against one hypothesis (a text, or a one-row table of column `text`)."""
    refs = records.withColumnRenamed("text", "reference")
    if isinstance(value, str):
        return refs.withColumn("hypothesis", F.lit(value))
    return refs.crossJoin(F.broadcast(value.select(F.col("text").alias("hypothesis")).limit(1)))


def empty_baseline(records: DataFrame) -> DataFrame:
    return corpus_metrics(pair_metrics(with_constant(records, "")))


def medoid_scores(train: DataFrame, pos: str = "pos", pool: int = MEDOID_POOL) -> DataFrame:
    """(pos, text, score) of the first `pool` training texts: summed error rate to each other one, in pos order.

    The pool is the operator's own bound (120 by default), so its pairs are bounded too.
    """
    first = train.orderBy(pos).limit(pool).select(F.col(pos).alias("pos"), tx.normalise("text").alias("text")).where("text != ''")
    other = first.select(F.col("pos").alias("other_pos"), F.col("text").alias("other"))
    pairs = first.crossJoin(F.broadcast(other)).withColumn("rate", tx.char_distance("other", "text") / F.length("other"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("other_pos", "rate"))), lambda x: x["rate"])
    return pairs.groupBy("pos", "text").agg(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b).alias("score"))


def medoid(train: DataFrame, pos: str = "pos", pool: int = MEDOID_POOL) -> DataFrame:
    """The training text nearest to the others (one row); the first of equal ones."""
    return medoid_scores(train, pos, pool).agg(F.min_by("text", F.struct("score", "pos")).alias("text"))


def constant_baseline(train: DataFrame, records: DataFrame, pos: str = "pos", pool: int = MEDOID_POOL) -> DataFrame:
    return corpus_metrics(pair_metrics(with_constant(records, medoid(train, pos, pool))))


def draws(spark: SparkSession, n: int, resamples: int, seed: int, compatible: bool = False) -> DataFrame:
    """(draw, at): n places below n for each resample.

    By default a hash of (seed, draw, step), computed where it is used. compatible gives those of
    Python's generator for small n, made on the driver.
    """
    if compatible:
        r = random.Random(seed)
        rows = [(b, r.randrange(n)) for b in range(resamples) for _ in range(n)]
        return spark.createDataFrame(rows, "draw long, at long")
    step = spark.range(resamples * n)
    return step.select(F.floor(F.col("id") / n).alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("at"))


def _paired(scored: DataFrame, paired: DataFrame | None, measure: str, pos: str) -> DataFrame:
    """(at, e, t, e2, t2): a line's edits and length in either system; a line of one of them alone raises."""
    edits, totals = ("char_edits", "ref_chars") if measure == "cer" else ("word_edits", "ref_words")
    rows = scored.select(F.col(pos).alias("at"), F.col(edits).alias("e"), F.col(totals).alias("t"))
    if paired is None:
        return rows.withColumns({"e2": F.lit(0), "t2": F.lit(1)})
    other = paired.select(F.col(pos).alias("at"), F.col(edits).alias("e2"), F.col(totals).alias("t2"))
    rows = rows.join(other, "at", "full_outer")
    lost = F.col("e").isNull() | F.col("e2").isNull()
    return rows.withColumn("e", F.when(lost, F.raise_error(F.lit("paired rows must cover the same lines")).cast("long")).otherwise(F.col("e")))


def _interval(stats: DataFrame, whole: DataFrame, measure: str, level: float, paired: bool) -> DataFrame:
    """Ends of the sorted statistics (one number a resample), beside the whole's estimate."""
    at = lambda x: F.element_at(F.col("s"), (F.least(F.col("n_resamples") - 1, F.floor(F.lit(x) * F.col("n_resamples"))) + 1).cast("int"))
    ends = stats.agg(F.array_sort(F.collect_list("stat")).alias("s"), F.count("*").alias("n_resamples"))
    ends = ends.select(at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"), "n_resamples")
    return whole.crossJoin(F.broadcast(ends)).select(F.lit(measure).alias("measure"), "estimate", "low", "high", F.lit(level).alias("level"), "n_lines", "n_resamples", F.lit(paired).alias("paired"))


def bootstrap_interval(scored: DataFrame, drawn: DataFrame, paired: DataFrame | None = None, measure: str = "cer", level: float = 0.95, pos: str = "pos") -> DataFrame:
    """One row: estimate, low and high of a micro rate (or of its difference to paired) over resampled lines.

    scored and paired have pos (0, 1, ...) and the counts of pair_metrics(); drawn is draws().
    For small tables: every draw meets its line in a join, lines times resamples rows in all.
    poisson_interval() needs none and is meant for large ones.
    """
    rows = _paired(scored, paired, measure, pos)
    rate = F.sum("e") / F.sum("t") - F.sum("e2") / F.sum("t2")
    whole = rows.agg(rate.alias("estimate"), F.count("*").alias("n_lines"))
    return _interval(drawn.join(rows, "at").groupBy("draw").agg(rate.alias("stat")), whole, measure, level, paired is not None)


#: The hash of a line and a resample counts up to this prime.
_PRIME = (1 << 31) - 1
#: Where the hash reaches the cumulative probabilities of a Poisson variable of mean 1, as whole numbers.
POISSON = [round(_PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]
#: Weights that a task works out at once: few enough for a core's own memory.
_WEIGHTS = 1 << 17


def _rest(x: np.ndarray) -> None:
    """x, of at most 62 bits, becomes its rest by _PRIME, in place: of 2^31 - 1 the high bits are added to the low ones."""
    high = x >> 31
    x &= _PRIME
    x += high
    whole = x.view(np.uint64)
    np.minimum(whole, (x - _PRIME).view(np.uint64), out=whole)  # a negative one is the larger


def poisson_weights(at: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights of lines (rows) in resamples (columns): a hash of line, resample and seed; all products fit 63 bits."""
    x = (at % _PRIME * 48271 % _PRIME)[:, None] + ((draws * 69621 + seed * 16807 % _PRIME) % _PRIME)[None, :]
    _rest(x)
    x *= 1583458089
    _rest(x)
    x ^= x >> 15
    x *= 784588716
    _rest(x)
    x, out = x.astype(np.int32), np.zeros(x.shape, np.uint8)
    for c in POISSON:
        out += x >= c
    return out


def poisson_interval(scored: DataFrame, resamples: int = 2000, seed: int = 0, paired: DataFrame | None = None, measure: str = "cer", level: float = 0.95, pos: str = "pos") -> DataFrame:
    """bootstrap_interval() with a Poisson(1) weight for each line and resample instead of exactly n draws.

    Weights are worked out where the lines lie, in blocks; a task sends one row a resample, so the work grows with
    the lines, and neither rows nor the shuffle with lines times resamples.
    """
    rows = _paired(scored, paired, measure, pos)
    draws = np.arange(resamples, dtype=np.int64)
    step = max(1, _WEIGHTS // resamples)

    def sums(batches):
        total = np.zeros((5, resamples + 1))  # the last column is the whole: every line once
        for b in batches:
            at, *counts = (c.to_numpy().astype(np.int64) for c in b.columns)
            whole = np.stack([*counts, np.ones(len(at))]).astype(np.float64)
            for i in range(0, len(at), step):
                w = poisson_weights(at[i : i + step], draws, seed)
                total[:, :-1] += whole[:, i : i + step] @ w.astype(np.float64)
            total[:, -1] += whole.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(draws, -1)), *(pa.array(np.rint(x).astype(np.int64)) for x in total)], ["draw", *names])

    names = ["e", "t", "e2", "t2", "n"]
    kinds = rows.select("at", *(F.col(c).cast("long").alias(c) for c in names[:4]))
    each = kinds.mapInArrow(sums, "draw long, e long, t long, e2 long, t2 long, n long").groupBy("draw").agg(*(F.sum(c).alias(c) for c in names))
    stat = F.try_divide("e", "t") - F.try_divide("e2", "t2")  # no lines, no rate
    drawn, whole = F.col("draw") >= 0, F.col("draw") < 0
    one = each.agg(F.array_sort(F.collect_list(F.when(drawn, stat))).alias("s"), F.max(F.when(whole, stat)).alias("estimate"), F.coalesce(F.max(F.when(whole, F.col("n"))), F.lit(0)).alias("n_lines"))
    at = lambda x: F.get("s", min(resamples - 1, int(x * resamples)))
    return one.select(
        F.lit(measure).alias("measure"), "estimate", at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"), F.lit(level).alias("level"),
        "n_lines", F.lit(resamples).cast("long").alias("n_resamples"), F.lit(paired is not None).alias("paired"),
    )


def recipe_intervals(scored: DataFrame, default: str, resamples: int = 2000, seed: int = 0, measure: str = "cer", config: str = "config", pos: str = "pos") -> DataFrame:
    """A row of poisson_interval() for each configuration (column `pair`: `name-default`) against the default's on the same lines.

    scored has a row a configuration and validation line. A configuration without lines, the default's among them, has no
    interval, so an empty table gives an empty result; lines of one side alone raise. The grid, not the lines, is
    listed on the driver.
    """
    names = sorted(r[0] for r in scored.where(F.col(config).isNotNull()).select(config).distinct().collect())
    base = scored.where(F.col(config) == default)
    out = None
    for name in names if default in names else []:
        if name == default:
            continue
        one = poisson_interval(scored.where(F.col(config) == name), resamples, seed, base, measure, pos=pos)
        one = one.select(F.lit(f"{name}-{default}").alias("pair"), *one.columns)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = poisson_interval(base, 1, seed, base, measure, pos=pos).where("false")
        out = out.select(F.lit("").alias("pair"), *out.columns)
    return out


def verdict(n: Column | str) -> Column:
    return F.when((F.col(n) if isinstance(n, str) else n) >= MEASURED_LINES, "measured").otherwise("measured-small-sample")


def evaluate(scored: DataFrame) -> DataFrame:
    """corpus_metrics() and token totals of scored recogniser output, with the verdict on its size."""
    more = (F.sum(F.col("truncated").cast("long")).alias("n_truncated"), F.sum("new_tokens").alias("new_tokens"))
    return corpus_metrics(scored, more=more).withColumn("verdict", verdict("n"))


def evaluation_report(items: DataFrame) -> DataFrame:
    """items (text, reference) with cer, wer and a verdict: sample-sanity, or not-measurable without a reference."""
    some = F.coalesce(F.col("reference"), F.lit("")) != ""
    r, h, rw = tx.normalise("reference"), tx.normalise("text"), tx.words("reference")
    return items.withColumns({
        "n_chars": F.length("text"),
        "cer": F.when(some & (r != ""), tx.char_distance(r, h) / F.nullif(F.length(r), F.lit(0))),
        "wer": F.when(some & (F.size(rw) > 0), tx.word_distance(rw, tx.words("text")) / F.nullif(F.size(rw), F.lit(0))),
        "verdict": F.when(some, "sample-sanity").otherwise("not-measurable"),
    })
