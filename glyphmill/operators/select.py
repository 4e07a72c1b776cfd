"""Model selection on validation rates, and settings against their registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gain in character error rate that a challenger needs.
MARGIN = 0.01


def best_epoch(history: DataFrame, min_gain: float = 0.0, by: str = "config") -> DataFrame:
    """(by, best_epoch, best_cer, frozen_cer) of histories (by, epoch, cer; cer null: not measured).

    The first epoch of least rate wins; the frozen model (epoch 0) stays unless it is beaten by
    over min_gain; without a measured rate the last epoch is kept.
    """
    first = F.min_by("epoch", F.when(F.col("cer").isNotNull(), F.struct("cer", "epoch")))
    out = history.groupBy(by).agg(
        first.alias("e"), F.min("cer").alias("c"), F.max(F.when(F.col("epoch") == 0, F.col("cer"))).alias("frozen_cer"), F.max("epoch").alias("last")
    )
    keep = F.col("frozen_cer").isNotNull() & (F.col("e") != 0) & (F.col("frozen_cer") - F.col("c") <= min_gain)
    return out.select(
        by,
        F.when(F.col("e").isNull(), F.col("last")).when(keep, 0).otherwise(F.col("e")).alias("best_epoch"),
        F.when(keep, F.col("frozen_cer")).otherwise(F.col("c")).alias("best_cer"),
        "frozen_cer",
    )


def running_best(history: DataFrame, by: str = "config") -> DataFrame:
    """history with the least rate so far and whether an epoch improved on all before it."""
    w = Window.partitionBy(by).orderBy("epoch")
    before = F.min("cer").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumns({"improved": before.isNull() | (F.col("cer") < before), "best_so_far": F.min("cer").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def select_recipe(kept: DataFrame, default: str, margin: float = MARGIN) -> DataFrame:
    """One row (chosen, chosen_cer, default_cer): kept has config, grid_pos, best_epoch, best_cer.

    The default stays unless a configuration is lower by over margin; the lowest wins, ties by
    grid order; if all kept epoch 0 the frozen model is chosen.
    """
    d = kept.agg(F.max(F.when(F.col("config") == default, F.col("best_cer"))).alias("default_cer"), F.max("best_epoch").alias("latest"))
    rows = kept.crossJoin(F.broadcast(d))
    wins = (F.col("config") != default) & (F.col("default_cer") - F.col("best_cer") > margin)
    pick = rows.groupBy("default_cer", "latest").agg(F.min(F.when(wins, F.struct("best_cer", "grid_pos", "config"))).alias("w"))
    missing = F.raise_error(F.lit(f"the default configuration {default} has no result")).cast("string")
    chosen = F.when(F.col("default_cer").isNull(), missing).when(F.col("latest") == 0, "frozen").otherwise(F.coalesce(F.col("w.config"), F.lit(default)))
    return pick.select(chosen.alias("chosen"), F.coalesce("w.best_cer", "default_cer").alias("chosen_cer"), "default_cer")


def settings_differences(registered: DataFrame, given: DataFrame) -> DataFrame:
    """(key, expected, got) of registered settings (key, value, is_float) that given (key, value) misses or changes.

    Floating settings are equal within a relative 1e-12; a missing key has `<missing>`.
    """
    g = given.select("key", F.col("value").alias("got"))
    joined = registered.join(g, "key", "left").withColumn("got", F.coalesce("got", F.lit("<missing>")))
    b = F.col("got").try_cast("double")
    a = F.col("value").try_cast("double")
    near = F.col("is_float") & a.isNotNull() & b.isNotNull() & (F.abs(b - a) <= 1e-12 * F.greatest(F.lit(1.0), F.abs(a)))
    return joined.where(~(F.coalesce(near, F.lit(False)) | (F.col("got") == F.col("value")))).select("key", F.col("value").alias("expected"), "got")


def pass_number(history: DataFrame, key: str) -> Column | int:
    """One more than the earlier entries of a run history for the same key."""
    return history.where(F.col("key") == key).count() + 1
