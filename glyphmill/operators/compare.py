"""Several systems on the same lines: categories, summaries, markup and structure diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import text as tx
from glyphmill.functions import udf
from glyphmill.operators.metrics import corpus_metrics, pair_metrics

#: Character error rate below which a line is read well.
GOOD = 0.2


def token_overlap(pairs: DataFrame, key: str = "id") -> DataFrame:
    """(key, token_precision, token_recall, token_f1) of multisets of lower-cased words of each pair, a row a pair; 0 where a side is empty."""
    words = pairs.select(key, tx.words("reference").alias("_r"), tx.words("hypothesis").alias("_h"))
    sums = words.select(key, F.coalesce(tx.shared_words("_r", "_h"), F.lit(0)).alias("o"), F.size("_r").alias("a"), F.size("_h").alias("b"))
    rate = lambda n: F.when(F.col(n) > 0, F.col("o") / F.col(n)).otherwise(F.lit(0.0))
    out = sums.withColumns({"token_precision": rate("b"), "token_recall": rate("a")})
    p, r = F.col("token_precision"), F.col("token_recall")
    return out.withColumn("token_f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))).select(key, "token_precision", "token_recall", "token_f1")


def result_rows(scored: DataFrame) -> DataFrame:
    """scored lines of any systems with error_category."""
    empty = tx.collapse("hypothesis") == ""
    return scored.withColumn("error_category", tx.error_category("cer", "length_ratio", empty, "truncated"))


def disagreement(scored: DataFrame, a: str, b: str, key: str = "id") -> DataFrame:
    """(key, disagreement_category) of two systems' lines."""
    good = lambda s: F.max(F.when(F.col("system") == s, F.col("cer") < GOOD))
    both = scored.where(F.col("system").isin(a, b)).groupBy(key).agg(good(a).alias("ga"), good(b).alias("gb"))
    case = F.when(F.col("ga") & F.col("gb"), "both_good").when(F.col("ga"), f"{a}_only_good").when(F.col("gb"), f"{b}_only_good").otherwise("both_poor")
    return both.select(key, case.alias("disagreement_category"))


def system_summary(scored: DataFrame) -> DataFrame:
    """One row a system: corpus measures, empty and truncated hypotheses."""
    more = (F.sum((tx.collapse("hypothesis") == "").cast("long")).alias("empty_hypotheses"), F.sum(F.col("truncated").cast("long")).alias("truncated"))
    return corpus_metrics(scored, "system", more=more)


def system_deltas(summary: DataFrame, base: str, measures: tuple[str, ...] = ("cer", "wer", "cer_macro", "exact_match")) -> DataFrame:
    """Every system's measures minus the base system's, and whether it beats it (a higher exact match, lower rates).

    summary has a row a system, so one window over all of it finds the base; the lines are read once.
    """
    all_systems = Window.partitionBy(F.lit(0))
    of_base = {f"_{m}": F.max(F.when(F.col("system") == base, F.col(m))).over(all_systems) for m in measures}
    joined = summary.withColumns(of_base).where(F.coalesce(*(F.col(c) for c in of_base)).isNotNull())
    delta = lambda m: F.col(m) - F.col(f"_{m}")
    return joined.select(
        "system",
        *(delta(m).alias(f"{m}_delta") for m in measures),
        *((delta(m) > 0 if m == "exact_match" else delta(m) < 0).alias(f"{m}_beats") for m in measures),
    )


def readings(deltas: DataFrame, base: str, measure: str, digits: int = 4) -> DataFrame:
    """(system, reading): a sentence on each system's difference to the base in one measure."""
    d = F.round(F.col(f"{measure}_delta"), digits)
    say = lambda how: F.lit(f"{measure} {how} {base}")
    return deltas.select("system", F.when(d < 0, say("lower than")).when(d > 0, say("higher than")).otherwise(say("as")).alias("reading"))


def markup_sensitivity(scored: DataFrame, collapsed: bool = False) -> DataFrame:
    """One row a system: rates before and after an unfinished tag at the end is left out; failures of its markup.

    scored has system, id, reference, hypothesis, truncated and markup (null where a system makes none);
    collapsed tells that neither text has white space but single spaces between words, and none is looked for.
    """
    norm = F.col if collapsed else tx.collapse
    plain = scored.select("system", "truncated", "markup", norm("reference").alias("reference"), norm("hypothesis").alias("hypothesis"))
    base = plain.withColumn("s", tx.strip_partial_markup("hypothesis", collapsed=True))
    # Each count stays a column of its own, so distances that no one asks for are not worked out.
    counts = ("char_edits", "word_edits", "ref_chars", "ref_words")
    first = pair_metrics(base, collapsed=True).select("system", "truncated", "markup", "s", "reference", *(F.col(c).alias(f"configured_{c}") for c in counts))
    # The text without its tag is scored again only where there was one: an equal pair costs no distance.
    again = F.length("s.fragment") > 0
    more = first.withColumns({"had_tag": again, "_ref": F.when(again, F.col("reference")).otherwise(""), "_hyp": F.when(again, F.col("s.text")).otherwise("")})
    more = pair_metrics(more, "_ref", "_hyp", collapsed=True)
    both = more.withColumns({f"markup_excluded_{e}": F.when(F.col("had_tag"), F.col(e)).otherwise(F.col(f"configured_{e}")) for e in ("char_edits", "word_edits")})
    rate = lambda m, e, t: F.sum(f"{m}_{e}") / F.sum(f"configured_{t}")
    out = both.withColumn("f", tx.markup_failures("markup")).groupBy("system").agg(
        F.count("*").alias("lines"),
        F.sum((F.length("s.fragment") > 0).cast("long")).alias("lines_with_partial_tag"),
        F.sum(F.length("s.fragment")).alias("partial_tag_chars"),
        F.sum(F.col("truncated").cast("long")).alias("truncated_lines"),
        F.sum(F.when(F.col("markup").isNotNull(), F.col("f.unbalanced").cast("long"))).alias("lines_unbalanced_element_tags"),
        F.sum(F.when(F.col("markup").isNotNull(), F.col("f.malformed").cast("long"))).alias("lines_malformed_locations"),
        *(rate(m, e, t).alias(f"{m}_{r}") for m in ("configured", "markup_excluded") for r, e, t in (("cer", "char_edits", "ref_chars"), ("wer", "word_edits", "ref_words"))),
    )
    return out.withColumns({f"{m}_change": F.col(f"markup_excluded_{m}") - F.col(f"configured_{m}") for m in ("cer", "wer")})


def observed_counts(pages: DataFrame, markup: str = "markup", key: str = "page_id", tags: tuple[str, ...] = tx.ELEMENT_TAGS) -> DataFrame:
    """(key, element_type, observed_count) of the opened element tags of each page."""
    names = F.regexp_extract_all(F.col(markup), F.lit("<([a-z_]+(?:_[0-9]+)?)>"), F.lit(1))
    found = pages.select(key, F.explode(names).alias("element_type")).where(F.col("element_type").isin(*tags))
    return found.groupBy(key, "element_type").agg(F.count("*").alias("observed_count"))


def structure_rows(expected: DataFrame, observed: DataFrame, key: str = "page_id") -> DataFrame:
    """Expected (key, element_type, expected_count) against observed counts; types without an expectation are not scored."""
    both = expected.join(observed, [key, "element_type"], "full_outer").withColumn("scored", F.col("expected_count").isNotNull())
    both = both.withColumn("observed_count", F.coalesce("observed_count", F.lit(0)))
    error = F.when(F.col("scored"), F.abs(F.col("expected_count") - F.col("observed_count")))
    return both.select(key, "element_type", "scored", "expected_count", "observed_count", error.alias("absolute_count_error"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Scored pages (page_id, model, reference, hypothesis, ...) with error rates and token overlap."""
    keyed = pages.withColumn("_k", F.struct("page_id", "model"))
    overlap = token_overlap(keyed, "_k")
    return pair_metrics(keyed).join(overlap, "_k").drop("_k")


def page_means(rows: DataFrame) -> DataFrame:
    """A model's mean rates, truncated pages and, where rows have n_table_cells and n_table_rows, their totals."""
    totals = [F.sum(F.col(c).cast("long")).alias(c) for c in ("n_table_cells", "n_table_rows") if c in rows.columns]
    return rows.groupBy("model").agg(F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"), F.sum(F.col("truncated").cast("long")).alias("truncated"), *totals)


def resources(runs: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """runs (model, seconds, and what else was recorded, such as peak memory) with seconds a line, mean page latency; null where nothing was run."""
    n = lines.groupBy("model").agg(F.count("*").alias("_n"))
    p = pages.groupBy("model").agg(F.avg("inference_seconds").alias("mean_page_latency_s"))
    out = runs.join(n, "model", "left").join(p, "model", "left")
    return out.withColumn("mean_line_latency_s", F.col("seconds") / F.col("_n")).drop("_n")


def word_stretches(pairs: DataFrame, texts: bool = True) -> DataFrame:
    """pairs (reference, hypothesis, ...) with r, h (their words) and ops: equal and other stretches, first to last; texts or without them.

    Blocks are the longest matching ones, case kept. Whole batches of pairs go to Python as lists of words; one pair is
    one task's, whose time grows with the product of its lengths.
    """
    split = pairs.withColumns({"r": F.coalesce(tx.words("reference", lower=False), F.array().cast("array<string>")), "h": F.coalesce(tx.words("hypothesis", lower=False), F.array().cast("array<string>"))})
    both = split if texts else split.drop("reference", "hypothesis")
    kind = T.StructType([*both.schema.fields, T.StructField("ops", T.ArrayType(T.StructType.fromDDL(udf.OPS)))])
    return both.mapInArrow(udf.matched, kind)


def word_diff(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """pairs, one row for each of the first word differences (place, op, words of either side)."""
    keep = [c for c in pairs.columns if c not in ("reference", "hypothesis")]
    found = word_stretches(pairs, texts=False)
    unequal = F.slice(F.filter("ops", lambda o: o.op != "equal"), 1, limit)
    rows = found.select(*keep, "r", "h", F.posexplode(unequal).alias("place", "o"))
    said = lambda words, a, b: F.array_join(F.slice(words, F.col(a) + 1, F.col(b) - F.col(a)), " ")
    return rows.select(*keep, "place", "o.op", said("r", "o.r0", "o.r1").alias("reference_words"), said("h", "o.h0", "o.h1").alias("hypothesis_words"))
