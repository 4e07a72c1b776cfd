"""Filter interaction audit: documents weigh the edges of the lattice of filter subsets; every order of the filters is a path in it."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import _io

#: The filters by letter; a set of them is a number with bit i for the i-th letter.
FILTERS = "ABCDE"
#: What the filters compare with.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 2, "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The set of the filters A to D that a text fails; E needs the other documents (see repeats())."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = (
        n < LEAST_WORDS,
        100 * different < DISTINCT_PERCENT * n,
        100 * capitals > CAPITAL_PERCENT * F.length(text),
        text.rlike(SIGNS),
    )
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def profiles(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, failed, good, toxic, n): how many documents fail each set of filters, by part and label.

    Texts stay where they are read: what is shuffled of a document is its id and a digest. The first
    of equal texts comes from minima with map-side aggregation, and meets its document by id and digest, so
    no group of copies is gathered anywhere.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = _io.cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
            failures(text).alias("failed"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        )
    )
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("is_first", F.lit(True))
    marked = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marked = marked.where("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = rows.where("id is not null").join(first, ["id", "digest"], "left").join(marked, "id", "left")
    repeated = F.when(F.col("is_first"), 0).otherwise(1 << FILTERS.index("E"))
    no = F.lit(False)
    named = known.select("part", (F.col("failed") + repeated).alias("failed"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    unnamed = rows.where("id is null").select("part", "failed", no.alias("good"), no.alias("toxic"))
    return named.unionByName(unnamed).groupBy("part", "failed", "good", "toxic").agg(F.count("*").alias("n"))


def lattice() -> list[tuple[int, int]]:
    """(applied, filter): the 80 edges of the lattice, each a set of filters already applied and the next one."""
    sets = [sum(1 << i for i in c) for k in range(len(FILTERS)) for c in combinations(range(len(FILTERS)), k)]
    return [(s, i) for s in sets for i in range(len(FILTERS)) if not s >> i & 1]


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, applied, filter): the 600 steps of the 120 orders, each along one edge."""
    out = []
    for order in permutations(range(len(FILTERS))):
        applied = 0
        for k, i in enumerate(order, 1):
            out.append(("".join(FILTERS[j] for j in order), k, applied, i))
            applied |= 1 << i
    return spark.createDataFrame(out, "filter_order string, step int, applied int, filter int")


def edges(counted: DataFrame) -> DataFrame:
    """profiles() -> (part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of each edge."""
    fails = F.getbit("failed", F.col("filter")) == 1
    clean = F.col("failed").bitwiseAND(F.col("applied")) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    sums = {
        "kept": clean & ~fails,
        "removed": clean & fails,
        "redundant": fails & ~clean,
        "unique_fails": F.expr("failed = shiftleft(1, filter)"),
        "good_lost": clean & fails & F.col("good"),
        "toxic_lost": clean & fails & F.col("toxic"),
    }
    each = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(i).alias("filter")) for s, i in lattice()))
    crossed = counted.select("*", F.inline(each))
    return crossed.groupBy("part", "applied", "filter").agg(*(total(c).alias(k) for k, c in sums.items()))


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part, order and step.

    Of a document's 80 edges only the sums by part are built, from at most 128 profiles a part; the
    600 steps then look their edge up. shapley is a filter's removed over all its steps in a part.

    Null texts count as empty, null parts as the empty string; very long texts are read whole. Rows
    repeated with their id each count, and are no repeats of each other (E wants a smaller id). Rows
    without an id fail E never, make no other fail it and have no labels. A document with several labels has a
    quality or toxicity that any of them gives. Other columns may have any names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    weighed = edges(profiles(docs, labels, id_col, text_col, part_col))
    walked = weighed.join(F.broadcast(steps(spark)), ["applied", "filter"])  # 600 rows
    paths = walked.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    out = walked.join(paths, ["part", "filter"])
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return out.select("part", "filter_order", "step", *counts)


#: The same in DuckDB: every order applied to every document.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(words) < 200,
    'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > first_id, false)} AS x
  FROM w LEFT JOIN l USING (doc_id)
), g AS (
  SELECT part, good, toxic, concat(CASE WHEN x.A THEN 'A' ELSE '' END, CASE WHEN x.B THEN 'B' ELSE '' END, CASE WHEN x.C THEN 'C' ELSE '' END,
    CASE WHEN x.D THEN 'D' ELSE '' END, CASE WHEN x.E THEN 'E' ELSE '' END) AS failed, count(*) AS n
  FROM f GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), met AS (
  SELECT *, contains(failed, letter) AS fails, translate(failed, before, '') <> failed AS gone FROM g, steps
), counted AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE failed = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE NOT gone AND fails AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (WHERE NOT gone AND fails AND toxic), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
