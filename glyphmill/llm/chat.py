"""Chat logs as training text: snapshots that a longer conversation contains are collapsed, the rest rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import _io

#: Turn numbers of one window of a conversation; longer ones are numbered and summed window by window.
STRETCH = 256
#: What stands around a turn (fixed values of the public ChatML layout).
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _running(turns: DataFrame) -> DataFrame:
    """(conv, stretch, pos, role, text, r1, r2): turns with their place (1, 2, ...) and hash sums within their stretch.

    A stretch is a run of turn numbers, so that a conversation of any length is spread over
    tasks: its rows are counted first, then numbered and summed where they lie. A turn's hashes
    take its place in, so sums name a prefix in order; decimals of 64-bit hashes never overflow.
    """
    part = turns.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit((1 << 62) // STRETCH)))
    totals = part.groupBy("conv", "stretch").agg(F.count("*").alias("rows"))
    before = totals.select(
        F.col("conv").alias("c_"),
        F.col("stretch").alias("s_"),
        (F.sum("rows").over(Window.partitionBy("conv").orderBy("stretch")) - F.col("rows")).alias("rows_before"),
    )
    joined = part.join(before, (F.col("conv") == F.col("c_")) & (F.col("stretch") == F.col("s_")))
    order = Window.partitionBy("conv", "stretch").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = joined.withColumn("pos", F.row_number().over(order) + F.col("rows_before"))
    name = lambda seed: F.xxhash64(F.lit(seed), "pos", "role", "text").cast("decimal(20,0)")
    hashed = numbered.withColumns({"h1": name(1), "h2": name(2)})
    run = Window.partitionBy("conv", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"r{i}": F.sum(f"h{i}").over(run).cast("decimal(38,0)") for i in (1, 2)}
    return hashed.withColumns(sums).select("conv", "stretch", "pos", "role", "text", "r1", "r2")


def prefixes(running: DataFrame) -> DataFrame:
    """(conv, pos, k1, k2) of _running() rows: k1, k2 name the turns 1 .. pos of the conversation, in order; no texts."""
    rows = running.select("conv", "stretch", "pos", "r1", "r2")
    last = rows.groupBy("conv", "stretch").agg(F.max_by(F.struct("r1", "r2"), "pos").alias("t"))
    over = Window.partitionBy("conv").orderBy("stretch")
    before = last.select(
        F.col("conv").alias("c_"),
        F.col("stretch").alias("s_"),
        *((F.sum(f"t.r{i}").over(over) - F.col(f"t.r{i}")).cast("decimal(38,0)").alias(f"b{i}") for i in (1, 2)),
    )
    joined = rows.join(before, (F.col("conv") == F.col("c_")) & (F.col("stretch") == F.col("s_")))
    return joined.select("conv", "pos", *((F.col(f"b{i}") + F.col(f"r{i}")).cast("decimal(38,0)").alias(f"k{i}") for i in (1, 2)))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, pos, role, text, n_turns) of the conversations that no other continues; of equal ones the smallest id stays."""
    running = _io.cut(_running(turns))
    named = _io.cut(prefixes(running))
    ends = named.groupBy("conv").agg(F.max("pos").alias("n"), F.max_by(F.struct("k1", "k2"), "pos").alias("k"))
    ends = _io.cut(ends.select("conv", "n", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2")))
    # A snapshot is gone if its whole is a proper prefix of another, or another of the same turns has a smaller id.
    whole = ends.select(F.col("conv").alias("c_"), "n")
    proper = named.join(whole, (F.col("conv") == F.col("c_")) & (F.col("pos") < F.col("n")))
    proper = proper.select(F.col("pos").alias("p_"), F.col("k1").alias("p1"), F.col("k2").alias("p2")).distinct()
    first = ends.groupBy("n", "k1", "k2").agg(F.min("conv").alias("conv"))
    alive = first.join(proper, (F.col("n") == F.col("p_")) & (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")), "left_anti")
    alive = alive.select(F.col("conv").alias("kept"), F.col("n").alias("n_turns"))
    return running.join(alive, running["conv"] == alive["kept"]).select("conv", "pos", "role", "text", "n_turns")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, text): every maximal conversation, rendered turn by turn in order.

    A conversation whose turns are the first turns of a longer one is a snapshot of it and goes,
    as do all but the smallest id of equal conversations. Turns are ordered by number, then role,
    then text; null numbers come last. Null roles and texts count as empty, repeated rows as
    turns of their own. Rows without a conversation id are left out. Very long texts are rendered whole; other columns are
    not read, whatever their names. An empty table gives an empty result. A rendered conversation is one value, as long as its turns together.
    """
    picked = turns.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv is not null")
    line = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE))
    rows = maximal(picked).select("conv", "n_turns", F.struct("pos", line.alias("line")).alias("part"))
    done = rows.groupBy("conv").agg(F.max("n_turns").alias("n_turns"), F.array_sort(F.collect_list("part")).alias("parts"))
    return done.select(
        F.col("conv").alias("conv_id"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.array_join(F.col("parts.line"), "").alias("text"),
    )


#: The same in DuckDB: lists compared outright.
ORACLE = """
WITH c AS (
  SELECT conv_id, count(*) AS n,
         list(coalesce(role, '') || chr(10) || coalesce(text, '') ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS parts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), p AS (
  SELECT conv_id, n, i, sha256(array_to_string(parts[1:i], chr(1))) AS mark
  FROM (SELECT conv_id, n, parts, unnest(range(1, n + 1)) AS i FROM c)
), whole AS (SELECT conv_id, n, mark FROM p WHERE i = n
), proper AS (SELECT DISTINCT i, mark FROM p WHERE i < n
), kept AS (
  SELECT min(conv_id) AS conv_id FROM whole
  WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.i = whole.n AND proper.mark = whole.mark)
  GROUP BY n, mark
)
SELECT conv_id, n AS n_turns,
       array_to_string(list_transform(parts, lambda x: '<|im_start|>' || x || '<|im_end|>' || chr(10)), '') AS text
FROM c WHERE conv_id IN (SELECT conv_id FROM kept)
"""
