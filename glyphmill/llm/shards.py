"""Shards of near-equal bytes by a k-d tree over document metadata, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import _io

#: Buckets of a dimension; bits of a histogram digit within a bucket; digits of the text hash and the id hash.
BUCKETS, BITS, TEXT_DIGITS, ID_DIGITS = 256, 12, 3, 2
#: A cut may miss its weighted median by this share of one shard's bytes, so that equal texts stay together.
TOLERANCE = 0.015
#: Rows that one task numbers.
NUMBERED = 65536


def _of(values: dict[int, float], count: int, kind: str) -> Column:
    """The value of each row's node (named by its first shard), zero for others; one constant array."""
    return F.element_at(F.lit([values.get(i, 0) for i in range(count)]).cast(f"array<{kind}>"), F.col("first") + 1)


def _split(points: DataFrame, nodes: dict[int, int], count: int, n_dims: int, slack: float) -> Column:
    """Split nodes (first shard -> shards) at weighted medians along their widest dimensions.

    Returns the expression for each row's node one level down. All nodes share each job; the
    place of a cut is found in the cluster, and a row for each node comes to the driver.
    """
    rows = points.where(_of({k: 1 for k in nodes}, count, "int") == 1)
    spans = rows.groupBy("first").agg(F.sum("size").alias("w"), *(f(f"d{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))))
    dim, want = {}, {}
    for r in spans.collect():
        dim[r["first"]] = max(range(n_dims), key=lambda i: r[f"hi{i}"] - r[f"lo{i}"])
        want[r["first"]] = r.w * (nodes[r["first"]] // 2) / nodes[r["first"]]
    code = F.element_at(F.array(*(F.col(f"d{i}") for i in range(n_dims))), _of(dim, count, "int") + 1).cast("long")
    low_bits = (1 << BITS) - 1
    shifts = [("t", BITS * i) for i in reversed(range(TEXT_DIGITS))] + [("h", BITS * i) for i in reversed(range(ID_DIGITS))]
    digits = [code, *(F.shiftright(F.col(c), s).bitwiseAND(low_bits) for c, s in shifts)]
    prefix: dict[int, list[int]] = {k: [] for k in want}
    todo = set(want)
    for at, digit in enumerate(digits):
        if not todo:
            break
        here = _of({k: 1 for k in todo}, count, "int") == 1
        for j in range(at):
            here = here & (digits[j] == _of({k: prefix[k][j] for k in todo}, count, "long"))
        cells = rows.where(here).groupBy("first", digit.alias("cell")).agg(F.sum("size").alias("w"))
        place = _of({k: want[k] for k in todo}, count, "double")
        upto = F.sum("w").over(Window.partitionBy("first").orderBy("cell"))
        hit = cells.withColumn("upto", upto).where((F.col("upto") > place) & (F.col("upto") - F.col("w") <= place))
        for r in hit.collect():
            k = r["first"]
            before, after = want[k] - (r.upto - r.w), r.upto - want[k]
            if min(before, after) <= slack or at == len(digits) - 1:
                prefix[k].append(r.cell + (0 if before <= after else 1))
                todo.discard(k)
            else:
                prefix[k].append(r.cell)
                want[k] = before
    joined = lambda which: {k: sum(x << s for x, (c, s) in zip(p[1:], shifts) if c == which) for k, p in prefix.items()}
    cut = [_of({k: p[0] for k, p in prefix.items()}, count, "long"), _of(joined("t"), count, "long"), _of(joined("h"), count, "long")]
    t, h = F.col("t"), F.col("h")
    below = (code < cut[0]) | ((code == cut[0]) & ((t < cut[1]) | ((t == cut[1]) & (h < cut[2]))))
    return F.col("first") + F.when(below, 0).otherwise(_of({k: n // 2 for k, n in nodes.items()}, count, "int"))


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each row's doc_id, size, text_crc32, law, shard, slot and grown_shard.

    Give the number of shards or their target bytes. A node of the tree is split at its weighted
    median along the dimension of widest range (log of bytes, bytes a character, lines), all in
    256 buckets of the table's range; ties are ordered by text hash, then by id hash, so equal
    texts stay together unless a cut would miss by over TOLERANCE of a shard. size is the text's
    UTF-8 bytes plus 16; a null text has no bytes and checksum zero. slot counts the rows of a
    shard from 0 without gaps. Repeated rows and null ids are rows like any other. Very long texts
    are measured whole; other columns are not read. An empty table gives an empty result. law is always `bytes`.
    """
    _io.small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mask = lambda c, bits: F.shiftrightunsigned(c, 64 - bits)
    n_bytes, n_chars = F.octet_length("x"), F.char_length("x")
    raw = docs.select(F.col(id_col).alias("doc_id"), text.alias("x"))
    raw = raw.select(
        "doc_id",
        (n_bytes + 16).cast("long").alias("size"),
        F.crc32("x").alias("text_crc32"),
        F.log2(n_bytes + 16).alias("m0"),
        (n_bytes / F.greatest(n_chars, F.lit(1))).alias("m1"),
        F.log2(n_chars - F.char_length(F.translate("x", "\n", "")) + 1).alias("m2"),
        mask(F.xxhash64("x"), BITS * TEXT_DIGITS).alias("t"),
        mask(F.xxhash64(F.lit("id"), "doc_id"), BITS * ID_DIGITS).alias("h"),
    )
    n_dims = 3
    raw = _io.cut(raw)
    ends = raw.agg(F.sum("size").alias("w"), F.count("*").alias("n"), *(f(f"m{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    total = ends.w or 0
    count = shards or max(1, -(-total // (target_bytes or total or 1)))
    codes = []
    for i in range(n_dims):
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        code = F.floor((F.col(f"m{i}") - lo) / ((hi - lo) or 1.0) * (BUCKETS - 1)).cast("int")
        codes.append(code.alias(f"d{i}"))
    points = raw.select("doc_id", "size", "text_crc32", *codes, "t", "h")
    points = points.withColumn("first", F.lit(0))
    level = {0: count} if count > 1 and total else {}
    while level:
        deeper = _io.cut(points.withColumn("first", _split(points, level, count, n_dims, TOLERANCE * total / count)))
        _io.drop(points) if hasattr(points, "_scratch") else None
        points = deeper
        halves = [x for k, n in level.items() for x in ((k, n // 2), (k + n // 2, n - n // 2))]
        level = {k: n for k, n in halves if n > 1}
    subs = max(8, -(-ends.n // (count * NUMBERED)))
    placed = points.select("doc_id", "size", "text_crc32", "h", F.col("first").alias("shard"), F.pmod("h", F.lit(subs)).cast("int").alias("sub"))
    starts = placed.groupBy("shard", "sub").agg(F.count("*").alias("rows"))
    starts = starts.select(F.col("shard").alias("s_"), F.col("sub").alias("u_"), (F.sum("rows").over(Window.partitionBy("shard").orderBy("sub")) - F.col("rows")).alias("start"))
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("shard", "sub").orderBy("h", "doc_id")))
    joined = numbered.join(_io.sized(starts, count * subs * 24), (F.col("shard") == F.col("s_")) & (F.col("sub") == F.col("u_")))
    return joined.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
