"""License scans: an exact set-similarity join of text blocks with license templates by prefix, length and position."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import _io, _vec


class Template(NamedTuple):
    """A notice by its words; a block must hold the key words too before it has the label."""

    name: str
    label: str
    key: str
    text: str


#: Phrases that name a license where their words stand consecutively.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public notices of common licenses, in the words of their publishers.
TEMPLATES = (
    Template("apache-notice", "apache", "apache", "licensed under the apache license version 2 0"),
    Template(
        "apache-header", "apache", "license compliance",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    Template("gpl-notice", "gpl", "gnu general", "this work is licensed under the gnu general public license version 3"),
    Template(
        "gpl-header", "gpl", "gnu general",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation",
    ),
    Template(
        "lgpl-header", "lgpl", "lesser",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"
        " as published by the free software foundation",
    ),
    Template(
        "agpl-header", "agpl", "affero",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"
        " as published by the free software foundation",
    ),
    Template("mit-notice", "mit", "mit", "released under the mit license"),
    Template(
        "mit-grant", "mit", "granted software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " to deal in the software without restriction",
    ),
    Template(
        "bsd-conditions", "bsd", "redistribution",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    Template(
        "isc-grant", "isc", "permission software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    Template("mpl-header", "mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    Template("cc-by-notice", "cc-by", "creative attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc-notice", "cc-by-nc", "cc nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa-notice", "cc-by-sa", "cc sa", "licensed under cc by sa 4 0"),
)
#: Share of a template's different words that a block must hold.
CONTAINMENT = 0.8
#: Words from one block to the next, by length class of the templates; a block has twice as many, so that every
#: stretch of as many words lies whole in one.
STRIDES = (8, 16, 32, 64)


def text_words(buf: np.ndarray, off: np.ndarray):
    """Hashes of the words (letters a-z after lower-casing A-Z, digits, all non-ASCII) and the texts' offsets among them."""
    _, _, hashes, at = _vec.words(buf, off, fold=_vec.lower_ascii)
    return hashes, at


def word_hashes(words: Sequence[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    off = np.cumsum([0, *map(len, data)])
    return text_words(np.frombuffer(b"".join(data), np.uint8), off)[0]


class Index(NamedTuple):
    """Templates over a global order of words (rarest first): what tasks need of them."""

    vocabulary: np.ndarray  # sorted word hashes
    rank: np.ndarray  # their ranks
    rows: list  # (template, label, stride, tokens by rank, key ranks, least overlap, length of the prefix)


def stride_of(n_words: int) -> int:
    return next((s for s in STRIDES if s >= n_words), 1 << (n_words - 1).bit_length())


def index(templates: Sequence[Template], counts: dict[int, int], containment: float) -> Index:
    """counts are a word hash's occurrences in the corpus (as signed numbers); unseen words are the rarest."""
    words = sorted({w for t in templates for w in t.text.split()})
    hashes = word_hashes(words) if words else np.zeros(0, np.uint64)
    by_count = sorted(range(len(words)), key=lambda i: (counts.get(int(hashes[i : i + 1].view(np.int64)[0]), 0), words[i]))
    rank = {words[i]: r for r, i in enumerate(by_count)}
    rows = []
    for t in templates:
        tokens = sorted({rank[w] for w in t.text.split()})
        least = math.ceil(round(containment * len(tokens), 9))
        rows.append((t.name, t.label, stride_of(len(t.text.split())), tokens, sorted(rank[w] for w in t.key.split()), least, len(tokens) - least + 1))
    at = np.argsort(hashes)
    return Index(hashes[at], np.array([rank[words[i]] for i in at], np.int32), rows)


def occurrences(docs: DataFrame, templates: Sequence[Template]) -> dict[int, int]:
    """How often each word of the templates occurs in all texts, by its hash: a row a word, however large the corpus."""
    known = np.sort(word_hashes(sorted({w for t in templates for w in t.text.split()})))

    def count(batches):
        n = np.zeros(len(known), np.int64)
        for b in batches:
            for _, buf, off in _vec.pieces(b.column(0)):
                h, _ = text_words(buf, off)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                n += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n)], ["h", "n"])

    return {r.h: r.n for r in docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()}


def blocks_of(hashes: np.ndarray, at: np.ndarray, known: Index):
    """(text, stride, block, ranks) of the blocks that a template's prefix and least overlap let through, texts by offsets `at`."""
    slot = np.minimum(np.searchsorted(known.vocabulary, hashes), len(known.vocabulary) - 1)
    place = np.flatnonzero(known.vocabulary[slot] == hashes)
    rank = known.rank[slot[place]].astype(np.int64)
    owner = np.searchsorted(at, place, "right") - 1
    n, pos = np.diff(at), place - at[owner]
    for stride in sorted({r[2] for r in known.rows}):
        mine = [r for r in known.rows if r[2] == stride]
        starts = np.unique([x for r in mine for x in r[3][: r[6]]])
        last = np.maximum(-(-n // stride) - 2, 0)[owner]
        key = []
        for back in (0, 1):
            k = pos // stride - back
            ok = (k >= 0) & (k <= last)
            key.append(np.where(ok, owner << 32 | np.maximum(k, 0), -1))
        block, ranks = np.concatenate(key), np.concatenate([rank, rank])
        block, ranks = block[block >= 0], ranks[block >= 0]
        wanted = np.unique(block[np.isin(ranks, starts)])
        if not len(wanted):
            continue
        near = np.minimum(np.searchsorted(wanted, block), len(wanted) - 1)
        keep = wanted[near] == block
        both = np.unique(np.stack([block[keep], ranks[keep]]), axis=1)
        edge = np.flatnonzero(np.r_[True, both[0, 1:] != both[0, :-1]])
        size = np.diff(np.r_[edge, both.shape[1]])
        for s, m in zip(edge[size >= min(r[5] for r in mine)].tolist(), size[size >= min(r[5] for r in mine)].tolist()):
            yield int(both[0, s]) >> 32, stride, int(both[0, s]) & 0xFFFFFFFF, both[1, s : s + m].astype(np.int32)


def phrase_places(hashes: np.ndarray, at: np.ndarray, phrases: Sequence[str]):
    """(phrase number, text, word place) of all places where a phrase's words stand in a row."""
    for p, phrase in enumerate(phrases):
        want = word_hashes(phrase.split())
        m = len(hashes) - len(want) + 1
        if m <= 0:
            continue
        same = hashes[:m] == want[0]
        for j in range(1, len(want)):
            same &= hashes[j : j + m] == want[j]
        place = np.flatnonzero(same)
        owner = np.searchsorted(at, place, "right") - 1
        whole = place + len(want) <= at[owner + 1]
        yield p, owner[whole], (place - at[owner])[whole]


_ROW = "n_words long, n_base long, first_word long, last_word long, base array<int>, blocks array<struct<stride: int, block: int, ranks: array<int>>>"
_BLOCK = pa.struct([("stride", pa.int32()), ("block", pa.int32()), ("ranks", pa.list_(pa.int32()))])


def _scan(known: Index, phrases: Sequence[str]):
    """Rows (id, mark, text) -> (id, mark, base phrases, blocks worth a look)."""

    def run(batches):
        for b in batches:
            for at, buf, off in _vec.pieces(b.column(2)):
                hashes, woff = text_words(buf, off)
                n = len(off) - 1
                count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[list[int]] = [[] for _ in range(n)]
                for p, owner, place in phrase_places(hashes, woff, phrases):
                    np.add.at(count, owner, 1)
                    np.minimum.at(first, owner, place)
                    np.maximum.at(last, owner, place)
                    for o in np.unique(owner).tolist():
                        base[o].append(p)
                blocks: list[list[dict]] = [[] for _ in range(n)]
                for o, stride, k, ranks in blocks_of(hashes, woff, known):
                    blocks[o].append({"stride": stride, "block": k, "ranks": ranks})
                none = last < 0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(np.diff(woff)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none),
                        pa.array(base, pa.list_(pa.int32())), pa.array(blocks, pa.list_(_BLOCK)),
                    ],
                    ["id", "mark", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
                )

    return run


def _matches(rows: DataFrame, known: Index) -> DataFrame:
    """rows (id, mark, blocks) joined with the templates: (id, mark, template, label, keyed, word, words, containment).

    An index of the templates' prefixes meets the blocks' words in a broadcast join (a row a prefix word of
    the given templates). A pair is taken at its first common prefix word only, then by length and place of
    that word, and verified by the overlap itself. Nothing is shuffled.
    """
    spark = rows.sparkSession
    entries = [
        (stride, tokens[i], i, name, label, tokens, key, least) for name, label, stride, tokens, key, least, prefix in known.rows for i in range(prefix)
    ]
    prefixes = spark.createDataFrame(entries, "stride int, token int, i int, template string, label string, tokens array<int>, keys array<int>, least int")
    blocks = rows.select("id", "mark", F.explode("blocks").alias("b")).select("id", "mark", "b.*")
    words = blocks.select("*", F.posexplode("ranks").alias("j", "token"))
    met = words.join(F.broadcast(prefixes), ["stride", "token"])
    first = F.size(F.array_intersect("ranks", F.slice("tokens", 1, F.col("i")))) == 0
    length = F.size("ranks") >= F.col("least")
    room = F.least(F.size("tokens") - F.col("i"), F.size("ranks") - F.col("j")) >= F.col("least")
    same = F.size(F.array_intersect("ranks", "tokens"))
    found = met.where(length & room & first).withColumn("same", same).where(F.col("same") >= F.col("least"))
    keyed = F.size(F.array_intersect("ranks", "keys")) == F.size("keys")
    return found.select(
        "id", "mark", "template", "label", keyed.alias("keyed"), (F.col("block").cast("long") * F.col("stride")).alias("word"),
        (2 * F.col("stride")).alias("words"), (F.col("same") / F.size("tokens")).alias("containment"),
    )


def _rows(docs: DataFrame, templates: Sequence[Template], containment: float, id_col: str, text_col: str, phrases: Sequence[str]) -> tuple[DataFrame, Index]:
    if not templates or not 0 < containment <= 1:
        raise ValueError("there must be templates, and a containment over 0 and up to 1")
    _io.small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("mark"), text.alias("text"))
    known = index(templates, occurrences(texts.select("text"), templates), containment)
    kind = docs.schema[id_col].dataType.simpleString()
    return _io.cut(texts.mapInArrow(_scan(known, phrases), f"id {kind}, mark string, {_ROW}")), known


def matching_blocks(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, template, label, keyed, word, words, containment) of every block that holds that share of a template's words.

    Blocks are stretches of words of each text, from `word` on, `words` long (the text's end may come before), of twice
    the templates' length class and half as far apart. keyed: whether the template's key words are all among
    them. Templates are a driver-side list of bounded size. Texts as in licenses().
    """
    rows, known = _rows(docs, templates, containment, id_col, text_col, [])
    return _matches(rows, known).drop("mark").withColumnRenamed("id", "doc_id")


def licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, templates) of every document.

    Base labels are of phrases that stand there word by word; labels has those of templates too, whose blocks hold
    the containment and the key words. score is 1 with a base phrase, else the best containment of a labelled
    block, else 0. Null and empty texts have no words; very long ones are read whole; rows of one id are each
    answered by their own text; rows without an id as well; other columns may have any names. An empty
    table gives an empty result. Words are compared by 64-bit hashes.
    """
    rows, known = _rows(docs, templates, containment, id_col, text_col, list(PHRASES))
    met = _matches(rows, known).where("keyed").groupBy("id", "mark").agg(
        F.collect_set("label").alias("more"), F.collect_set("template").alias("met"), F.max("containment").alias("best")
    )
    met = _io.cut(met.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "more", "met", "best"))
    size = met.count() * 256
    out = rows.drop("blocks").join(_io.sized(met, size), F.col("mark").eqNullSafe(F.col("_mark")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    names = F.array(*(F.lit(x) for x in PHRASES.values()))
    own = F.transform("base", lambda p: F.get(names, p))
    none = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", joined(own).alias("base_labels"),
        joined(F.concat(own, F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.array_join(F.array_sort(F.coalesce("met", none)), ",").alias("templates"),
    )


def oracle() -> str:
    """DuckDB SQL of licenses() over documents: every block held against every template."""
    quoted = ", ".join(f"('{t.name}', '{t.label}', '{t.key}', '{t.text}', {stride_of(len(t.text.split()))})" for t in TEMPLATES)
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), phrases AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) v(p, label)
), templates AS (
  SELECT name, label, list_distinct(string_split(text, ' ')) AS t, string_split(key, ' ') AS k, stride FROM (VALUES {quoted}) v(name, label, key, text, stride)
), base AS (
  SELECT r, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p)) AS place FROM d, phrases
  WHERE len(list_intersect(w, p)) = len(p)
), based AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS own FROM base GROUP BY r
), near AS (
  SELECT r, w, name, label, t, k, stride FROM d, templates WHERE len(list_intersect(w, t)) >= ceil(round({CONTAINMENT} * len(t), 9)) AND len(list_intersect(w, k)) = len(k)
), blocks AS (
  SELECT r, name, label, t, k, w[b * stride + 1:(b + 2) * stride] AS w
  FROM (SELECT *, unnest(range(0, greatest((len(w) + stride - 1) // stride - 2, 0) + 1)) AS b FROM near)
), met AS (
  SELECT r, list(DISTINCT label) AS more, list(DISTINCT name) AS met, max(len(list_intersect(list_distinct(w), t)) / len(t)) AS best FROM blocks
  WHERE len(list_intersect(list_distinct(w), t)) >= ceil(round({CONTAINMENT} * len(t), 9)) AND len(list_intersect(list_distinct(w), k)) = len(k) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score,
  array_to_string(list_sort(coalesce(met, [])), ',') AS templates
FROM d LEFT JOIN based USING (r) LEFT JOIN met USING (r)
"""


ORACLE = oracle()
