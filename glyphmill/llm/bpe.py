"""Byte-level BPE by dynamic programming over prefixes, checked against no library at run time."""

from __future__ import annotations

import functools
import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import _io

#: The public pattern that splits a text before byte-level merges (a fixed value of the vocabulary file).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Different pieces whose encoding a worker keeps; bounds its memory, never its results.
KEPT = 300_000


class Encoder:
    """Encodes and decodes with one vocabulary file of the tokenizers library.

    Every prefix of a piece has exactly one last token under BPE. A vocabulary automaton with
    suffix links lists all tokens that end at each place; the right one is the token whose pair
    with the last token of the prefix before it is one that the merges leave standing. Following
    the last tokens back from the end gives the encoding.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [c for r in ((33, 127), (161, 173), (174, 256)) for c in range(*r)]
        hidden = [c for c in range(256) if c not in set(shown)]
        raw = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}
        plain = lambda token: bytes(raw[c] for c in token)
        self.ids = {plain(t).decode("latin-1"): i for t, i in spec["model"]["vocab"].items()}
        self.bytes = {i: t.encode("latin-1") for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            x, y = (plain(t).decode("latin-1") for t in (m.split(" ") if isinstance(m, str) else m))
            a, b, whole = self.ids[x], self.ids[y], self.ids[x + y]
            self.rank.setdefault((a, b), r)
            self.parts.setdefault(whole, (a, b, r))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.pairs: dict[int, bool] = {}
        self.find = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if self._stands(i):
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.kept: dict[str, tuple[str, int, bytes]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token, each with the rank of the merge that swallows it."""
        out, until = [], 1 << 60
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, token = self.parts[token][2], self.parts[token][side]

    def _apart(self, a: int, b: int, own: int = -1) -> bool:
        """No merge joins pieces across the border of a and b while both stand (but the one of rank own)."""
        right = self._spine(b, 0)
        for x, dx in self._spine(a, 1):
            for y, dy in right:
                r = self.rank.get((x, y))
                if r is not None and r != own and r < dx and r <= dy and (own < 0 or r < own):
                    return False
        return True

    def _stands(self, token: int) -> bool:
        """A token that encodes to itself."""
        if token not in self.parts:
            return True
        a, b, r = self.parts[token]
        return self._apart(a, b, r)

    def piece(self, text: str) -> list[int]:
        s = text.encode().decode("latin-1")
        last: list[int] = [-1] * len(s)
        pairs = self.pairs
        for end, (token, n) in self.automaton.iter(s):
            if last[end] >= 0:
                continue
            before = end - n
            if before < 0:
                last[end] = token
            elif (p := last[before]) >= 0:
                key = p << 20 | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) > 2_000_000:
                        pairs.clear()
                    ok = pairs[key] = self._apart(p, token)
                if ok:
                    last[end] = token
        out, at = [], len(s) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(self.bytes[last[at]])
        return out[::-1]

    def parts_of(self, text: str) -> list[tuple[str, int, bytes]]:
        """(ids as text, their number, their bytes decoded from the ids) of each piece."""
        out = []
        kept = self.kept
        for i, run in enumerate(self.cut(text) if self.cut else [text]):
            if i % 2:
                out.append((str(self.special[run]), 1, self.bytes[self.special[run]]))
                continue
            for w in self.find(run):
                got = kept.get(w)
                if got is None:
                    ids = self.piece(w)
                    if len(kept) >= KEPT:
                        kept.clear()
                    got = kept[w] = (",".join(map(str, ids)), len(ids), b"".join([self.bytes[t] for t in ids]))
                out.append(got)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids, _, _ in self.parts_of(text) for x in ids.split(",")]

    def decode(self, ids: list[int | None]) -> str:
        """The text of ids; unknown and null ones have none, as in the library."""
        return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker."""
    return Encoder(path)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; null counts as empty (no tokens).

    Row by row without a shuffle; rows come back as often as given. path must be readable on
    each executor. A worker's memory is bounded by KEPT pieces and one Arrow batch. Very long texts are encoded whole; other columns
    are not read, whatever their names; an empty table gives an empty result.
    """
    _io.small_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            n, ids, back = [], [], []
            for text in b.column(1).to_pylist():
                got = enc.parts_of(text or "")
                n.append(sum(g[1] for g in got))
                ids.append(_sha(",".join([g[0] for g in got]).encode()))
                back.append(_sha(b"".join([g[2] for g in got]).decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(kept.dtypes)["doc_id"]
    return kept.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with the token ids of text_col as an array; out_col must be a new name (else ValueError).

    Null counts as empty; repeated rows come back as often as given; an empty table stays empty.
    """
    if out_col in docs.columns:
        raise ValueError(f"{out_col} is taken")
    _io.small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            ids = pa.array([enc.encode(t or "") for t in b.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, out_col])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode_ids(tokens: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """tokens with ids_col decoded to text; a null array gives null, unknown and null ids no text.

    out_col must be a new name (else ValueError); repeated rows come back as often as given; an empty table stays empty.
    """
    if out_col in tokens.columns:
        raise ValueError(f"{out_col} is taken")
    at = tokens.columns.index(ids_col)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            text = pa.array([None if x is None else enc.decode(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, out_col])

    from pyspark.sql import types as T

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(out_col, T.StringType())]))
