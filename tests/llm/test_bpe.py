import hashlib
import random

import pytest

from glyphmill.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(1)
    out = ["", " ", "\n\n  a", "aaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "x<|endoftext|>  <|endoftext|>y", "don't I'LL", "a" * 5000, "🙂é́ z"]
    return out + ["".join(r.choice("aabbcd eert hin  \n\n'sll é世🙂123aaaa") for _ in range(r.randint(0, 40))) for _ in range(500)]


def test_equals_library(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate([*texts(), None, "twice", "twice"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {x.doc_id: x for x in bpe.encode_digest(docs, PATH).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(back))


def test_round_trip_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "Round trip <|endoftext|> ß"), (2, None)], "doc_id long, text string")
    back = bpe.decode_ids(bpe.encode_ids(docs, PATH), PATH).collect()
    assert [(x.text or "") == x.decoded for x in back] == [True, True]
    assert bpe.encode_digest(docs.limit(0), PATH).count() == 0


def test_taken_names_and_empty_tables(spark):
    from glyphmill.llm import queries

    path = queries.bpe_path()
    df = spark.createDataFrame([("a", [1], "x")], "text string, token_ids array<int>, decoded string")
    for f in (bpe.encode_ids, bpe.decode_ids):
        with pytest.raises(ValueError, match="taken"):
            f(df, path)
    none = df.limit(0).select("text")
    assert bpe.encode_ids(none, path).count() == 0 and bpe.decode_ids(bpe.encode_ids(none, path), path).count() == 0
