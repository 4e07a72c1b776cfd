"""One very long text, empty and null ones through every document operator."""

import hashlib
import random

import pytest

from glyphmill.llm import bpe, decontam, passages, pii, queries, repeats, shards, simhash, toxicity

SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    long = " ".join(r.choices(vocab, k=250_000))
    rows = [(0, long, None), (1, long[500_000:520_000], None), (2, None, "x"), (3, "", "x"), (4, "short 4111111111111111", "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(2), {i: t or "" for i, t, _ in rows}


def by_id(df):
    return {x.doc_id: x for x in df.collect()}


def test_row_wise(spark, docs):
    df, texts = docs
    got = by_id(bpe.encode_digest(df, queries.bpe_path()))
    assert {i: x.decoded_sha256 for i, x in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    hidden = by_id(pii.pseudonymise(df, b"k"))
    assert hidden[0].text == texts[0] and hidden[2].text is None and hidden[3].text == "" and hidden[4].text != texts[4]
    labels = spark.createDataFrame([(i, int(i == 4)) for i in range(5)], "doc_id long, toxic int")
    scored = toxicity.score(df, toxicity.fit(df, labels), out_col="toxicity")
    assert scored.count() == 5 and scored.where("toxicity between 0 and 1").count() == 5
    item = " ".join(texts[0].split(" ")[200_000:200_040])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {i: [y.item_id for y in x.leaks] for i, x in by_id(decontam.contamination(df, bench)).items()} == {0: [7], 1: [], 2: [], 3: [], 4: []}


def test_across_rows(spark, docs):
    df, texts = docs
    marks = by_id(simhash.near_duplicates(df))
    assert marks[2].component_id == marks[3].component_id == 2 and marks[0].fingerprint == f"{simhash.fingerprint(texts[0].encode()):016x}"
    gone = by_id(repeats.remove_repeats(df))
    shared = texts[1].encode()
    assert gone[1].n_removed == len(shared) and gone[0].n_removed == len(shared) and gone[0].n_spans == 1 and gone[4].n_removed == 0
    links = by_id(passages.fuzzy_passages(df))
    assert links[1].class_id == 0 and links[1].n_links == links[0].n_links == 1 and links[4].n_links == 0
    assert links[2].text_class == 2 and links[3].text_class == 2 and links[2].n_copies == 1
    placed = shards.kd_shards(df, 2)
    assert placed.count() == 5 and placed.where("size = 16").count() == 2
