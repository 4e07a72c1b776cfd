import hashlib
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR, KEY = "/root/testdata/sf0.001", "a key of the tests alone"


@pytest.fixture(scope="module")
def stages(spark):
    from glyphmill.llm import _io

    spark.conf.set(corpus_pipeline.KEY_SETTING, KEY)
    docs = _io.table(spark, DIR, "documents")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = _io.cut(f(spark, docs, DIR))
        out.append(docs)
    return [d.toPandas() for d in out]


def test_stages_keep_columns_and_shrink(stages):
    for a, b in zip(stages[:4], stages[1:5]):
        assert list(a.columns) == list(b.columns) and set(b.doc_id) <= set(a.doc_id)
    assert len(stages[5]) == len(stages[4]) == len(stages[3])


def classes(texts, similarity=0.8):
    """doc_id -> smallest doc_id reached over pairs of texts whose five-word shingles are that similar, by brute force."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_toxicity_by_direct_scores(spark):
    """Every document is scored one by one, without Spark, by the same model; what goes is what the labels say."""
    from glyphmill.llm import _io, toxicity

    larger = "/root/testdata/sf0.01"
    docs = _io.table(spark, larger, "documents")
    model = toxicity.fit(docs, _io.table(spark, larger, "labels"))
    kept = set()
    for x in docs.select("doc_id", "text").collect():
        raw = np.frombuffer((x.text or "").encode(), np.uint8)
        if model.scores(raw, np.array([0, len(raw)]))[0] < 0.5:
            kept.add(x.doc_id)
    assert {x.doc_id for x in corpus_pipeline.drop_toxic(spark, docs, larger).select("doc_id").collect()} == kept
    toxic = dict(map(tuple, spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "toxic").collect()))
    held = [i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0]
    assert 0 < len(kept) < docs.count() and sum((i not in kept) == bool(toxic[i]) for i in held) >= 0.95 * len(held)


def test_near_copies_and_leaks_by_brute_force(spark, stages):
    root = classes(dict(zip(stages[1].doc_id, stages[1].text)))
    assert set(stages[2].doc_id) == {i for i in root if root[i] == i}
    items = [t.lower() for t in spark.read.parquet(f"{DIR}/benchmark.parquet").toPandas().text]
    leaked = {i for i, t in zip(stages[2].doc_id, stages[2].text) if any(x in t.lower() for x in items)}
    assert set(stages[2].doc_id) - set(stages[3].doc_id) == leaked


def test_private_values_go_and_tokens_round_trip(stages):
    from glyphmill.llm import bpe, pii, queries

    names = pii.Pseudonyms(KEY.encode())
    before = dict(zip(stages[3].doc_id, stages[3].text))
    enc = bpe.Encoder(queries.bpe_path())
    tokens = stages[5].set_index("doc_id")
    for i, t in zip(stages[4].doc_id, stages[4].text):
        assert t == pii.mask(before[i], names)[0]
        assert tokens.n_tokens[i] == len(enc.encode(t)) and tokens.decoded_sha256[i] == hashlib.sha256(t.encode()).hexdigest()


def test_run_equals_stages(spark, stages):
    got = corpus_pipeline.run(spark, DIR).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, stages[5].values))


EDGES = [(0, None), (1, ""), (2, "one two three four five six seven"), (3, "ONE two three four five six seven"), (None, "one two three four five six seven"), (4, "mail ann@example.org"), (4, "mail ann@example.org"), (5, "word " * 60_000)]


def test_edges_of_every_stage(spark):
    """Nulls in any column, empty and very long texts, repeated rows and names that the stages use themselves."""
    clash = "toxicity_score string, benchmark_leaks string, leaks string, text_ string, key string, class_id string, n_email string"
    rows = [(i, t, *["x" if i else None] * 7) for i, t in EDGES]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {clash}").repartition(3)
    for name, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, docs, DIR)
        assert out.columns == docs.columns, name
        got = sorted((x.doc_id if x.doc_id is not None else -1, (x.text or "")[:9], x.leaks) for x in out.collect())
        if name == "near_duplicates":
            assert [g[0] for g in got] == [-1, 0, 2, 4, 4, 5]
        else:
            assert len(got) == len(rows), name
    assert corpus_pipeline.STAGES[4][1](spark, docs, DIR).count() == len(rows)
    empty = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, DIR).count() == 0, name


def test_key_comes_from_the_setting(spark):
    spark.conf.set(corpus_pipeline.KEY_SETTING, "short")
    with pytest.raises(ValueError):
        corpus_pipeline.pseudonym_key(spark)
    spark.conf.unset(corpus_pipeline.KEY_SETTING)
    assert corpus_pipeline.pseudonym_key(spark) != corpus_pipeline.pseudonym_key(spark)
    spark.conf.set(corpus_pipeline.KEY_SETTING, KEY)
    assert corpus_pipeline.pseudonym_key(spark) == KEY.encode()
