import random
import zlib
from collections import defaultdict

from glyphmill.llm import shards

SCHEMA = "doc_id long, text string, size string"


def test_laws(spark):
    r = random.Random(1)
    docs = [(i, r.choice("xyé") * 3 + "\n".join("w" * r.randint(1, 80) for _ in range(r.randint(0, 30))), "c") for i in range(3000)]
    docs += [(3000 + i, docs[7][1], "c") for i in range(200)] + [(4000, None, "c"), (None, "", "c"), (4001, "long " * 800, "c"), (5, docs[5][1], "c")]
    got = shards.kd_shards(spark.createDataFrame(docs, SCHEMA), 40).collect()
    assert len(got) == len(docs)
    text = defaultdict(set)
    for i, t, _ in docs:
        text[i].add(t)
    size, slots, of = defaultdict(int), defaultdict(list), defaultdict(set)
    for x in got:
        assert (x.size, x.text_crc32) in {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in text[x.doc_id]}
        size[x.shard] += x.size
        slots[x.shard].append(x.slot)
        of[x.text_crc32, x.size].add(x.shard)
    assert sorted(size) == list(range(40))
    mean = sum(size.values()) / 40
    assert max(size.values()) <= 1.12 * mean and min(size.values()) >= 0.88 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    light = [k for k in of if k[1] < 0.01 * mean]
    assert sum(len(of[k]) > 1 for k in light) <= 3


def test_edges(spark):
    assert shards.kd_shards(spark.createDataFrame([], SCHEMA), 40).count() == 0
    same = [(i, "equal", None) for i in range(400)]
    got = shards.kd_shards(spark.createDataFrame(same, SCHEMA), 4).groupBy("shard").count().collect()
    assert len(got) == 4 and all(85 <= x["count"] <= 115 for x in got)
    by_bytes = shards.kd_shards(spark.createDataFrame(same, SCHEMA), target_bytes=400 * 21 // 5)
    assert by_bytes.select("shard").distinct().count() == 5
