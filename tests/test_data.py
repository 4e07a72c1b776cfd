import csv
import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import curate, rules, select
from glyphmill.operators.rules import Refused
from glyphmill.sources import readers, sinks

SCHEMA = "pos long, id string, width int, height int, text string, digest string"


def records(spark, n=12, **change):
    rows = [[i, f"r{i}", 100, 50, f"line {i}", f"d{i}"] for i in range(n)]
    names = SCHEMA.replace(" long", "").replace(" int", "").replace(" string", "").split(", ")
    for k, values in change.items():
        for i, x in values.items():
            rows[i][names.index(k)] = x
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "change,message",
    [({"text": {3: None}}, "text must be a str"), ({"id": {3: "a b"}}, "id must match"), ({"id": {3: "a\n"}}, "id must match"), ({"width": {3: None}}, "image is missing"), ({"width": {3: 15}}, "image side 15 px < 16"), ({"width": {3: 16385}}, "16385 px > 16384"),
     ({"width": {3: 4097}, "height": {3: 4096}}, "image area"), ({"text": {3: ""}}, "text has 0"), ({"text": {3: " \n"}}, "text has 0"), ({"text": {3: "x" * 513}}, "text has 513"), ({"id": {3: "r1"}}, "duplicate id r1")],
)
def test_refusals(spark, change, message):
    with pytest.raises(Refused, match=message):
        rules.validate_dataset(records(spark, **change))


def test_first_violation_in_order(spark):
    with pytest.raises(Refused, match=r"records\[2\]: image side"):
        rules.validate_dataset(records(spark, width={2: 1, 5: 1}, id={4: "?"}))
    with pytest.raises(Refused, match="7 records; 8..5000"):
        rules.validate_dataset(records(spark, 7))
    m = rules.validate_dataset(records(spark)).first()
    assert (m.n_records, m.chars_min, m.chars_max, m.words_total, m.width_max) == (12, 6, 7, 24, 100)


def test_digests(spark):
    r = records(spark)
    lines = sorted(f"r{i}:d{i}:line {i}" for i in range(12))
    want = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert curate.dataset_digest(r).first()[0] == want == curate.dataset_digest(r.repartition(7)).first()[0]
    rows = spark.createDataFrame([(0, 1, b"b", "y"), (0, 0, b"\xff", "x"), (1, 0, None, None)], "g int, p int, data binary, text string")
    got = {x.g: (x.digest, x.total_bytes) for x in curate.group_digest(rows, "g", "p", "data").collect()}
    assert got == {0: (hashlib.sha256(b"\xffxby").hexdigest(), 4), 1: (hashlib.sha256(b"").hexdigest(), 0)}


def test_digests_gather_no_group(spark):
    """A group's rows stream through its task: no plan collects them, and keys, nulls and empty tables keep their digests."""
    r = records(spark).withColumn("g", F.when(F.col("pos") < 9, F.col("pos") % 2))
    by = curate.dataset_digest(r, "g")
    rows = r.withColumn("data", F.encode("text", "UTF-8"))
    for plan in (by, curate.dataset_digest(r), curate.group_digest(rows, "g", "pos", "data")):
        assert "collect_list" not in plan._jdf.queryExecution().toString()
    want = {g: "\n".join(sorted(f"r{i}:d{i}:line {i}" for i in ids)) for g, ids in ((0, [0, 2, 4, 6, 8]), (1, [1, 3, 5, 7]), (None, [9, 10, 11]))}
    assert {x.g: x.dataset_digest for x in by.collect()} == {g: hashlib.sha256(w.encode()).hexdigest() for g, w in want.items()}
    assert curate.dataset_digest(r.limit(0)).first()[0] == hashlib.sha256(b"").hexdigest() and curate.dataset_digest(r.limit(0), "g").count() == 0


def test_splits(spark):
    assert curate.split_counts(50, 0.15, 0.05) == (40, 8, 2) and curate.split_counts(3, 0.5, 0.1) == (0, 2, 1)
    assert curate.record_limits(spark) == (12, 5000)
    r = records(spark, 30, digest={7: "d3", 9: "d3"})
    s = curate.split_dataset(r, seed=5, compatible=True)
    kept, dropped = curate.drop_duplicates(r)
    assert [x.id for x in dropped.collect()] == ["r7", "r9"]
    ids = [x.id for x in kept.orderBy("pos").collect()]
    random.Random(5).shuffle(ids)
    assert [x.id for x in s.orderBy("split", "split_pos").collect() if x.split == "test"] == ids[:6]
    assert curate.check_disjoint(s) == {"test": 6, "validation": 4, "train": 18}
    for parts in (1, 8):
        again = curate.sample_split(r.repartition(parts), {"train": 10, "test": 5}, seed=1)
        first = first if parts == 8 else sorted(map(tuple, again.select("id", "split", "split_pos").collect()))
    assert first == sorted(map(tuple, again.select("id", "split", "split_pos").collect()))
    with pytest.raises(Refused, match="train needs 8, gets 7; 12 records suffice"):
        curate.split_dataset(records(spark, 11))
    with pytest.raises(Refused, match="only 30 records"):
        curate.sample_split(r, {"train": 31})
    leak = s.unionByName(s.where("split = 'test'").limit(1).withColumn("split", F.lit("train")))
    with pytest.raises(Refused, match="has its payload in test and train"):
        curate.check_disjoint(leak)


def test_fresh_and_overlap(spark):
    fresh = records(spark, 3).withColumn("source_row_group", F.lit(8))
    old = records(spark, 12).where("pos > 5").withColumn("source_row_group", F.lit(1)).withColumn("split", F.lit("train"))
    ids, digest = ["r0", "r1", "r2"], curate.dataset_digest(fresh).first()[0]
    assert curate.fresh_test(fresh, old.withColumn("text", F.lit("line 1")), ids, digest, [8]).first().shared_transcripts == 1
    with pytest.raises(Refused, match="overlaps the train split"):
        curate.fresh_test(fresh, old.withColumn("digest", F.lit("d1")), ids, digest, [8])
    with pytest.raises(Refused, match="other row groups"):
        curate.fresh_test(fresh, old, ids, digest, [9])
    a = spark.createDataFrame([("Le Conseil municipal.",)], "text string")
    b = spark.createDataFrame([("1", "le conseil Municipal")], "id string, text string")
    assert curate.transcript_overlap(a, b).count() == 0 and curate.transcript_overlap(a, b, folded=True).count() == 1


def test_own_data(spark, tmp_path):
    box = tmp_path / "d"
    (box / "sub").mkdir(parents=True)
    (box / "a.png").write_bytes(b"A")
    (box / "sub" / "b 1.png").write_bytes(b"B")
    (box / "transcripts.csv").write_bytes("﻿file,text,id\na.png,\"x, \"\"y\"\"\",one\nb 1.png,z,\n".encode())
    got = readers.load_own_data(spark, str(box)).orderBy("pos").collect()
    assert [(x.id, x.text, bytes(x.image.data)) for x in got] == [("one", 'x, "y"', b"A"), ("b_1", "z", b"B")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(box / "a.png", "a.png")
        z.writestr("transcripts.csv", "file,text\na.png,x\nmissing.png,y\n")
    with pytest.raises(Refused, match="missing image: missing.png"):
        readers.load_own_data(spark, str(tmp_path / "z.zip"))
    (box / "c.png").write_bytes(b"C")
    with pytest.raises(Refused, match="image without a transcript row: c.png"):
        readers.load_own_data(spark, str(box))
    for names, message in ((["A.png", "a.PNG"], "two files"), (["x.exe"], "unsupported"), (["../e.png"], "unsafe")):
        with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
            for n in names:
                z.writestr(n, "1")
            z.writestr("transcripts.csv", "file,text\nA.png,x\n")
        with pytest.raises(Refused, match=message):
            readers.load_own_data(spark, str(tmp_path / "s.zip"), strict=True)
    for table, message in (("file,file,text\n", "duplicate column"), ("file,text\na.png\n", "row 1 has 1 fields"), ("x,y\n1,2\n", "must have")):
        (box / "transcripts.csv").write_text(table)
        with pytest.raises(Refused, match=message):
            readers.load_own_data(spark, str(box))


def test_snapshots_and_groups(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "w.bin").write_bytes(b"weights")
    files = readers.read_files(spark, str(tmp_path / "f")).withColumn("path", F.col("file"))
    sha = hashlib.sha256(b"weights").hexdigest()
    manifest = lambda size, more="": spark.sql(f"select 'm' modelId, 'r' revision, array(named_struct('path', 'w.bin', 'bytes', {size}L, 'sha256', '{sha}'){more}) files")
    assert tuple(readers.verify_snapshot(manifest(7), files, "m", "r").first()) == (1, 7)
    with pytest.raises(Refused, match="w.bin: size"):
        readers.verify_snapshot(manifest(8), files, "m", "r")
    with pytest.raises(Refused, match="not of x@r"):
        readers.verify_snapshot(manifest(7), files, "x", "r")
    more = ", named_struct('path', 'a.bin', 'bytes', 1L, 'sha256', 'x')"
    listed = manifest(7, more).selectExpr("inline(files)")
    assert [x.path for x in readers.missing_files(listed, files).collect()] == ["a.bin"] and readers.recorded_digest(listed, "w.bin") == sha
    rows = spark.createDataFrame([(g, p, (b"i",), ["t", " "][p]) for g in (0, 1) for p in (0, 1)], "row_group int, pos int, image struct<bytes: binary>, text string")
    rows.write.partitionBy("row_group").parquet(str(tmp_path / "c"))
    pin = (hashlib.sha256(b"iti ").hexdigest(), 4)
    got = readers.read_corpus(readers.read_groups(spark, str(tmp_path / "c"), {0: pin, 1: pin}))
    assert sorted(x.id for x in got.collect()) == ["line-0", "line-100"]
    with pytest.raises(Refused, match="row group 1"):
        readers.read_groups(spark, str(tmp_path / "c"), {0: pin, 1: ("x", 4)})
    with pytest.raises(Refused, match="run the earlier"):
        readers.load_state(spark, str(tmp_path / "none"))


def test_sinks(spark, tmp_path):
    r = records(spark, 2, text={0: 'say "x", y', 1: " b  c "})
    sinks.write_dataset_csv(r.coalesce(1), str(tmp_path / "d.csv"))
    text = next((tmp_path / "d.csv").glob("part*")).read_text()
    rows = list(csv.DictReader(io.StringIO(text)))
    assert [x["text"] for x in rows] == ['say "x", y', "b c"] and rows[1]["words"] == "2" and rows[0]["file"] == "r0.jpg"
    sinks.write_csv(r.select("id", (F.col("pos") > 0).alias("flag")), str(tmp_path / "e.csv"), ["id", "flag", "none"])
    got = "".join(p.read_text() for p in sorted((tmp_path / "e.csv").glob("part*")))
    assert "r1,True," in got and "r0,False," in got
    a, b = sinks.table_digest(r), sinks.table_digest(r.repartition(5))
    assert a == b != sinks.table_digest(r.withColumn("pos", F.col("pos") + 1))
    sinks.check_fresh({"x": a}, {"x": b}, "compare")
    with pytest.raises(Refused, match="x changed"):
        sinks.export_bundle({}, {}, str(tmp_path / "o"), {"x": a}, {"x": "old"})
    sinks.export_bundle({"t": r}, {"j": r}, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o" / "j.json")).count() == 2
    for i in range(2):
        sinks.append_history(spark, {"key": "k", "cer": 0.5}, "key string, cer double", str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h"))
    assert sinks.result_name(history, "k", "result") == "result-pass3" and sinks.result_name(history, "z", "result") == "result" and select.pass_number(history, "k") == 3


def test_requests_and_settings(spark):
    req = spark.createDataFrame([(100, 50, "plain", 5), (100, 50, "odd", 5), (100, 50, "plain", 5000)], "width int, height int, mode string, max_new_tokens int")
    assert [x.verdict for x in rules.validate_requests(req).collect()] == ["accepted", "rejected", "rejected"]
    with pytest.raises(Refused):
        rules.check_parameters({"epochs": True}, {"epochs": (1, 50)}, ("epochs",))
    with pytest.raises(Refused, match="unknown settings"):
        rules.check_keys({"a": 1}, ["b"])
    shown = []

    def refuse():
        raise Refused("no")

    assert rules.run_refusing(refuse, shown.append) == 65 and shown == ["REFUSED: no"] and rules.run_refusing(lambda: None) == 0
    base = {"model_id": "m", "revision": "r", "weight_sha256": "w"}
    row = lambda fmt="f", size=3, name="layers.23.x": spark.sql(
        f"select 0 pos, '{fmt}' format, named_struct('model_id','m','revision','r','weight_sha256','w') base, array('{name}') tensors, array(named_struct('path','a','bytes',{size}L,'sha256','s')) files, 3L bytes, 's' sha256"
    )
    check = lambda df: rules.check_all(df, rules.adapter_rules("f", base, "a", ["layers.23.", "norm."]), "pos")
    check(row())
    for bad, message in ((row(fmt="g"), "format"), (row(size=4), "size"), (row(name="layers.2.x"), "trainable")):
        with pytest.raises(Refused, match=message):
            check(bad)
