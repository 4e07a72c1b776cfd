"""Row groups, archives, exports committed as one, staged runs, ordered batches, checks while writing."""

import hashlib
import json
import os
import zipfile

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import metrics, rules, runner
from glyphmill.operators.rules import Refused
from glyphmill.plans import stages
from glyphmill.sources import archives, bundle, readers, rowgroups, sinks


@pytest.fixture
def corpus(spark, tmp_path):
    rows = spark.createDataFrame([(i, (f"i{i}".encode(),), f"t{i}" if i % 5 else " ") for i in range(40)], "n int, image struct<bytes: binary>, text string")
    path = str(tmp_path / "c")
    rowgroups.write(rows.coalesce(1).sortWithinPartitions("n"), path, 10)
    return path


def pin(a, b):
    data = b"".join(f"i{i}".encode() + (f"t{i}" if i % 5 else " ").encode() for i in range(a, b))
    return hashlib.sha256(data).hexdigest(), len(data)


def test_row_groups(spark, corpus):
    file = next(f for f in os.listdir(corpus) if f.endswith(".parquet"))
    got = {x.row_group: (x.digest, x.total_bytes, x.n_rows) for x in rowgroups.digests(spark, corpus, ["image", "text"]).collect()}
    assert got == {g: (*pin(10 * g, 10 * g + 10), 10) for g in range(4)}
    rows = rowgroups.read(spark, corpus, ["n"])
    assert rows.rdd.getNumPartitions() == 4 and [tuple(x) for x in rows.where("row_group = 2 and pos > 7").collect()] == [(28, file, 2, 8), (29, file, 2, 9)]
    assert rows.where("row_group in (1, 3)").rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="unknown row groups"):
        rowgroups.read(spark, corpus, groups=[9]).collect()
    pins = {(file, g): pin(10 * g, 10 * g + 10) for g in range(4)}
    split = readers.sample_dataset(spark, corpus, pins, {"train": 20, "test": 8}, seed=3)
    assert {x.split: x["count"] for x in split.groupBy("split").count().collect()} == {"train": 20, "test": 8}
    assert {x.id for x in split.collect()} <= {f"line-{100 * (i // 10) + i % 10}" for i in range(40) if i % 5}
    with pytest.raises(Exception, match="row group 1: digest or bytes differ"):
        rowgroups.read(spark, corpus, pins=pins | {(file, 1): ("x", 4)}).collect()
    with pytest.raises(Exception, match="row group 3: digest or bytes differ"):
        rowgroups.read(spark, corpus, pins={k: p for k, p in pins.items() if k[1] != 3}).count()


def test_groups_not_asked_for_are_not_read(spark, corpus):
    file = next(f"{corpus}/{f}" for f in os.listdir(corpus) if f.endswith(".parquet"))
    c = pq.ParquetFile(file).metadata.row_group(1).column(0)
    start = c.dictionary_page_offset or c.data_page_offset
    with open(file, "r+b") as f:
        f.seek(start)
        f.write(b"\xff" * c.total_compressed_size)
    for crc in os.listdir(corpus):
        if crc.endswith(".crc"):
            os.remove(f"{corpus}/{crc}")
    assert rowgroups.read(spark, corpus, ["n"]).where("row_group in (0, 2)").count() == 20
    assert rowgroups.digests(spark, corpus, ["text"], groups=[3]).count() == 1
    with pytest.raises(Exception):
        rowgroups.read(spark, corpus, ["n"]).where("row_group = 1").collect()


def test_archives(spark, tmp_path):
    box = tmp_path / "z"
    box.mkdir()
    rng = np.random.default_rng(1)
    data = {f"d{i % 3}/m{i}.png": rng.bytes(i * 300) for i in range(60)}
    with zipfile.ZipFile(box / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("d0")
        for k, x in data.items():
            z.writestr(k, x)
        z.writestr("__MACOSX/d0/._m0.png", b"x")
        z.writestr("stored.bin", b"s" * 5000, zipfile.ZIP_STORED)
        link = zipfile.ZipInfo("link.png")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "stored.bin")
    want = data | {"stored.bin": b"s" * 5000, "link.png": b"stored.bin"}
    m = archives.members(spark, str(box / "a.zip"), partition_bytes=50_000)
    assert 8 <= m.rdd.getNumPartitions() <= 16
    got = m.collect()
    assert {x.path: bytes(x.content) for x in got} == want and all(x.sha256 == hashlib.sha256(x.content).hexdigest() and x.bytes == len(x.content) for x in got)
    d = archives.directory(spark, str(box))
    assert d.count() == 62 and d.where("kind = 'symlink'").first().path == "link.png" and d.agg(F.sum("bytes")).first()[0] == sum(map(len, want.values()))
    raw = bytearray((box / "a.zip").read_bytes())
    at = d.where("path = 'stored.bin'").first().offset + 60
    raw[at] ^= 1
    (box / "a.zip").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="stored.bin: size or checksum"):
        archives.members(spark, str(box)).collect()
    (box / "b.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="(?s)BadZipFile.*File is not a zip file"):
        archives.directory(spark, str(box)).collect()


def rows_of(spark, names):
    return spark.createDataFrame([(n, i, f"{n} {i}\n".encode()) for n in names for i in range(20)], "name string, pos int, content binary").repartition(7)


def test_bundle_commits_as_one(spark, tmp_path):
    path = str(tmp_path / "b")
    bundle.write(rows_of(spark, ["a.txt", "d/b.txt"]), path)
    text = (tmp_path / "b" / "d" / "b.txt").read_bytes()
    assert text.decode() == "".join(f"d/b.txt {i}\n" for i in range(20))
    got = {x.path: (x.bytes, x.sha256, x.rows) for x in bundle.manifest(spark, path).collect()}
    assert got["d/b.txt"] == (len(text), hashlib.sha256(text).hexdigest(), 20) and set(got) == {"a.txt", "d/b.txt"}
    assert sorted(os.listdir(path)) == ["a.txt", "d", "manifest.json"]
    with pytest.raises(Exception, match="written already"):
        bundle.write(rows_of(spark, ["a.txt"]), path)
    bundle.write(rows_of(spark, ["c.txt"]), path, overwrite=True)
    assert sorted(x["path"] for x in bundle.read_manifest(path)) == ["c.txt"] and not (tmp_path / "b" / "a.txt").exists()
    for bad in ("../x", "/x", "", "manifest.json"):
        with pytest.raises(Exception, match="unsafe file name"):
            bundle.write(rows_of(spark, [bad]), str(tmp_path / "u"))
    with pytest.raises(Exception, match="name, member and content"):
        rows_of(spark, ["a"]).write.format("bundle").option("path", str(tmp_path / "u")).mode("append").save()


def test_failed_export_leaves_nothing(spark, tmp_path):
    boom = F.when((F.col("name") == "b") & (F.col("pos") == 10), F.raise_error(F.lit("boom")).cast("binary")).otherwise(F.col("content"))
    broken = rows_of(spark, ["a", "b", "c"]).withColumn("content", boom)
    with pytest.raises(Exception, match="boom"):
        bundle.write(broken, str(tmp_path / "n"))
    assert not (tmp_path / "n").exists()
    path = str(tmp_path / "old")
    bundle.write(rows_of(spark, ["a"]), path)
    digest = bundle.manifest_digest(path)
    with pytest.raises(Exception, match="boom"):
        bundle.write(broken, path, overwrite=True)
    assert bundle.manifest_digest(path) == digest and sorted(os.listdir(path)) == ["a", "manifest.json"]
    bundle.write(rows_of(spark, ["x"]), str(tmp_path / "fresh"), fresh={path: digest})
    with pytest.raises(Exception, match="changed after"):
        bundle.write(rows_of(spark, ["x"]), str(tmp_path / "stale"), fresh={path: "0"})
    assert not (tmp_path / "stale").exists()


def test_export_of_tables(spark, tmp_path):
    t = spark.createDataFrame([(2, 'say "x", y', True), (1, None, None)], "id int, text string, flag boolean")
    sinks.export_bundle({"t": t}, {"r": t.withColumn("rows", F.lit(1))}, str(tmp_path / "e"), pages=t.select(F.col("id").alias("page_id"), "text"))
    assert (tmp_path / "e" / "t.csv").read_text().splitlines() == ["id,text,flag", "1,,", '2,"say ""x"", y",True']
    assert [json.loads(x) for x in (tmp_path / "e" / "r.json").read_text().splitlines()][0] == {"id": 1, "text": None, "flag": None}
    assert json.loads((tmp_path / "e" / "pages" / "2" / "page.json").read_text())["page_id"] == 2


def test_stages(spark, tmp_path):
    ran = []

    def stage(name, inputs, change=lambda *x: x[0]):
        return stages.Stage(name, inputs, lambda *x: (ran.append(name), change(*x))[1])

    def refuse(df):
        raise Refused("no")

    t = spark.range(4)
    graph = [stage("c", ("b", "y")), stage("a", ("x",)), stage("b", ("a",), lambda a: a.where("id < 3"))]
    status = lambda **given: {r.stage: (r.status, r.rows) for r in stages.run_stages(spark, graph, given, str(tmp_path / "s")).collect()}
    assert status(x=t, y=t) == {"a": ("ran", 4), "b": ("ran", 3), "c": ("ran", 3)} and ran == ["a", "b", "c"]
    assert status(x=t.repartition(3), y=t) == {"a": ("kept", 4), "b": ("kept", 3), "c": ("kept", 3)} and len(ran) == 3
    assert status(x=spark.range(5), y=t) == {"a": ("ran", 5), "b": ("ran", 3), "c": ("kept", 3)}  # b is made anew and the same
    graph[1] = stage("a", ("x",), refuse)
    assert status(x=spark.range(6), y=t) == {"a": ("refused", None), "b": ("blocked", None), "c": ("blocked", None)}
    graph[1] = stage("a", ("x",))
    assert status(x=spark.range(5), y=t)["c"] == ("ran", 3)
    with pytest.raises(Refused, match="which nothing gives"):
        status(x=t)


def test_workshop_stages(spark, tmp_path):
    said = spark.createDataFrame([(str(i), s, "some words", "some words" if s == "a" or i else "x <loc_", False, None) for i in range(3) for s in "ab"], "id string, system string, reference string, hypothesis string, truncated boolean, markup string")
    pages = spark.createDataFrame([("p", "a", "one two", "one too", False, 2.0)], "page_id string, model string, reference string, hypothesis string, truncated boolean, inference_seconds double")
    drawn = spark.createDataFrame([("p", "<text>x</text>")], "page_id string, markup string")
    expected = spark.createDataFrame([("p", "text", 2)], "page_id string, element_type string, expected_count int")
    runs = spark.createDataFrame([("a", 6.0)], "model string, seconds double")
    given = {"said": said, "page_said": pages, "drawn": drawn, "expected": expected, "runs": runs}
    got = {r.stage: (r.status, r.rows) for r in stages.run_stages(spark, stages.workshop("a", "b"), given, str(tmp_path)).collect()}
    assert got == {"results": ("ran", 6), "metrics": ("ran", 2), "disagreement": ("ran", 2), "sensitivity": ("ran", 2), "structure": ("ran", 1), "pages": ("ran", 1), "inspect": ("ran", 1), "resources": ("ran", 1), "summary": ("ran", 1)}


def test_batches_over_all_borders(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rec = spark.range(0, 53, 1, 6).select((F.col("id") * 3).alias("pos"), F.concat(F.lit("t"), "id").alias("text")).repartition(5)
        tell = lambda: lambda f: pd.DataFrame({"text": [",".join(map(str, f["pos"]))] * len(f), "new_tokens": [1] * len(f)})
        got = runner.transcribe(rec, tell, batch_size=7).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(x.batch, x.text, x.reference) for x in got] == [(i // 7, ",".join(str(3 * j) for j in range(i // 7 * 7, min(53, i // 7 * 7 + 7))), f"t{i}") for i in range(53)]


def test_progress(spark):
    told = []
    n = runner.with_progress(spark, lambda: spark.range(0, 40, 1, 8).repartition(6).count(), lambda done, total: told.append((done, total)), 0.02)
    assert n == 40 and told[-1][0] == told[-1][1] > 0 and [d for d, _ in told] == sorted(d for d, _ in told)
    with pytest.raises(ZeroDivisionError):
        runner.with_progress(spark, lambda: 1 / 0, lambda *x: None)


def records(spark, n=12, bad=None):
    return spark.createDataFrame([(i, f"r{i}", 5 if i == bad else 100, 50, f"line {i}") for i in range(n)], "pos long, id string, width int, height int, text string")


def test_checked_write_scans_once(spark, tmp_path):
    path, plans = str(tmp_path / "w"), []

    def write(df):
        plans.append(df._jdf.queryExecution().toString())
        df.write.mode("overwrite").parquet(path)

    told = rules.checked_write(records(spark), write, lambda: None)
    assert told["n_records"] == 12 and told["words_total"] == 24 and spark.read.parquet(path).columns == ["pos", "id", "width", "height", "text"]
    assert plans[0].split("== Physical Plan ==")[1].count("Scan ") == 1
    gone = []
    with pytest.raises(Refused, match=r"records\[7\]: image side 5 px"):
        rules.checked_write(records(spark, bad=7), write, lambda: gone.append(1))
    with pytest.raises(Refused, match="3 records; 8"):
        rules.checked_write(records(spark, 3), write, lambda: gone.append(1))
    assert gone == [1, 1]
    assert tuple(rules.validate_dataset(records(spark)).first())[:4] == (12, 6, 7, sum(len(f"line {i}") for i in range(12)))


def test_poisson_weights_are_poisson():
    w = metrics.poisson_weights(np.arange(4000) * 100_003, np.arange(500), 0)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01
    assert np.abs(np.corrcoef(w[:, :40].T) - np.eye(40)).max() < 0.08 and np.abs(np.corrcoef(w[:40]) - np.eye(40)).max() < 0.25


def test_poisson_interval_is_close_to_the_resampled_one(spark):
    r = np.random.default_rng(2)
    rows = [(i, int(r.integers(0, 20)), int(r.integers(20, 60)), 0, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "pos long, char_edits long, ref_chars long, word_edits long, ref_words long")
    a = metrics.poisson_interval(df, 2000).first()
    b = metrics.bootstrap_interval(df, metrics.draws(spark, 400, 2000, seed=1)).first()
    assert a.estimate == b.estimate and a.n_resamples == 2000 and a.n_lines == 400
    assert abs(a.low - b.low) < 0.15 * (b.high - b.low) and abs(a.high - b.high) < 0.15 * (b.high - b.low)
    none = metrics.poisson_interval(df.limit(0), 20).first()
    assert (none.n_lines, none.estimate, none.low) == (0, None, None)
    plan = metrics.poisson_interval(df, 2000)._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_requests_bring_one_name(spark):
    rows = [(1, None, "plain"), (2, [], "plain"), (3, ["a"], "plain"), (4, ["a", "b"], "plain"), (5, [], "loud")]
    req = spark.createDataFrame(rows, "id int, names array<string>, mode string").selectExpr("*", "64 AS width", "64 AS height", "8 AS max_new_tokens")
    got = {x.id: x.finding for x in rules.validate_requests(req).collect()}
    assert got[1] is None and got[3] is None and got[2] == got[4] and "exactly one name" in got[2] and got[5].startswith("mode loud")


def test_tensor_names_match_three_ways(spark):
    table = lambda rows: spark.createDataFrame(rows, "artifact string, name string, extra int")
    listed = table([("a", x, 1) for x in ("w1", "w1", "w2", "w3")] + [("a", None, 1), (None, "w9", 1)])
    trainable = table([("a", x, 2) for x in ("w1", "w2", "w4")])
    stored = table([("a", x, 3) for x in ("w1", "w3", "W1")])
    got = {(x.artifact, x.name): x.finding for x in rules.tensor_findings(listed, trainable, stored).collect()}
    assert got == {
        ("a", "w2"): "listed, not in the file",
        ("a", "w3"): "listed, not trained by the model",
        ("a", "w4"): "trained by the model, not listed",
        ("a", "W1"): "in the file alone",
    }
    assert rules.tensor_findings(table([]), table([]), table([])).count() == 0


def test_unknown_keys_and_recorded_digests(spark):
    given = spark.createDataFrame([(1, "lr"), (1, "seed"), (2, None), (2, "seed")], "run int, key string")
    known = spark.createDataFrame([("lr",)], "key string")
    assert sorted((x.run, x.key or "") for x in rules.unknown_keys(given, known).collect()) == [(1, "seed"), (2, ""), (2, "seed")]
    files = spark.createDataFrame([("r", 2, "w", "late"), ("r", 1, "w", "early"), ("r", 0, "x", "no"), ("s", 0, "x", "no")], "root string, pos int, path string, sha256 string")
    assert {x.root: x.sha256 for x in readers.recorded_digests(files, "w").collect()} == {"r": "early", "s": None}


def test_own_row_groups_of_many_files(spark, tmp_path):
    """One row for the whole table as in the SQL, however its files and row groups are cut."""
    from glyphmill.plans import catalogue_runs

    docs = spark.createDataFrame([(i, f"text {i} é") for i in range(50)], "doc_id long, text string")
    rowgroups.write(docs.repartition(3), str(tmp_path / "documents.parquet"), 7)
    whole = "".join(f"text {i} é" for i in range(50)).encode()
    got = catalogue_runs.own_row_groups(spark, str(tmp_path)).collect()
    assert [tuple(x) for x in got] == [(0, 50, len(whole), hashlib.sha256(whole).hexdigest())]


def test_a_recogniser_s_calls_leave_in_whole_frames():
    """Batches of seven go out together, not one small frame a call; one that goes on in the next frame stays whole."""
    frames = [pd.DataFrame({"batch": [i // 7 for i in range(a, b)], "pos": range(a, b)}) for a, b in ((0, 30), (30, 33), (33, 70))]
    got = list(runner._whole(iter(frames)))
    assert [len(f) for f, _ in got] == [28, 35, 7] and [e[-1] for _, e in got] == [28, 35, 7]
    assert [len(f) for f in runner.whole_batches(iter(frames))] == [7] * 10
    assert pd.concat([f for f, _ in got])["pos"].tolist() == list(range(70))
