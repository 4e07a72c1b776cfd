import random

import pytest

from glyphmill.operators import compare, metrics, runner, select
from glyphmill.operators.rules import Refused
from glyphmill.streaming.running import running_rates

PAIRS = [("1", "abcd", "abcd"), ("2", "hello world", "hello there world"), ("3", "x", "yz")]


def pairs(spark, rows=PAIRS):
    return spark.createDataFrame(rows, "id string, reference string, hypothesis string")


def test_corpus(spark):
    m = metrics.ocr_metrics(pairs(spark)).first()
    assert (m.char_edits, m.ref_chars, m.n, m.word_edits, m.ref_words) == (8, 16, 3, 2, 4)
    assert m.cer == 0.5 and m.wer == 0.5 and m.exact_match == pytest.approx(1 / 3) and m.cer_macro == pytest.approx((6 / 11 + 2) / 3)
    with pytest.raises(Exception, match="empty reference"):
        metrics.ocr_metrics(pairs(spark, [("1", " ", "a")])).first()


def test_blank_reference(spark):
    x = metrics.pair_metrics(pairs(spark, [("1", "", "ab c"), ("2", " ", None)])).orderBy("id").collect()
    assert [(r.cer, r.wer, r.exact, r.char_edits, r.word_edits) for r in x] == [(None, None, False, 4, 2), (None, None, True, 0, 0)]


def test_one_to_one(spark):
    r = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    h = spark.createDataFrame([("a", "x"), ("b", "z")], "id string, text string")
    assert metrics.join_hypotheses(r, h).count() == 2
    with pytest.raises(Exception, match="differ at b"):
        metrics.join_hypotheses(r, h.where("id = 'a'")).collect()


def test_baselines(spark):
    train = spark.createDataFrame(list(enumerate(["abc", "abd", "xyz", "abc", ""])), "pos long, text string")
    assert metrics.medoid(train).first().text == "abc"
    e = metrics.empty_baseline(train.where("text != ''")).first()
    assert (e.cer, e.wer, e.exact_match) == (1, 1, 0)
    assert metrics.constant_baseline(train, train.where("text != ''")).first().char_edits == 4


def test_bootstrap_equals_plain_loop(spark):
    rows = [(i, i % 5 + 1, i % 7 + 6, 1, 2) for i in range(40)]
    other = [(i, i % 3, i % 7 + 6, 1, 2) for i in range(40)]
    schema = "pos long, char_edits long, ref_chars long, word_edits long, ref_words long"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    drawn = metrics.draws(spark, 40, 300, 3, compatible=True)
    r = random.Random(3)
    stats = []
    for _ in range(300):
        at = [r.randrange(40) for _ in range(40)]
        stats.append(sum(rows[i][1] for i in at) / sum(rows[i][2] for i in at) - sum(other[i][1] for i in at) / sum(other[i][2] for i in at))
    stats.sort()
    got = metrics.bootstrap_interval(a, drawn, b).first()
    assert got.low == pytest.approx(stats[int((1 - 0.95) / 2 * 300)]) and got.high == pytest.approx(stats[int((1 + 0.95) / 2 * 300)])
    assert (got.n_lines, got.n_resamples, got.paired) == (40, 300, True)
    wide = metrics.bootstrap_interval(a, metrics.draws(spark, 40, 300, 3), b).first()
    assert abs((wide.high - wide.low) / (got.high - got.low) - 1) < 0.3
    light = metrics.poisson_interval(a, 300, 3, b).first()
    assert light.estimate == got.estimate and light.n_resamples == 300 and abs((light.high - light.low) / (got.high - got.low) - 1) < 0.3
    with pytest.raises(Exception, match="same lines"):
        metrics.bootstrap_interval(a, drawn, b.where("pos > 0")).collect()


def test_recipe_intervals(spark):
    rows = [(c, i, (i * k) % 5, 9) for c, k in (("G1", 2), ("G2", 3), ("G3", 2)) for i in range(30)]
    scored = spark.createDataFrame([*rows, (None, 0, 1, 9)], "config string, pos long, char_edits long, ref_chars long")
    got = {x.pair: x for x in metrics.recipe_intervals(scored, "G1", 200).collect()}
    assert set(got) == {"G2-G1", "G3-G1"} and got["G3-G1"].low == got["G3-G1"].high == 0 and got["G2-G1"].low < got["G2-G1"].high
    one = metrics.poisson_interval(scored.where("config = 'G2'"), 200, paired=scored.where("config = 'G1'")).first()
    assert (one.low, one.high, one.n_lines) == (got["G2-G1"].low, got["G2-G1"].high, 30)
    assert metrics.recipe_intervals(scored, "G9").count() == 0 and metrics.recipe_intervals(scored.where("false"), "G1").count() == 0
    with pytest.raises(Exception, match="same lines"):
        metrics.recipe_intervals(scored.where("config != 'G2' or pos > 0"), "G1", 200).collect()


def test_selection(spark):
    h = [("G1", 0, 1.0), ("G1", 1, 0.5), ("G2", 0, 1.0), ("G2", 1, 0.49), ("G3", 0, 1.0), ("G3", 1, 0.48)]
    history = spark.createDataFrame(h, "config string, epoch int, cer double")
    kept = select.best_epoch(history, 0.01).selectExpr("*", "cast(substring(config, 2, 1) as int) as grid_pos")
    assert select.select_recipe(kept, "G1", 0.05).first().chosen == "G1"
    assert select.select_recipe(kept, "G1", 0.01).first().chosen == "G3"
    frozen = select.best_epoch(history, 0.9).selectExpr("*", "cast(substring(config, 2, 1) as int) as grid_pos")
    assert select.select_recipe(frozen, "G1").first().chosen == "frozen"
    with pytest.raises(Exception, match="no result"):
        select.select_recipe(kept, "G9").collect()
    none = spark.createDataFrame([("A", 0, None), ("A", 3, None)], "config string, epoch int, cer double")
    assert select.best_epoch(none).first().best_epoch == 3
    assert [x.improved for x in select.running_best(history.where("config = 'G1'")).orderBy("epoch").collect()] == [True, True]


def test_compare(spark):
    rows = [("1", "a b b", "b b c"), ("2", "", ""), ("3", "x", "")]
    got = {x.id: (x.token_precision, x.token_recall, x.token_f1) for x in compare.token_overlap(pairs(spark, rows)).collect()}
    assert got["1"] == pytest.approx((2 / 3, 2 / 3, 2 / 3)) and got["2"] == got["3"] == (0, 0, 0)
    d = compare.word_diff(pairs(spark, [("1", "room 12 is free", "room 21 is free"), ("2", "same", "same")])).collect()
    assert [(x.id, x.op, x.reference_words, x.hypothesis_words) for x in d] == [("1", "replace", "12", "21")]
    pages = spark.createDataFrame([("p", "m", "a b", "a c", True)], "page_id string, model string, reference string, hypothesis string, truncated boolean")
    x = compare.page_rows(pages)
    assert x.first().token_f1 == 0.5 and compare.page_means(x).first().truncated == 1
    runs = spark.createDataFrame([("m", 6.0), ("n", 1.0)], "model string, seconds double")
    items = spark.createDataFrame([("m", 1.0), ("m", 3.0)], "model string, inference_seconds double")
    res = {r.model: (r.mean_line_latency_s, r.mean_page_latency_s) for r in compare.resources(runs, items, items).collect()}
    assert res == {"m": (3.0, 2.0), "n": (None, None)}
    report = metrics.evaluation_report(spark.createDataFrame([("ab", "abc"), ("ab", None)], "text string, reference string")).collect()
    assert [(r.verdict, r.cer) for r in report] == [("sample-sanity", pytest.approx(1 / 3)), ("not-measurable", None)]


def test_runner(spark):
    import pandas as pd

    rec = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "pos int, text string")
    assert sorted(x["count"] for x in runner.batches(rec, 2).groupBy("batch").count().collect()) == [1, 2, 2]
    good = lambda: lambda f: pd.DataFrame({"text": f["text"] + " <s> ", "new_tokens": [7] * len(f)})
    got = runner.transcribe(rec, good, stop="<s>", budget=7, batch_size=2).orderBy("pos").collect()
    assert [(x.reference, x.text, x.truncated) for x in got] == [(f"t{i}", f"t{i}", True) for i in range(5)]
    scored = metrics.pair_metrics(runner.transcribe(rec, good, stop="<s>").withColumnRenamed("text", "hypothesis"))
    e = metrics.evaluate(scored).first()
    assert (e.n, e.cer, e.new_tokens, e.verdict) == (5, 0, 35, "measured-small-sample")
    with pytest.raises(Exception, match="for 1 records"):
        runner.transcribe(rec, lambda: lambda f: f.iloc[:0].assign(new_tokens=1), batch_size=1).collect()
    with pytest.raises(Refused):
        runner.transcribe(rec, good, batch_size=65)
    assert tuple(runner.parity(got and rec.selectExpr("pos id", "text"), rec.selectExpr("pos id", "text")).first()) == (5, 5)


def test_streaming(spark, tmp_path):
    for i in range(3):
        pairs(spark).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, reference string, hypothesis string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    x = spark.table("rates").first()
    assert (x.n, x.cer, x.wer) == (9, 0.5, 0.5)


def test_stages(spark, tmp_path):
    from glyphmill.plans import stages
    from glyphmill.sources import pages, sinks

    said = spark.createDataFrame(
        [(str(i), s, "hello world", "hello world" if s == "a" or i else "x <loc_", False, "<text>x</text>" if s == "b" else None) for i in range(3) for s in "ab"],
        "id string, system string, reference string, hypothesis string, truncated boolean, markup string",
    )
    t = stages.comparison(said, "a", "b")
    assert {r.disagreement_category: r.n for r in t["disagreement"].collect()} == {"both_good": 2, "a_only_good": 1}
    m = {r.system: r for r in t["markup_sensitivity"].collect()}
    assert m["b"].lines_with_partial_tag == 1 and m["b"].lines_unbalanced_element_tags == 0 and m["a"].lines_malformed_locations is None
    stages.export(t, {"said": said}, {"said": sinks.table_digest(said)}, str(tmp_path / "out"))
    with pytest.raises(Refused, match="said changed"):
        stages.export(t, {"said": said}, {"said": "old"}, str(tmp_path / "out2"))
    p = pages.sample_pages(spark)
    drawn = p.selectExpr("page_id", "concat('<otsl>', reference_text, '</otsl>') as markup")
    rows = stages.structure(drawn, pages.expected_counts(p)).where("page_id = 'invoice'").collect()
    assert {(r.element_type, r.absolute_count_error) for r in rows} == {("otsl", 0), ("section_header_level_1", 1)}
    assert pages.probes(spark, p).count() == 64


def test_markup_sensitivity_works_out_only_what_is_asked(spark):
    """Character rates alone take two distances, not the words' two as well; both rates and white space come out as before."""
    from glyphmill.operators import compare

    rows = [("a", "one two three", "one two thre <loc_5", True, None), ("a", "x  y", "x y", False, None), ("b", "abc  def", " abd  def </te", False, "<text>x"), ("b", "abc", None, False, "<loc_501>"), ("b", "abc", "<loc_", False, "x")]
    said = spark.createDataFrame(rows, "system string, reference string, hypothesis string, truncated boolean, markup string")
    out = compare.markup_sensitivity(said)
    plan = out.select("system", "configured_cer", "markup_excluded_cer")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 4
    got = {r.system: r for r in out.collect()}
    a, b = got["a"], got["b"]
    assert (a.lines, a.lines_with_partial_tag, a.partial_tag_chars, a.truncated_lines, a.lines_unbalanced_element_tags) == (2, 1, 6, 1, None)
    assert (a.configured_cer, a.markup_excluded_cer, a.configured_wer, a.markup_excluded_wer) == (7 / 16, 1 / 16, 2 / 5, 1 / 5)
    assert (b.lines, b.lines_with_partial_tag, b.partial_tag_chars, b.lines_unbalanced_element_tags, b.lines_malformed_locations) == (3, 2, 9, 1, 1)
    assert (b.configured_cer, b.markup_excluded_cer, b.configured_wer, b.markup_excluded_wer) == (13 / 13, 7 / 13, 4 / 4, 3 / 4)
