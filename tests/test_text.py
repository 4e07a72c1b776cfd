import difflib
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators import compare



def one(spark, expr, *values, schema=None):
    return spark.createDataFrame([values], schema or ", ".join(f"c{i} string" for i in range(len(values)))).select(expr.alias("x")).first().x


def dp(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("a,b,n", [("kitten", "sitting", 3), ("abc", "abc", 0), ("", "a", 1), ("é", "e", 1), ("😀", "a", 1)])
def test_char_distance(spark, a, b, n):
    assert one(spark, tx.char_distance("c0", "c1"), a, b) == n


def test_rates(spark):
    rows = [("hello world", "hell0 world", 1 / 11, 0.5), ("a  b", "a b", 0, 0), ("Hello", "hello", 0.2, 0), ("a b c d", "a x c", None, 0.5), ("é", "é", 0, None)]
    for r, h, cer, wer in rows:
        if cer is not None:
            assert one(spark, tx.character_error_rate("c0", "c1"), r, h) == pytest.approx(cer)
        if wer is not None:
            assert one(spark, tx.word_error_rate("c0", "c1"), r, h) == pytest.approx(wer)
    with pytest.raises(Exception, match="at least one character"):
        one(spark, tx.character_error_rate("c0", "c1"), " \n", "x")


def test_distances_equal_plain_dp(spark):
    r = random.Random(5)
    pairs = [(" ".join(r.choices(["a", "b", "été", "dd", "E"], k=r.randint(0, 9))), " ".join(r.choices(["a", "b", "été", "dd", "E"], k=r.randint(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "r string, h string")
    for x in df.select("r", "h", tx.char_distance("r", "h").alias("c"), tx.word_distance(tx.words("r"), tx.words("h")).alias("w")).collect():
        assert (x.c, x.w) == (dp(x.r, x.h), dp(x.r.lower().split(), x.h.lower().split()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab é", max_size=8), st.text("ab é", max_size=8)), min_size=1, max_size=20))
def test_distance_laws(spark, pairs):
    df = spark.createDataFrame(pairs, "r string, h string")
    for x in df.select("r", "h", tx.char_distance("r", "h").alias("d"), tx.char_distance("h", "r").alias("e")).collect():
        assert x.d == x.e and abs(len(x.r) - len(x.h)) <= x.d <= max(len(x.r), len(x.h), 0)


def test_white_space_is_pythons(spark):
    spaces = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    assert len(spaces) == 29
    df = spark.createDataFrame([(f"{c}a{c}{c}b{c}",) for c in spaces], "t string")
    assert {r.x for r in df.select(tx.collapse("t").alias("x")).collect()} == {"a b"}


def test_fold(spark):
    text = "Le  Conseil, Municipal. STRASSE – ßé"
    assert one(spark, tx.fold("c0"), text) == "le conseil municipal strasse ssé"
    assert one(spark, tx.fold_plain("c0"), text) == "le conseil municipal strasse ssé"


@pytest.mark.parametrize(
    "text,kept,cut",
    [("abc <loc_5", "abc", "<loc_5"), ("x </te", "x", "</te"), ("abc <loc_", "abc", "<loc_"), ("word <", "word", "<"), ("<loc_12", "", "<loc_12"), ("clean text", "clean text", ""), ("a <b> c", "a <b> c", ""), ("2 < 3", "2 < 3", "")],
)
def test_partial_markup(spark, text, kept, cut):
    assert tuple(one(spark, tx.strip_partial_markup("c0"), text)) == (kept, cut)


def test_markup_summary(spark):
    s = one(spark, tx.markup_summary("c0"), "<doctag><otsl><fcel>a<fcel>b<nl><fcel>c<fcel>d<nl></otsl></doctag>")
    assert (s.n_table_cells, s.n_table_rows, s.n_table_grid_positions, s.n_otsl_tokens, s.wrapped_in_doctag) == (4, 2, 4, 6, True)
    s = one(spark, tx.markup_summary("c0"), "<ched>h<lcel><nl><fcel>c<fcel>d<nl>")
    assert (s.n_table_cells, s.n_table_rows, s.n_table_grid_positions, s.n_otsl_tokens) == (3, 2, 4, 6)
    s = one(spark, tx.markup_summary("c0"), "<text><loc_1><loc_2><loc_3><loc_500>x</text><text>y")
    assert (s.counts["text"], s.n_elements, s.n_location_groups, s.loc_tokens_divisible_by_4) == (2, 2, 1, True)
    with pytest.raises(Exception, match="outside 0..500"):
        one(spark, tx.markup_summary("c0"), "<loc_501>")
    assert tuple(one(spark, tx.markup_failures("c0"), "<text>a</text><loc_501>")) == (False, True)
    assert tuple(one(spark, tx.markup_failures("c0"), "<text>a<loc_1><loc_1><loc_1><loc_1>")) == (True, False)
    assert one(spark, tx.markup_to_text("c0"), "<text><loc_1>a<fcel>b</text>  c <x y>") == "a b c <x y>"


def test_small_functions(spark):
    assert one(spark, tx.preview("c0", 3), "abcdef") == "abc ... (3 more characters)" and one(spark, tx.preview("c0", 9), "ab") == "ab"
    assert [one(spark, tx.safe_identifier("c0"), x) for x in ("a", " . ", "a/b", "", "c:d")] == [True, False, False, False, False]
    assert one(spark, tx.id_from_file("c0"), "x/my file.v1.png") == "my_file.v1" and one(spark, tx.id_from_file("c0"), ".png") == ".png"
    assert one(spark, tx.clean_output("c0", "<end>"), " a <end>\n") == "a"
    assert one(spark, tx.generated_length("c0", [9, 0]), [5, 9, 0], schema="c0 array<int>") == 2 and one(spark, tx.generated_length("c0", [7]), [5, 9], schema="c0 array<int>") == 2
    assert one(spark, tx.wrapped("c0", 7), "aa bb cccccccccc d e f g") == ["aa bb", "cccccccccc", "d e f g"]
    c = one(spark, tx.format_counts("c0"), "# a | b\n| c")
    assert c.characters["|"] == 2 and c.lines == 2
    ratios = [(True, 0.0, 0.0, "truncated"), (False, 0.0, 2.0, "runaway_or_hallucinated"), (False, 0.0, 1.0, "exact"), (False, 0.1, 1.0, "mostly_correct"), (False, 0.5, 1.0, "partial"), (False, 0.8, 1.0, "severe")]
    for cut, cer, ratio, want in ratios:
        assert one(spark, tx.error_category(F.lit(cer), F.lit(ratio), F.lit(False), F.lit(cut)), "x") == want


def plain_differences(reference, hypothesis):
    r, h = reference.split(), hypothesis.split()
    codes = difflib.SequenceMatcher(a=r, b=h, autojunk=False).get_opcodes()
    return [(op, " ".join(r[a:b]), " ".join(h[c:d])) for op, a, b, c, d in codes if op != "equal"]


def test_differences(spark):
    r = random.Random(3)
    rows = [(str(i), *(" ".join(r.choices(["ab", "b", "Ä", "c,"], k=r.randint(0, 30))) for _ in range(2))) for i in range(200)]
    rows += [("n", None, "a"), ("s", "vol. 3 of the set", "vol. 8 of a set"), ("t", " x\u2003y ", "x y")]
    df = spark.createDataFrame(rows, "id string, reference string, hypothesis string")
    got = {}
    for x in compare.word_diff(df, limit=4).orderBy("id", "place").collect():
        assert x.place == len(got.setdefault(x.id, []))
        got[x.id].append((x.op, x.reference_words, x.hypothesis_words))
    want = {i: plain_differences(a or "", b or "")[:4] for i, a, b in rows}
    assert got == {i: w for i, w in want.items() if w} and got["s"] == [("replace", "3", "8"), ("replace", "the", "a")]


def test_differences_of_a_whole_table(spark):
    from glyphmill.plans import views

    s = views.systems(spark, "/root/testdata/sf0.001").where("system = 'adapted'").select("id", "reference", "hypothesis")
    got = {x.id: x.n for x in compare.word_diff(s, limit=1_000_000).groupBy("id").agg(F.count("*").alias("n")).collect()}
    want = {x.id: len(plain_differences(x.reference, x.hypothesis)) for x in s.collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_composition_and_folding_of_all_code_points(spark):
    """What Python's own tables say of every assigned code point, alone and before a combining mark."""
    known = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    rows = [(c,) for c in known] + [(c + "\u0323\u0301",) for c in known[::7]] + [(None,)]
    df = spark.createDataFrame(rows, "t string").select("t", tx.compose("t").alias("n"), tx.casefold("t").alias("f"), F.col("t").rlike(tx.punctuation()).alias("p"))
    for x in df.toLocalIterator():
        if x.t is None:
            assert x.n is None and x.f is None
        else:
            assert (x.n, x.f) == (unicodedata.normalize("NFC", x.t), x.t.casefold()) and x.p == any(unicodedata.category(c)[0] == "P" for c in x.t)
    assert "Python" not in df.select(tx.normalise("t"), tx.fold("t"))._jdf.queryExecution().toString()


def test_collapse_of_every_white_space_and_run(spark):
    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    texts = ["", " ", "  ", "a b", " a", "a  ", *(f"{p}{s}{q}" for s in spaces for p in ("a", "a ", " ", "a\t") for q in ("b", " b", "　b", ""))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.collapse("t"), tx.words("t", lower=False)).collect()
    assert {i: (c, list(w)) for i, c, w in got} == {i: (" ".join(t.split()), t.split()) for i, t in enumerate(texts)}


def test_a_text_that_begins_the_other_stays_in_the_jvm(spark):
    rows = [("", ""), ("abc", ""), ("", "xy"), ("añ😀", "añ😀"), ("añ😀", "añ😀 añ😀"), ("abcd", "ab"), ("th", "ht"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "r string, h string").select(tx.char_distance("r", "h").alias("d"))
    assert [x.d for x in df.collect()] == [0, 3, 2, 0, 4, 2, 2, None, None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith(" in [x for x in plan.splitlines() if "ArrowEvalPython" in x][0]


def test_one_system_is_one_row_a_line(spark):
    """A named system's lines were made for both systems and then filtered."""
    from glyphmill.plans import views

    one = views.systems(spark, "/root/testdata/sf0.001", "adapted")
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 0
    both = views.systems(spark, "/root/testdata/sf0.001").where("system = 'adapted'")
    assert one.columns == both.columns and one.exceptAll(both).count() == both.exceptAll(one).count() == 0
    words = both.select("new_tokens", F.size(tx.words("hypothesis")).alias("n")).collect()
    assert words and all(x.new_tokens == x.n for x in words)
