"""Text measures and markup functions as Spark columns; but for edit distances all stay in the JVM."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import edits

#: Python's 29 white-space characters as a Java pattern.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: A run of them that is not one plain space.
_RUN = r"(?U)[\s\x1c-\x1f](?:[\s\x1c-\x1f]++|(?<! ))"
#: Code points below U+0300 are composed already.
_COMPOSED = "^[\\x{0}-\\x{2ff}]*$"
#: Latin-1 but for the micro sign, which folds to a Greek letter.
_PLAIN = "^[\\x{0}-\\x{b4}\\x{b6}-\\x{ff}]*$"

# Element tags, table tokens and the largest location of the markup.
ELEMENT_TAGS = (
    "section_header_level_1", "section_header_level_2", "section_header_level_3",
    "text", "paragraph", "list_item", "ordered_list", "unordered_list", "otsl", "picture", "caption",
    "formula", "code", "page_header", "page_footer", "footnote", "chart", "key_value_region",
)
CELL_TOKENS = ("fcel", "ecel", "ched", "rhed", "srow")
MERGE_TOKENS = ("lcel", "ucel", "xcel")
ROW_TOKEN = "nl"
LAST_LOCATION = 500
_TAG, _LOC = "</?([a-z_]+(?:_[0-9]+)?)>", "<loc_([0-9]+)>"
_OPEN_TAG, _CLOSE_TAG = "<([a-z_]+(?:_[0-9]+)?)>", "</([a-z_]+(?:_[0-9]+)?)>"
_PARTIAL = "</?[a-z_]*[0-9]*\\z"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once, however often f uses it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), f), 0)


def collapse(text: Column | str) -> Column:
    """White-space runs as one space, ends stripped; only runs other than one space are replaced."""
    return F.trim(F.regexp_replace(_c(text), _RUN, " "))


def _icu(name: str, method: str, text: Column, flag: bool) -> Column:
    """A static method (string, boolean) of the Unicode library that Spark itself uses for collations."""
    return F.java_method(F.lit(name), F.lit(method), F.coalesce(text, F.lit("")), F.lit(flag))


def compose(text: Column | str) -> Column:
    """Unicode NFC; texts without code points from U+0300 on are composed as they are."""
    text = _c(text)
    return F.when(text.rlike(_COMPOSED) | text.isNull(), text).otherwise(_icu("com.ibm.icu.text.Normalizer", "compose", text, False))


def casefold(text: Column | str) -> Column:
    """Full Unicode case folding."""
    text = _c(text)
    return F.when(text.isNotNull(), _icu("com.ibm.icu.lang.UCharacter", "foldCase", text, True))


@functools.cache
def punctuation() -> str:
    """A pattern of all code points of category P, as ranges; the JVM's own class knows an older Unicode."""
    points = [i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "P"]
    ranges = [[points[0], points[0]]]
    for i in points[1:]:
        if i == ranges[-1][1] + 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def normalise(text: Column | str) -> Column:
    """Composed (NFC) and collapsed."""
    return collapse(compose(text))


def collapsed_words(text: Column | str) -> Column:
    """Words of a text that is collapsed already; none for an empty text."""
    return F.array_remove(F.split(_c(text), " "), "")


def n_words(text: Column | str) -> Column:
    """How many words a text has that is collapsed already: one more than its spaces."""
    text = _c(text)
    return F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def words(text: Column | str, lower: bool = True) -> Column:
    """Words of a text, split at white space; none for an empty text."""
    text = collapse(text)
    return collapsed_words(F.lower(text) if lower else text)


def _together(f: Callable) -> Callable:
    """f of two columns as a function of Spark, for several Arrow batches at once."""

    def of_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return edits.together(f, batches)

    return F.arrow_udf(of_batches, T.IntegerType())


_text_distance = _together(edits.of_texts)
_list_distance = _together(edits.of_lists)
_words_distance = _together(edits.of_words)
_list_shared = F.arrow_udf(edits.shared, T.IntegerType())


def char_distance(reference: Column | str, hypothesis: Column | str) -> Column:
    """Unit-cost edits between code points, worked out for whole Arrow batches of pairs.

    Where one text begins the other (is empty, or the same), their lengths tell, and neither goes to Python; this
    is for columns given by name, as others would be worked out more than once.
    """
    r, h = _c(reference), _c(hypothesis)
    if not (isinstance(reference, str) and isinstance(hypothesis, str)):
        return _text_distance(r, h)
    begins = F.startswith(r, h) | F.startswith(h, r)
    other = _text_distance(F.when(~begins, r), F.when(~begins, h))
    return F.when(begins, F.abs(F.length(r) - F.length(h))).otherwise(other)


def word_distance(reference: Column | str, hypothesis: Column | str) -> Column:
    """Unit-cost edits between the items of two arrays of strings, however many different ones there are."""
    return _list_distance(_c(reference), _c(hypothesis))


def text_word_distance(reference: Column | str, hypothesis: Column | str) -> Column:
    """word_distance() of the words of two collapsed texts, which go to Python as they are."""
    return _words_distance(_c(reference), _c(hypothesis))


def shared_words(reference: Column | str, hypothesis: Column | str) -> Column:
    """Items that two arrays of strings have in common, as often as both hold them."""
    return _list_shared(_c(reference), _c(hypothesis))


def character_error_rate(reference: Column | str, hypothesis: Column | str) -> Column:
    """Edits over reference characters after normalise(); uncapped; an empty reference raises."""
    r, h = normalise(reference), normalise(hypothesis)
    return F.when(r == "", F.raise_error(F.lit("reference must contain at least one character")).cast("double")).otherwise(char_distance(r, h) / F.length(r))


def word_error_rate(reference: Column | str, hypothesis: Column | str) -> Column:
    """Edits over reference words, lower-cased and not composed; uncapped; no reference word raises."""
    r, h = words(reference), words(hypothesis)
    return F.when(F.size(r) == 0, F.raise_error(F.lit("reference must contain at least one word")).cast("double")).otherwise(word_distance(r, h) / F.size(r))


def fold(text: Column | str) -> Column:
    """Composed, case-folded and without punctuation (Unicode category P), collapsed; exact for any text."""
    text = _c(text)
    whole = collapse(F.regexp_replace(casefold(normalise(text)), punctuation(), ""))
    return F.when(text.rlike(_PLAIN), fold_plain(text)).otherwise(whole)


def fold_plain(text: Column | str) -> Column:
    """fold() in the JVM: lower case, sharp s as ss, Java's punctuation class; exact for Latin-1 texts."""
    x = F.regexp_replace(F.lower(collapse(text)), "ß", "ss")
    return collapse(F.regexp_replace(x, r"\p{P}", ""))


def error_category(cer: Column | str, ratio: Column | str, empty: Column | str, truncated: Column | str) -> Column:
    """The first that holds: truncated, empty, runaway_or_hallucinated, exact, mostly_correct, partial, severe."""
    cer = _c(cer)
    return (
        F.when(_c(truncated), "truncated")
        .when(_c(empty), "empty")
        .when(_c(ratio) > 1.5, "runaway_or_hallucinated")
        .when(cer == 0, "exact")
        .when(cer < 0.2, "mostly_correct")
        .when(cer < 0.8, "partial")
        .otherwise("severe")
    )


def markup_to_text(markup: Column | str) -> Column:
    """Location, table and other complete tags as spaces, collapsed."""
    table = "<(?:" + "|".join((*CELL_TOKENS, *MERGE_TOKENS, ROW_TOKEN)) + ")>"
    x = _c(markup)
    for pattern in (_LOC, table, _TAG):
        x = F.regexp_replace(x, pattern, " ")
    return collapse(x)


def strip_partial_markup(text: Column | str, collapsed: bool = False) -> Column:
    """struct(text, fragment): the text without one unfinished tag at its end, and that tag; collapsed tells that the text is so already."""
    x = _c(text) if collapsed else collapse(text)
    fragment = F.regexp_extract(x, _PARTIAL, 0)
    # A collapsed text without its end has at most one space to lose.
    return F.struct(F.trim(F.regexp_replace(x, _PARTIAL, "")).alias("text"), fragment.alias("fragment"))


def _names(markup: Column, pattern: str) -> Column:
    return F.regexp_extract_all(markup, F.lit(pattern), F.lit(1))


def _locations(markup: Column) -> Column:
    return F.transform(_names(markup, _LOC), lambda v: v.cast("decimal(38,0)"))


def markup_failures(markup: Column | str) -> Column:
    """struct(unbalanced, malformed): element tags that open and close unequally often; locations not in fours or over 500."""
    x = _c(markup)
    n = lambda names, tag: F.size(F.filter(names, lambda v: v == tag))
    tags = F.array(*map(F.lit, ELEMENT_TAGS))
    found = F.struct(_names(x, _OPEN_TAG).alias("opened"), _names(x, _CLOSE_TAG).alias("closed"), _locations(x).alias("locs"))
    return _bound(
        found,
        lambda f: F.struct(
            F.exists(tags, lambda t: n(f["opened"], t) != n(f["closed"], t)).alias("unbalanced"),
            ((F.size(f["locs"]) % 4 != 0) | F.exists(f["locs"], lambda v: v > LAST_LOCATION)).alias("malformed"),
        ),
    )


def markup_summary(markup: Column | str) -> Column:
    """struct of element counts, locations and table geometry; a location over 500 raises."""
    x = _c(markup)
    tokens = (*CELL_TOKENS, *MERGE_TOKENS, ROW_TOKEN)

    def summary(f: Column) -> Column:
        opened, locs = f["opened"], f["locs"]
        n = lambda tag: F.size(F.filter(opened, lambda v: v == tag))
        total = lambda tags: F.size(F.filter(opened, lambda v: v.isin(*tags)))
        counts = lambda tags: F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*(n(F.lit(t)) for t in tags)))
        bad = F.exists(locs, lambda v: v > LAST_LOCATION)
        return F.struct(
            counts(ELEMENT_TAGS).alias("counts"),
            total(ELEMENT_TAGS).alias("n_elements"),
            F.when(bad, F.raise_error(F.lit("loc token outside 0..500")).cast("int")).otherwise(F.size(locs)).alias("n_loc_tokens"),
            F.floor(F.size(locs) / 4).cast("int").alias("n_location_groups"),
            (F.size(locs) % 4 == 0).alias("loc_tokens_divisible_by_4"),
            total(CELL_TOKENS).alias("n_table_cells"),
            n(F.lit(ROW_TOKEN)).alias("n_table_rows"),
            total(CELL_TOKENS + MERGE_TOKENS).alias("n_table_grid_positions"),
            total(tokens).alias("n_otsl_tokens"),
            counts(tokens).alias("otsl_token_counts"),
            (F.ltrim(x).startswith("<doctag>") & F.rtrim(x).endswith("</doctag>")).alias("wrapped_in_doctag"),
            F.length(x).alias("n_chars"),
        )

    return _bound(F.struct(_names(x, _OPEN_TAG).alias("opened"), _locations(x).alias("locs")), summary)


def preview(text: Column | str, n: int) -> Column:
    """The first n characters and how many follow."""
    x = _c(text)
    more = F.length(x) - n
    return F.when(more <= 0, x).otherwise(F.concat(F.substring(x, 1, n), F.lit(" ... ("), more.cast("string"), F.lit(" more characters)")))


def safe_identifier(value: Column | str) -> Column:
    """Whether a stripped value is usable as a file-safe identifier."""
    x = F.trim(_c(value))
    return (x != "") & ~x.isin(".", "..") & ~x.rlike(r"[/\\:\x00]")


def id_from_file(name: Column | str) -> Column:
    """An identifier from a file's stem: other characters as underscores, 64 at most."""
    stem = F.regexp_replace(F.regexp_replace(_c(name), "^.*/", ""), r"(?<=.)\.[^.]*\z", "")
    return F.substring(F.regexp_replace(stem, "[^A-Za-z0-9_.:-]", "_"), 1, 64)


def clean_output(text: Column | str, stop: str) -> Column:
    """A recogniser's text without its stop string, stripped."""
    return F.regexp_replace(F.replace(_c(text), F.lit(stop), F.lit("")), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def generated_length(tokens: Column | str, stops: list[int]) -> Column:
    """Tokens up to and with the first stop token, or all."""
    x = _c(tokens)
    at = F.array_position(F.transform(x, lambda t: t.isin(stops)), F.lit(True))
    return F.when(at > 0, at).otherwise(F.size(x)).cast("int")


def truncated(n_tokens: Column | str, budget: Column | int) -> Column:
    return _c(n_tokens) >= (F.lit(budget) if isinstance(budget, int) else budget)


def format_counts(text: Column | str, characters: str = "#*|$\\") -> Column:
    """struct of the counts of format characters and the number of lines."""
    x = _c(text)
    count = lambda c: (F.length(x) - F.length(F.replace(x, F.lit(c), F.lit(""))))
    marks = F.map_from_arrays(F.array(*map(F.lit, characters)), F.array(*map(count, characters)))
    return F.struct(marks.alias("characters"), F.size(F.split(x, "\n")).alias("lines"))


def wrapped(text: Column | str, width: int) -> Column:
    """Words in lines of at most width characters (a longer word alone), as an array."""
    none = F.array().cast("array<string>")

    def add(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.length(last) + 1 + F.length(w) <= width)
        joined = F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat_ws(" ", last, w)))
        return F.when(F.size(lines) == 0, F.array(w)).when(fits, joined).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(words(text, lower=False), none, add)


def payload_digest(width: Column | str, height: Column | str, payload: Column | str) -> Column:
    """SHA-256 of `{width}x{height}:` and the payload's bytes: the identity of an image."""
    head = F.concat(_c(width).cast("string"), F.lit("x"), _c(height).cast("string"), F.lit(":"))
    return F.sha2(F.concat(F.encode(head, "UTF-8"), _c(payload).cast("binary")), 256)
