"""Ordered validation rules: the first violated rule of the first violating row decides."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import text as tx

# The bounds of a record, an image and a request. So is the wording of the messages below: callers and their
# reports hold refusals against it.
MIN_SIDE, MAX_SIDE, MAX_PIXELS = 16, 16384, 4096 * 4096
MIN_RECORDS, MAX_RECORDS = 8, 5000
MIN_CHARS, MAX_CHARS = 1, 512
MAX_TOKENS = 4096
ID_PATTERN = r"\A[A-Za-z0-9_.:-]{1,64}\z"
MODES = ("plain", "format")


class Refused(ValueError):
    """Input that breaks a rule; a command line shows its one line and ends with EXIT_CODE."""

    EXIT_CODE = 65


def first_violation(rules: Sequence[tuple[str, Column, Column | str]]) -> Column:
    """The message of the first rule (name, broken, message) that holds, else null."""
    out = None
    for _, broken, message in rules:
        m = F.lit(message) if isinstance(message, str) else message
        broken = F.coalesce(broken, F.lit(False))
        out = F.when(broken, m) if out is None else out.when(broken, m)
    return out


def image_rules(width: Column | str = "width", height: Column | str = "height") -> list[tuple[str, Column, Column]]:
    w, h = (F.col(x) if isinstance(x, str) else x for x in (width, height))
    low, high, area = F.least(w, h), F.greatest(w, h), w.cast("long") * h
    say = lambda a, x, b: F.concat(F.lit(a), x.cast("string"), F.lit(b))
    return [
        ("image_missing", w.isNull() | h.isNull(), F.lit("image is missing")),
        ("image_small", low < MIN_SIDE, say("image side ", low, f" px < {MIN_SIDE}")),
        ("image_large", high > MAX_SIDE, say("image side ", high, f" px > {MAX_SIDE}")),
        ("image_area", area > MAX_PIXELS, say("image area ", area, f" px > {MAX_PIXELS}")),
    ]


def record_rules(compose: bool = True) -> list[tuple[str, Column, Column]]:
    """The rules of a record (pos, id, width, height, text), in order."""
    where = F.concat(F.lit("records["), F.col("pos").cast("string"), F.lit("]"))
    say = lambda m: F.concat(where, m if isinstance(m, Column) else F.lit(m))
    n = F.length((tx.normalise if compose else tx.collapse)("text"))
    bound = F.concat(F.lit(": text has "), n.cast("string"), F.lit(f" characters after whitespace normalisation; {MIN_CHARS}..{MAX_CHARS} are required"))
    return [
        ("id", F.col("id").isNull() | ~F.col("id").rlike(ID_PATTERN), say(": id must match [A-Za-z0-9_.:-]{1,64}")),
        *((name, broken, say(F.concat(F.lit(": "), message))) for name, broken, message in image_rules()),
        ("text_missing", F.col("text").isNull(), say(": text must be a str")),
        ("text_length", (n < MIN_CHARS) | (n > MAX_CHARS), say(bound)),
    ]


def with_violations(records: DataFrame, compose: bool = True) -> DataFrame:
    """records with `violation`: the message of the first broken rule of each, duplicates of an earlier id last."""
    earlier = F.row_number().over(Window.partitionBy("id").orderBy("pos")) > 1
    marked = records.withColumn("_again", earlier & F.col("id").isNotNull())
    rules = [*record_rules(compose), ("duplicate", F.col("_again"), F.concat(F.lit("duplicate id "), F.col("id")))]
    return marked.withColumn("violation", first_violation(rules)).drop("_again")


def _manifest() -> list[Column]:
    """Counts, extremes and totals of records whose normalised text is `_t`."""
    return [
        F.count("*").alias("n_records"),
        F.min(F.length("_t")).alias("chars_min"),
        F.max(F.length("_t")).alias("chars_max"),
        F.sum(F.length("_t")).alias("chars_total"),
        F.sum(F.size(tx.words("_t", lower=False))).alias("words_total"),
        F.min("width").alias("width_min"),
        F.max("width").alias("width_max"),
        F.min("height").alias("height_min"),
        F.max("height").alias("height_max"),
    ]


def record_manifest(records: DataFrame) -> DataFrame:
    """One row: counts, extremes and totals of checked records."""
    return records.withColumn("_t", tx.normalise("text")).agg(*_manifest())


def _verdict() -> list[Column]:
    """What a dataset is judged by: its rows, and the first violation in order."""
    return [F.count("*").alias("n"), F.min_by("violation", F.when(F.col("violation").isNotNull(), F.col("pos"))).alias("first")]


def _judge(n: int, first: str | None, min_records: int, max_records: int) -> None:
    if not min_records <= n <= max_records:
        raise Refused(f"{n} records; {min_records}..{max_records} are required")
    if first:
        raise Refused(first)


def checked_write(
    records: DataFrame, write: Callable[[DataFrame], None], discard: Callable[[], None], min_records: int = MIN_RECORDS, max_records: int = MAX_RECORDS
) -> dict[str, int]:
    """Write records while they are checked: one scan, whose job also tells the counts and the first violation.

    write runs one job over the frame it is given. Of a dataset that breaks a rule nothing stays: discard() is
    called, then Refused raised. Returns the manifest's numbers otherwise.
    """
    seen = Observation()
    watched = with_violations(records).withColumn("_t", tx.normalise("text")).observe(seen, *_verdict(), *_manifest())
    try:
        write(watched.drop("violation", "_t"))
        told = seen.get
        _judge(told.pop("n"), told.pop("first"), min_records, max_records)
    except BaseException:
        discard()
        raise
    return told


def validate_dataset(records: DataFrame, min_records: int = MIN_RECORDS, max_records: int = MAX_RECORDS) -> DataFrame:
    """record_manifest() of records, or Refused with the first violation in order; one scan, which runs at once."""
    told = with_violations(records).withColumn("_t", tx.normalise("text")).agg(*_verdict(), *_manifest())
    row = told.first()
    _judge(row["n"], row["first"], min_records, max_records)
    return records.sparkSession.createDataFrame([tuple(row)[2:]], T.StructType(told.schema.fields[2:]))


def request_rules() -> list[tuple[str, Column, Column | str]]:
    """Rules of a recognition request (width, height, mode, max_new_tokens)."""
    mode = F.concat(F.lit("mode "), F.coalesce("mode", F.lit("null")), F.lit(f" is not one of {MODES}"))
    tokens = F.col("max_new_tokens")
    return [
        *image_rules(),
        ("mode", F.col("mode").isNull() | ~F.col("mode").isin(*MODES), mode),
        ("tokens", tokens.isNull() | (tokens < 1) | (tokens > MAX_TOKENS), f"max_new_tokens must be between 1 and {MAX_TOKENS}"),
    ]


def name_rule() -> tuple[str, Column, Column | str]:
    """A request that brings names brings one: it is one image's."""
    return "names", F.col("names").isNotNull() & (F.size("names") != 1), "names must hold exactly one name, as a request is one image"


def validate_requests(requests: DataFrame) -> DataFrame:
    """requests with finding (null if accepted) and verdict; the rule for names holds where there is such a column.

    An empty list of names breaks it, a null one does not.
    """
    named = [name_rule()] if "names" in requests.columns else []
    found = requests.withColumn("finding", first_violation([*request_rules(), *named]))
    return found.withColumn("verdict", F.when(F.col("finding").isNull(), "accepted").otherwise("rejected"))


def output_rules(stop: str) -> list[tuple[str, Column, Column | str]]:
    """Rules of recogniser output (text, truncated)."""
    return [
        ("text", F.col("text").isNull(), "text must be a str"),
        ("stop", F.col("text").contains(stop), "text holds the stop string"),
        ("truncated", F.col("truncated"), "output was cut at the token budget"),
    ]


def adapter_rules(fmt: str, base: Mapping[str, str], weights: str, prefixes: Sequence[str]) -> list[tuple[str, Column, Column | str]]:
    """Rules of an adapter manifest row (format, base, files, tensors) with its file's measured bytes and sha256."""
    file = F.get("files", 0)
    differs = lambda a, b: ~a.eqNullSafe(F.lit(b) if isinstance(b, str) else b)
    foreign = F.exists("tensors", lambda n: ~F.coalesce(n.rlike(r"\A(?:" + "|".join(map(_literal, prefixes)) + ")"), F.lit(False)))
    return [
        ("format", differs(F.col("format"), fmt), f"artifact format is not {fmt}"),
        ("base", differs(F.col("base.model_id"), base["model_id"]) | differs(F.col("base.revision"), base["revision"]), "artifact was trained on another base"),
        ("digest", differs(F.col("base.weight_sha256"), base["weight_sha256"]), "artifact base weight digest does not match"),
        ("files", (F.coalesce(F.size("files"), F.lit(-1)) != 1) | differs(file["path"], weights), f"artifact manifest must list exactly {weights}"),
        ("missing", F.col("bytes").isNull(), "artifact weights missing"),
        ("size", differs(file["bytes"], F.col("bytes")), "size differs from the manifest"),
        ("sha256", differs(file["sha256"], F.col("sha256")), "sha256 differs from the manifest"),
        ("tensors", F.coalesce(F.size("tensors"), F.lit(-1)).isin(-1, 0) | foreign, "artifact tensors must all belong to the trainable layers"),
    ]


def tensor_findings(listed: DataFrame, trainable: DataFrame, stored: DataFrame) -> DataFrame:
    """(artifact, name, finding) of each tensor that manifest, model and file do not all know, by one full match.

    Inputs (artifact, name): what manifests list, what the model trains, what the weight files hold. A name that the
    manifest and the model do not share is judged before the file. Repeated rows count once; names are case-sensitive; rows without an artifact
    or a name match nothing and are left out. Empty inputs give no findings of their own.
    """
    sides = {"in_manifest": listed, "in_model": trainable, "in_file": stored}
    all_ = None
    for side, df in sides.items():
        rows = df.where("artifact is not null and name is not null").select("artifact", "name", *(F.lit(s == side).alias(s) for s in sides))
        all_ = rows if all_ is None else all_.unionByName(rows)
    known = all_.groupBy("artifact", "name").agg(*(F.max(s).alias(s) for s in sides))
    finding = (
        F.when(~F.col("in_manifest") & F.col("in_model"), "trained by the model, not listed")
        .when(F.col("in_manifest") & ~F.col("in_model"), "listed, not trained by the model")
        .when(F.col("in_manifest") & ~F.col("in_file"), "listed, not in the file")
        .when(~F.col("in_manifest"), "in the file alone")
    )
    return known.withColumn("finding", finding).where("finding is not null").select("artifact", "name", "finding")


def unknown_keys(given: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of given(run, key) whose key is none of known(key); null keys are unknown, repeated rows come back each."""
    return given.join(known.select(F.col("key").alias("_known")), F.col("key") == F.col("_known"), "left_anti")


def _literal(s: str) -> str:
    return r"\Q" + s + r"\E"


def check_all(df: DataFrame, rules: Sequence[tuple[str, Column, Column | str]], order: str) -> None:
    """Refused with the first message in order, if any rule is broken."""
    message = df.select(F.col(order).alias("o"), first_violation(rules).alias("m")).where("m is not null").agg(F.min_by("m", "o")).first()[0]
    if message:
        raise Refused(message)


# Closed bounds of a training run's parameters, and those that are whole numbers.
PARAMETER_BOUNDS = {"epochs": (1, 50), "learning_rate": (1e-12, 1e-2), "batch_size": (1, 32), "min_gain": (0, 1 - 1e-12)}
WHOLE_PARAMETERS = ("epochs", "batch_size")


def parameter_rules(*names: str) -> list[tuple[str, Column, Column]]:
    """Rules of the named parameter columns of a table of runs, in order."""
    out = []
    for name in names:
        low, high = PARAMETER_BOUNDS[name]
        broken = F.col(name).isNull() | ~F.col(name).between(low, high)
        out.append((name, broken, F.concat(F.lit(f"{name} must be between {low} and {high}, got "), F.coalesce(F.col(name).cast("string"), F.lit("null")))))
    return out


def check_parameters(values: Mapping[str, float], bounds: Mapping[str, tuple[float, float]], whole: Sequence[str] = ()) -> None:
    """Refused unless each value is a number within its closed bounds; names in whole take integers only."""
    for name, value in values.items():
        low, high = bounds[name]
        kind = int if name in whole else (int, float)
        if isinstance(value, bool) or not isinstance(value, kind) or not low <= value <= high:
            raise Refused(f"{name} must be between {low} and {high}, got {value!r}")


def check_keys(given: Mapping[str, object], known: Sequence[str]) -> None:
    if extra := sorted(set(given) - set(known)):
        raise Refused(f"unknown settings: {extra}")


def run_refusing(action: Callable[[], object], show: Callable[[str], object] = print) -> int:
    """0, or for refused input one line and the exit code of a refusal; other errors keep their traceback."""
    try:
        action()
    except Refused as e:
        show(f"REFUSED: {e}")
        return Refused.EXIT_CODE
    return 0
