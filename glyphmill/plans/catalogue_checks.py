"""The query catalogue, second part: text helpers, validation, joins, selection and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as tx
from glyphmill.operators import compare, curate, metrics, rules, runner, select
from glyphmill.plans import views as v
from glyphmill.plans.catalogue import _r, query
from glyphmill.sources import readers, sinks

# ---------------------------------------------------------------- text measures and helpers


@query(f"WITH {v.SCORED_SQL} SELECT id, round(cer, 9) AS cer FROM scored WHERE system = 'frozen'")
def character_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.systems(spark, sf_dir, "frozen")
    return s.select("id", F.round(tx.character_error_rate("reference", "hypothesis"), 9).alias("cer"))


@query(f"""WITH {v.SYSTEMS_SQL}, w AS (SELECT id, {v.words_sql('reference')} AS r, {v.words_sql('hypothesis')} AS h FROM systems WHERE system = 'adapted')
SELECT id, round({v.word_distance_sql('r', 'h')} / len(r), 9) AS wer FROM w""")
def word_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.systems(spark, sf_dir, "adapted")
    return s.select("id", F.round(tx.word_error_rate("reference", "hypothesis"), 9).alias("wer"))


@query(f"""WITH {v.SYSTEMS_SQL}, b AS (SELECT id, CASE WHEN pos % 5 = 0 THEN '' ELSE reference END AS r, hypothesis AS h FROM systems WHERE system = 'adapted')
SELECT id, length(r) AS ref_chars, length(h) AS hyp_chars, CASE WHEN r = '' THEN length(h) ELSE {v.distance_sql('r', 'h')} END::bigint AS char_edits, r = h AS exact,
  CASE WHEN r <> '' THEN round({v.distance_sql('r', 'h')} / length(r), 9) END AS cer, CASE WHEN r = '' THEN 'Empty reference: rates have zero denominators' END AS rate_reason FROM b""")
def blank_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.systems(spark, sf_dir, "adapted")
    s = s.withColumn("reference", F.when(F.col("pos") % 5 == 0, "  ").otherwise(F.col("reference")))
    return metrics.pair_metrics(s).select("id", "ref_chars", "hyp_chars", "char_edits", "exact", _r("cer"), "rate_reason")


_MARKUP_SQL = """marked AS (SELECT page_id, '<doctag>' || replace(replace(replace(html, '<p>', '<text>'), '<td>', '<fcel>'), '</tr>', '<nl>') || '<loc_' || page_id % 501 || '></doctag>' AS m FROM pages)"""
_IN = lambda names: "[" + ", ".join(f"'{t}'" for t in names) + "]"


def _markup() -> Column:
    m = F.col("html")
    for a, b in (("<p>", "<text>"), ("<td>", "<fcel>"), ("</tr>", "<nl>")):
        m = F.replace(m, F.lit(a), F.lit(b))
    return F.concat(F.lit("<doctag>"), m, F.lit("<loc_"), (F.col("page_id") % 501).cast("string"), F.lit("></doctag>"))


@query(f"""WITH {_MARKUP_SQL}, n AS (SELECT page_id, m, regexp_extract_all(m, '<([a-z_]+(?:_[0-9]+)?)>', 1) AS o, regexp_extract_all(m, '<loc_([0-9]+)>', 1) AS l FROM marked)
SELECT page_id, len(list_filter(o, lambda x: list_contains({_IN(tx.ELEMENT_TAGS)}, x))) AS n_elements, len(list_filter(o, lambda x: x = 'text')) AS n_text, len(l) AS n_loc_tokens,
  len(l) // 4 AS n_location_groups, len(l) % 4 = 0 AS loc_tokens_divisible_by_4, len(list_filter(o, lambda x: list_contains({_IN(tx.CELL_TOKENS)}, x))) AS n_table_cells,
  len(list_filter(o, lambda x: x = 'nl')) AS n_table_rows, len(list_filter(o, lambda x: list_contains({_IN(tx.CELL_TOKENS + tx.MERGE_TOKENS)}, x))) AS n_table_grid_positions,
  true AS wrapped_in_doctag, length(m) AS n_chars FROM n""")
def markup_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.table(spark, sf_dir, "pages").select("page_id", tx.markup_summary(_markup()).alias("s"))
    kept = ("n_elements", "n_loc_tokens", "n_location_groups", "loc_tokens_divisible_by_4", "n_table_cells", "n_table_rows", "n_table_grid_positions", "wrapped_in_doctag", "n_chars")
    return s.select("page_id", F.col("s.counts")["text"].alias("n_text"), *(f"s.{c}" for c in kept))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || ' ... (' || (length(text) - 80) || ' more characters)' END AS preview FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", tx.preview("text", 80).alias("preview"))


_NAMES_SQL = """named AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '..' WHEN 1 THEN url WHEN 2 THEN '  ' WHEN 3 THEN 'p:' || page_id WHEN 4 THEN ' page-' || page_id || '.png' ELSE '.' END AS value FROM pages)"""


@query(rf"WITH {_NAMES_SQL} SELECT page_id, value, trim(value) <> '' AND trim(value) NOT IN ('.', '..') AND NOT regexp_matches(value, '[/\\:]') AS safe FROM named")
def safe_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    value = F.when(n % 6 == 0, "..").when(n % 6 == 1, F.col("url")).when(n % 6 == 2, "  ").when(n % 6 == 3, F.concat(F.lit("p:"), n.cast("string")))
    value = value.when(n % 6 == 4, F.concat(F.lit(" page-"), n.cast("string"), F.lit(".png"))).otherwise(".")
    return v.table(spark, sf_dir, "pages").select("page_id", value.alias("value")).withColumn("safe", tx.safe_identifier("value"))


@query(r"""SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(f, '^.*/', ''), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9_.:-]', '_', 'g'), 64) AS id
FROM (SELECT page_id, url || '/Ärger & ' || url || page_id || '.tar.png' AS f FROM pages)""")
def ids_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("url", F.lit("/Ärger & "), "url", F.col("page_id").cast("string"), F.lit(".tar.png"))
    return v.table(spark, sf_dir, "pages").select("page_id", tx.id_from_file(name).alias("id"))


@query(f"""WITH {v.LINES_SQL}, t AS (SELECT id, list_transform({v.words_sql('text')}, lambda w: length(w)) AS t FROM lines)
SELECT id, coalesce(nullif(list_position(list_transform(t, lambda x: x IN (3, 7)), true), 0), len(t))::bigint AS n_tokens FROM t""")
def generated_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths stand in for tokens, 3 and 7 for the stop tokens."""
    t = F.transform(tx.words("text"), lambda w: F.length(w))
    return v.lines(spark, sf_dir).select("id", tx.generated_length(t, [3, 7]).alias("n_tokens"))


@query("""SELECT doc_id, """ + ", ".join(f"length(text) - length(replace(text, '{c}', '')) AS {n}" for c, n in (("#", "hashes"), ("*", "stars"), ("|", "bars"), ("$", "dollars"))) + """, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents""")
def format_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.table(spark, sf_dir, "documents").select("doc_id", tx.format_counts("text").alias("f"))
    return d.select("doc_id", *(F.col("f.characters")[c].alias(n) for c, n in (("#", "hashes"), ("*", "stars"), ("|", "bars"), ("$", "dollars"))), "f.lines")


@query(f"""WITH {v.LINES_SQL}, w AS (SELECT id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM lines)
SELECT id, array_to_string(list_reduce(w, lambda acc, x: CASE WHEN len(acc) > 0 AND length(acc[-1]) + 1 + length(x) <= 40 THEN list_append(list_slice(acc, 1, len(acc) - 1), acc[-1] || ' ' || x)
  ELSE list_append(acc, x) END, []::varchar[]), chr(10)) AS wrapped FROM w""")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.lines(spark, sf_dir).select("id", F.array_join(tx.wrapped("text", 40), "\n").alias("wrapped"))


@query("SELECT page_id, sha256((page_id % 400 + 12) || 'x64:' || html) AS digest FROM pages")
def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "pages").select("page_id", tx.payload_digest(F.col("page_id") % 400 + 12, F.lit(64), F.encode("html", "UTF-8")).alias("digest"))


# ---------------------------------------------------------------- validation


@query(f"""WITH {v.RECORDS_SQL}, t AS (SELECT *, {v.collapse_sql('nfc_normalize(text)')} AS t FROM records)
SELECT count(*) AS n_records, min(length(t)) AS chars_min, max(length(t)) AS chars_max, sum(length(t))::bigint AS chars_total,
  sum(len(list_filter(string_split(t, ' '), lambda w: w <> '')))::bigint AS words_total, min(width) AS width_min, max(width) AS width_max, min(height) AS height_min, max(height) AS height_max FROM t""")
def record_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.record_manifest(v.records(spark, sf_dir))


_VIOLATION_SQL = """CASE WHEN NOT regexp_full_match(id, '[A-Za-z0-9_.:-]{1,64}') THEN 'records[' || pos || ']: id must match [A-Za-z0-9_.:-]{1,64}'
  WHEN least(width, height) < 16 THEN 'records[' || pos || ']: image side ' || least(width, height) || ' px < 16'
  WHEN n < 1 OR n > 512 THEN 'records[' || pos || ']: text has ' || n || ' characters after whitespace normalisation; 1..512 are required'
  WHEN again THEN 'duplicate id ' || id END"""


@query(f"""WITH {v.RECORDS_SQL}, parts AS (SELECT *, pos % 3 AS part, length({v.collapse_sql('nfc_normalize(text)')}) AS n FROM records WHERE pos % 3 < 2 AND (pos % 3 = 0 OR (pos % 97 <> 0 AND width >= 16))),
t AS (SELECT *, row_number() OVER (PARTITION BY part, id ORDER BY pos) > 1 AS again FROM parts), x AS (SELECT part, pos, {_VIOLATION_SQL} AS m FROM t)
SELECT part, count(*) AS n, CASE WHEN NOT count(*) BETWEEN 8 AND 1000000000 THEN count(*) || ' records; 8..1000000000 are required' ELSE arg_min(m, pos) FILTER (m IS NOT NULL) END AS refusal FROM x GROUP BY part""")
def dataset_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validate_dataset() says of two datasets: all records of pos % 3 = 0, those of 1 that have valid ids and sides."""
    r = v.records(spark, sf_dir)
    said = []
    for part, rows in ((0, r.where("pos % 3 = 0")), (1, r.where("pos % 3 = 1 and pos % 97 != 0 and width >= 16"))):
        try:
            rules.validate_dataset(rows, max_records=1_000_000_000)
            refusal = None
        except rules.Refused as e:
            refusal = str(e)
        said.append(rows.agg(F.lit(part).cast("long").alias("part"), F.count("*").alias("n"), F.lit(refusal).cast("string").alias("refusal")))
    return said[0].unionByName(said[1])


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'artifact format is not adapter-1' WHEN page_id % 11 = 0 THEN 'artifact was trained on another base'
  WHEN page_id % 13 = 0 THEN 'artifact base weight digest does not match' WHEN page_id % 5 = 0 THEN 'artifact manifest must list exactly w.bin' WHEN page_id % 17 = 0 THEN 'artifact weights missing'
  WHEN length(html) % 3 = 0 THEN 'size differs from the manifest' WHEN length(html) % 3 = 1 AND page_id % 2 = 0 THEN 'sha256 differs from the manifest'
  WHEN page_id % 19 = 0 THEN 'artifact tensors must all belong to the trainable layers' END AS finding FROM pages""")
def adapter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.col("page_id"), F.length("html").cast("long")
    pick = lambda k, a, b: F.when(p % k == 0, a).otherwise(b)
    sha = F.sha2("html", 256)
    file = F.struct(pick(5, "x.bin", "w.bin").alias("path"), n.alias("bytes"), sha.alias("sha256"))
    rows = v.table(spark, sf_dir, "pages").select(
        "page_id",
        pick(7, "other", "adapter-1").alias("format"),
        F.struct(pick(11, "m2", "m1").alias("model_id"), F.lit("r1").alias("revision"), pick(13, "d2", "d1").alias("weight_sha256")).alias("base"),
        F.array(file).alias("files"),
        F.when(p % 17 != 0, n + (n % 3 == 0).cast("long")).alias("bytes"),
        F.when((n % 3 == 1) & (p % 2 == 0), "0").otherwise(sha).alias("sha256"),
        F.array(F.lit("layers.1.w"), pick(19, "head.w", "layers.2.w")).alias("tensors"),
    )
    checks = rules.adapter_rules("adapter-1", {"model_id": "m1", "revision": "r1", "weight_sha256": "d1"}, "w.bin", ["layers."])
    return rows.select("page_id", rules.first_violation(checks).alias("finding"))


@query(f"""WITH {v.SYSTEMS_SQL} SELECT id, system, CASE WHEN pos % 9 = 0 THEN 'text must be a str' WHEN pos % 4 = 0 THEN 'text holds the stop string' WHEN truncated THEN 'output was cut at the token budget' END AS finding FROM systems""")
def output_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.systems(spark, sf_dir)
    said = F.when(F.col("pos") % 9 == 0, F.lit(None).cast("string")).when(F.col("pos") % 4 == 0, F.concat("hypothesis", F.lit("<|end|>"))).otherwise(F.col("hypothesis"))
    return s.withColumn("text", said).select("id", "system", rules.first_violation(rules.output_rules("<|end|>")).alias("finding"))


@query("""SELECT c_custkey AS run, CASE WHEN NOT c_custkey % 60 BETWEEN 1 AND 50 THEN 'epochs must be between 1 and 50, got ' || c_custkey % 60
  WHEN NOT c_custkey % 40 BETWEEN 1 AND 32 THEN 'batch_size must be between 1 and 32, got ' || c_custkey % 40 END AS finding FROM customer""")
def parameter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys stand in for the settings of training runs."""
    k = F.col("c_custkey").cast("long")
    runs = v.table(spark, sf_dir, "customer").select(k.alias("run"), (k % 60).alias("epochs"), (k % 40).alias("batch_size"))
    return runs.select("run", rules.first_violation(rules.parameter_rules("epochs", "batch_size")).alias("finding"))


# ---------------------------------------------------------------- joins and inputs


@query(f"WITH {v.SYSTEMS_SQL} SELECT id, reference, hypothesis FROM systems WHERE system = 'adapted'")
def paired_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = v.systems(spark, sf_dir, "adapted").select("id", F.col("hypothesis").alias("text"))
    return metrics.join_hypotheses(v.lines(spark, sf_dir).select("id", "text"), said).select("id", "reference", "hypothesis")


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest of all pages, and the files on disk: some missing, longer or changed."""
    p, n = F.col("page_id"), F.length("html").cast("long")
    path, sha = F.concat_ws("#", "url", p.cast("string")), F.sha2("html", 256)
    pages = v.table(spark, sf_dir, "pages")
    manifest = pages.select(path.alias("path"), n.alias("bytes"), sha.alias("sha256"))
    disk = pages.where("page_id % 11 != 0").select(path.alias("path"), (n + (p % 5 == 0).cast("long")).alias("bytes"), F.when(p % 7 == 0, "0").otherwise(sha).alias("sha256"))
    return manifest, disk


@query("""SELECT url || '#' || page_id AS path, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'size' ELSE 'sha256' END AS problem
FROM pages WHERE page_id % 11 = 0 OR page_id % 5 = 0 OR page_id % 7 = 0""")
def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.manifest_problems(*_files(spark, sf_dir))


@query("SELECT url || '#' || page_id AS path, length(html) AS bytes, sha256(html) AS sha256 FROM pages WHERE page_id % 11 = 0")
def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.missing_files(*_files(spark, sf_dir))


@query("SELECT url || '#' || page_id AS path FROM pages WHERE page_id % 11 = 0")
def missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, disk = _files(spark, sf_dir)
    return sinks.missing_outputs(manifest.select("path"), disk)


@query("SELECT count(*) AS n_files, sum(length(n_name))::bigint AS total_bytes FROM nation")
def verified_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand in for the files of a model's snapshot."""
    files = v.table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.length("n_name").cast("long").alias("bytes"), F.sha2("n_name", 256).alias("sha256"))
    manifest = files.agg(F.lit("m").alias("modelId"), F.lit("r").alias("revision"), F.collect_list(F.struct("path", "bytes", "sha256")).alias("files"))
    return readers.verify_snapshot(manifest, files, "m", "r")


@query(f"""SELECT 'line-' || doc_id AS id, {v.collapse_sql('nfc_normalize(text)')} AS text, doc_id // 100 AS source_row_group, doc_id AS pos FROM documents WHERE {v.collapse_sql('text')} <> ''""")
def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("row_group"), (F.col("doc_id") % 100).alias("pos"), F.encode("text", "UTF-8").alias("image"), "text")
    return readers.read_corpus(d).drop("image")


@query(f"WITH {v.RECORDS_SQL} SELECT pos, digest FROM records WHERE pos % 4 = 0")
def reloaded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = v.records(spark, sf_dir).select("pos", F.col("pos").cast("string").alias("id"), "digest")
    return readers.reload_split(r.where("pos % 4 = 0"), r.select("id", "digest")).select("pos", "digest")


@query("""SELECT source AS name FROM documents GROUP BY source HAVING max(doc_id) % 3 <> 0""")
def stale_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand in for stage states; two in three have a newer digest than the recorded one."""
    now = v.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.max("doc_id").alias("m"))
    digest = F.sha2(F.concat_ws(":", "name", F.col("m").cast("string")), 256)
    recorded = now.select("name", F.when(F.col("m") % 3 == 0, digest).otherwise(F.sha2("name", 256)).alias("digest"))
    return sinks.stale_inputs(now.select("name", digest.alias("digest")), recorded)


@query(f"""WITH {v.SCORED_SQL} SELECT f.id, f.reference, f.hypothesis AS frozen_text, a.hypothesis AS adapted_text, round(f.cer, 6) AS frozen_cer, round(a.cer, 6) AS adapted_cer
FROM scored f JOIN scored a USING (id) WHERE f.system = 'frozen' AND a.system = 'adapted'""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's JSON lines, read again."""
    s = v.scored(spark, sf_dir)
    lines = sinks.report(s.where("system = 'frozen'"), s.where("system = 'adapted'"))
    x = F.from_json("line", "reference string, frozen struct<hypothesis: string, cer: double>, adapted struct<hypothesis: string, cer: double>")
    out = lines.select("id", x.alias("x"))
    return out.select("id", "x.reference", F.col("x.frozen.hypothesis").alias("frozen_text"), F.col("x.adapted.hypothesis").alias("adapted_text"), F.round("x.frozen.cer", 6).alias("frozen_cer"), F.round("x.adapted.cer", 6).alias("adapted_cer"))


@query(f"""WITH {v.SYSTEMS_SQL} SELECT count(*) AS n, sum((length(reference) % 13 <> 0)::bigint)::bigint AS identical FROM systems WHERE system = 'adapted'""")
def reload_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = v.systems(spark, sf_dir, "adapted").select("id", "reference", F.col("hypothesis").alias("text"))
    again = a.select("id", F.when(F.length("reference") % 13 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    return runner.parity(a, again)


# ---------------------------------------------------------------- corpus measures, splits, selection


@query(f"""WITH {v.SCORED_SQL}, w AS (SELECT *, {v.words_sql('reference')} AS r, {v.words_sql('hypothesis')} AS h FROM scored WHERE system = 'adapted'), e AS (SELECT *, {v.word_distance_sql('r', 'h')} AS word_edits FROM w)
SELECT count(*) AS n, round(sum(char_edits) / sum(ref_chars), 9) AS cer, round(sum(word_edits) / sum(ref_words), 9) AS wer, round(avg(cer), 9) AS cer_macro, round(avg(exact::double), 9) AS exact_match,
  sum(char_edits)::bigint AS char_edits, sum(ref_chars)::bigint AS ref_chars, sum(word_edits)::bigint AS word_edits, sum(ref_words)::bigint AS ref_words FROM e""")
def composed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.ocr_metrics(v.systems(spark, sf_dir, "adapted").select("reference", "hypothesis"))
    return m.select("n", *(_r(c) for c in ("cer", "wer", "cer_macro", "exact_match")), "char_edits", "ref_chars", "word_edits", "ref_words")


@query(f"""WITH {v.SCORED_SQL} SELECT count(*) AS n, round(sum(char_edits) / sum(ref_chars), 9) AS cer, sum(truncated::bigint)::bigint AS n_truncated, sum(new_tokens)::bigint AS new_tokens,
  CASE WHEN count(*) >= 50 THEN 'measured' ELSE 'measured-small-sample' END AS verdict FROM scored WHERE system = 'frozen'""")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(v.scored(spark, sf_dir, "frozen")).select("n", _r("cer"), "n_truncated", "new_tokens", "verdict")


_PAGES_SQL = f"""said AS (SELECT item_id AS page_id, 'frozen' AS model, {v.collapse_sql('text')} AS reference, {v.frozen_sql(v.collapse_sql('text'))} AS hypothesis FROM benchmark
  UNION ALL SELECT item_id, 'adapted', {v.collapse_sql('text')}, {v.adapted_sql(v.collapse_sql('text'))} FROM benchmark),
page AS (SELECT page_id, model, reference, hypothesis, len({v.words_sql('hypothesis')}) >= {v.BUDGET} AS truncated, page_id % 7 AS n_table_cells, page_id % 3 AS n_table_rows,
  {v.distance_sql('reference', 'hypothesis')}::bigint AS char_edits FROM said)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items stand in for pages that two models read."""
    text = tx.collapse("text")
    two = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), f(text).alias("hypothesis")) for m, f in (("frozen", v.frozen), ("adapted", v.adapted))))).alias("s")
    p = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id"), text.alias("reference"), two).select("page_id", "reference", "s.*")
    return p.withColumns({"truncated": F.size(tx.words("hypothesis")) >= v.BUDGET, "n_table_cells": F.col("page_id") % 7, "n_table_rows": F.col("page_id") % 3})


@query(f"""WITH {_PAGES_SQL}, a AS (SELECT page_id, model, w, count(*) AS n FROM (SELECT page_id, model, unnest({v.words_sql('reference')}) AS w FROM page) GROUP BY ALL),
b AS (SELECT page_id, model, w, count(*) AS n FROM (SELECT page_id, model, unnest({v.words_sql('hypothesis')}) AS w FROM page) GROUP BY ALL),
o AS (SELECT page_id, model, sum(least(a.n, b.n)) AS o FROM a JOIN b USING (page_id, model, w) GROUP BY ALL)
SELECT page_id, model, char_edits, round(char_edits / length(reference), 9) AS cer, round(coalesce(o / len({v.words_sql('reference')}), 0), 9) AS token_recall,
  round(coalesce(o / nullif(len({v.words_sql('hypothesis')}), 0), 0), 9) AS token_precision FROM page LEFT JOIN o USING (page_id, model)""")
def page_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.page_rows(_pages(spark, sf_dir)).select("page_id", "model", "char_edits", _r("cer"), _r("token_recall"), _r("token_precision"))


@query(f"""WITH {_PAGES_SQL} SELECT model, round(avg(char_edits / length(reference)), 9) AS mean_cer, sum(truncated::bigint)::bigint AS truncated,
  sum(n_table_cells)::bigint AS n_table_cells, sum(n_table_rows)::bigint AS n_table_rows FROM page GROUP BY model""")
def page_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.page_means(metrics.pair_metrics(_pages(spark, sf_dir))).select("model", _r("mean_cer"), "truncated", "n_table_cells", "n_table_rows")


@query(f"""WITH {v.SYSTEMS_SQL}, n AS (SELECT system AS model, count(*) AS n FROM systems GROUP BY system), r(model, seconds, peak_memory_mb) AS (VALUES ('adapted', 900.0, 4080.0), ('frozen', 1200.0, 4920.0))
SELECT model, round(seconds::double / n, 9) AS mean_line_latency_s, round((SELECT avg((item_id % 9) * 0.5) FROM benchmark WHERE model = 'frozen'), 9) AS mean_page_latency_s, peak_memory_mb::double AS peak_memory_mb FROM r JOIN n USING (model)""")
def run_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.createDataFrame([("frozen", 1200.0, 4920.0), ("adapted", 900.0, 4080.0)], "model string, seconds double, peak_memory_mb double")
    pages = v.table(spark, sf_dir, "benchmark").select(F.lit("frozen").alias("model"), ((F.col("item_id") % 9) * 0.5).alias("inference_seconds"))
    lines = v.systems(spark, sf_dir).select(F.col("system").alias("model"))
    return compare.resources(runs, lines, pages).select("model", _r("mean_line_latency_s"), _r("mean_page_latency_s"), "peak_memory_mb")


@query(f"""WITH {v.SCORED_SQL}, s AS (SELECT system, sum(char_edits) / sum(ref_chars) AS cer FROM scored GROUP BY system), d AS (SELECT s.system, round(s.cer - f.cer, 4) AS d FROM s CROSS JOIN (SELECT cer FROM s WHERE system = 'frozen') f)
SELECT system, CASE WHEN d < 0 THEN 'cer lower than frozen' WHEN d > 0 THEN 'cer higher than frozen' ELSE 'cer as frozen' END AS reading FROM d""")
def delta_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.systems(spark, sf_dir).groupBy("system").agg((F.sum(tx.char_distance("reference", "hypothesis").cast("long")) / F.sum(F.length("reference").cast("long"))).alias("cer"))
    return compare.readings(compare.system_deltas(s, "frozen", ("cer",)), "frozen", "cer")


@query("""WITH p AS (SELECT doc_id AS pos, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id::varchar) - 1 AS place FROM documents)
SELECT pos, CASE WHEN place < 90 THEN 'train' WHEN place < 120 THEN 'validation' ELSE 'test' END AS split, CASE WHEN place < 90 THEN place WHEN place < 120 THEN place - 90 ELSE place - 120 END AS split_pos FROM p WHERE place < 160""")
def sample_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 160 records (the operator's own sizes) drawn from all documents."""
    r = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"))
    return curate.sample_split(r, {"train": 90, "validation": 30, "test": 40}).select("pos", "split", "split_pos")


@query(f"WITH {v.LINES_SQL} SELECT id, (row_number() OVER (ORDER BY pos) - 1) // 8 AS batch FROM lines")
def line_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.batches(v.lines(spark, sf_dir).select("pos", "id"), 8).select("id", "batch")


#: Languages stand in for configurations, sources for the epochs of their training.
_HISTORY_SQL = f"""{v.SCORED_SQL}, history AS (SELECT lang AS config, regexp_extract(source, '[0-9]+')::bigint AS epoch, round(sum(char_edits) / sum(ref_chars), 6) AS cer
  FROM scored WHERE system = 'frozen' GROUP BY ALL)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.systems(spark, sf_dir, "frozen")
    rate = F.round(F.sum(tx.char_distance("reference", "hypothesis").cast("long")) / F.sum(F.length("reference").cast("long")), 6)
    return s.groupBy(F.col("lang").alias("config"), F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("epoch")).agg(rate.alias("cer"))


@query(f"""WITH {_HISTORY_SQL} SELECT config, epoch, cer, min(cer) OVER w AS best_so_far,
  coalesce(cer < min(cer) OVER (PARTITION BY config ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM history WINDOW w AS (PARTITION BY config ORDER BY epoch)""")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.running_best(_history(spark, sf_dir)).select("config", "epoch", "cer", "best_so_far", "improved")


_KEPT_SQL = """kept AS (SELECT config, CASE WHEN f - c <= 0.002 THEN 0 ELSE e END AS best_epoch, CASE WHEN f - c <= 0.002 THEN f ELSE c END AS best_cer FROM (
  SELECT config, min(cer) AS c, first(epoch ORDER BY cer, epoch) AS e, max(CASE WHEN epoch = 0 THEN cer END) AS f FROM history GROUP BY config))"""


@query(f"WITH {_HISTORY_SQL}, {_KEPT_SQL} SELECT * FROM kept")
def kept_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.best_epoch(_history(spark, sf_dir), 0.002).select("config", "best_epoch", "best_cer")


@query(f"""WITH {_HISTORY_SQL}, {_KEPT_SQL}, d AS (SELECT best_cer AS d FROM kept WHERE config = 'en'), w AS (SELECT config, best_cer FROM kept, d WHERE config <> 'en' AND d - best_cer > 0.001 ORDER BY best_cer, config LIMIT 1)
SELECT CASE WHEN (SELECT max(best_epoch) FROM kept) = 0 THEN 'frozen' ELSE coalesce((SELECT config FROM w), 'en') END AS chosen, coalesce((SELECT best_cer FROM w), d) AS chosen_cer, d AS default_cer FROM d""")
def chosen_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = select.best_epoch(_history(spark, sf_dir), 0.002).withColumn("grid_pos", F.col("config"))
    return select.select_recipe(kept, "en", 0.001)


@query("""SELECT k AS key, a AS expected, b AS got FROM (SELECT 's' || n_nationkey AS k, n_regionkey::varchar AS a, CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 4 = 0 THEN (n_regionkey + 1)::varchar ELSE n_regionkey::varchar END AS b FROM nation)
WHERE b IS NOT NULL AND a <> b UNION ALL SELECT 's' || n_nationkey, n_regionkey::varchar, '<missing>' FROM nation WHERE n_nationkey % 6 = 0""")
def registered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand in for settings: some are given anew, some not at all."""
    n = v.table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("key"), "n_nationkey", "n_regionkey")
    registered = n.select("key", F.col("n_regionkey").cast("string").alias("value"), F.lit(False).alias("is_float"))
    given = n.where("n_nationkey % 6 != 0").select("key", (F.col("n_regionkey") + (F.col("n_nationkey") % 4 == 0).cast("int")).cast("string").alias("value"))
    return select.settings_differences(registered, given)
