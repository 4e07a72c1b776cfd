"""Reference texts of the sample pages: what is drawn, top to bottom, and the counts of scored elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (page_id, kind, lines in drawing order, expected element counts); rasterising needs an image library.
PAGES = (
    ("notice", "plain text", ("Reading room", "Open on weekdays from nine to five.", "Please return maps to the desk."), {"section_header_level_1": 1, "text": 2}),
    ("report", "headings and lists", ("Survey of the northern shelf", "Method", "Two boats measured the same line.", "First boat: sonar", "Second boat: lead line"), {"section_header_level_1": 1, "section_header_level_2": 1, "text": 1, "list_item": 2}),
    ("invoice", "table", ("Invoice 2041", "Item Quantity Price", "Paper 12 48.00", "Ink 3 31.50", "Total 79.50"), {"section_header_level_1": 1, "otsl": 1}),
    ("note", "formula and code", ("Mean of a sample", "m = (a + b) / 2", "print(m)"), {"section_header_level_1": 1, "formula": 1, "code": 1}),
)

#: Token budgets and canvas shapes of the robustness probes.
BUDGETS, SHAPES = (256, 512, 1024, 2048), (("square", 1024, 1024), ("wide", 1536, 512), ("tall", 512, 1536), ("small", 384, 384))


def sample_pages(spark: SparkSession) -> DataFrame:
    """page_id, kind, reference_text, expected_counts."""
    rows = [(p, k, " ".join(lines), counts) for p, k, lines, counts in PAGES]
    return spark.createDataFrame(rows, "page_id string, kind string, reference_text string, expected_counts map<string,int>")


def expected_counts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode("expected_counts").alias("element_type", "expected_count"))


def probes(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Every page at every token budget and shape: the requests of the robustness probes."""
    budgets = spark.createDataFrame([(b,) for b in BUDGETS], "max_new_tokens int")
    shapes = spark.createDataFrame(list(SHAPES), "shape string, width int, height int")
    return pages.select("page_id", "reference_text").crossJoin(F.broadcast(budgets)).crossJoin(F.broadcast(shapes)).withColumn("mode", F.lit("plain"))
