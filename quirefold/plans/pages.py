"""The whole page plan: texts to boxes and lines, search, documents, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.config import ReadingOrder, SorterConfig, for_language
from quirefold.functions import text as T
from quirefold.operators import assemble, evaluate, prepare, search
from quirefold.plans import layout as L
from quirefold.plans.queries import docs, long, query, text
from quirefold.shared import materialize


def line_words(lines: DataFrame) -> DataFrame:
    """``page_id, word, key``: the normalized form of each distinct word of each page's lines, of each character of CJK ones."""
    handler = F.col("handler") if "handler" in lines.columns else F.lit("english")
    cut = F.when(handler == "cjk", T.tokenize_characters(F.col("text"))).otherwise(F.split("text", r"\s+"))
    return L.keyed(lines.select("page_id", F.explode(F.array_distinct(cut)).alias("word")).where("word <> ''").distinct(), "word", "key")


def sort_pages(boxes: DataFrame, lines: DataFrame, config: SorterConfig) -> tuple[DataFrame, DataFrame]:
    """Normalized boxes and the matched lines of all pages; ``boxes`` as engines read them, ``lines`` with their norms.

    Boxes get the ``reading_order`` and the language ``handler`` of their page. They and the matches are written between the steps, each of which reads them often.
    """
    handlers = materialize(T.page_handlers(lines), "handlers")
    lines = materialize(lines.join(handlers, "page_id"), "lines")
    ready = materialize(L.normalized(boxes), "boxes")
    tokens = lines.select("page_id", "line_no", F.posexplode(T.tokenize(F.col("handler"), F.col("norm"))).alias("pos", "tok"))
    words = lines.select("page_id", "line_no", F.posexplode(T.tokenize_words(F.col("norm"))).alias("pos", "tok"))
    if config.split_hyphenated:
        whole = F.col("text") == F.col("whole")
        cut = prepare.split_hyphens(ready.withColumn("whole", F.col("text")), words)
        ready = materialize(cut.withColumn("norm", F.when(whole, F.col("norm")).otherwise(T.normalize_core(F.col("text")))).where("norm <> ''").drop("whole"), "split")
    order = F.lit(int(config.reading_order))
    down = prepare.vertical_pages(ready).withColumn("down", F.lit(int(ReadingOrder.VERTICAL_TTB_RTL))) if config.detect_vertical and config.reading_order.horizontal else None
    if config.repair_lines:
        ready = prepare.line_repair(ready, tokens)
    ready = ready.withColumn("reading_order", order) if down is None else ready.join(down, "page_id", "left").withColumn("reading_order", F.coalesce("down", order)).drop("down")
    ready = materialize(ready.join(handlers, "page_id", "left").fillna("english", ["handler"]), "ready")
    matches = materialize(search.match_pages(ready, lines, line_words(lines), config), "matches")
    return ready, materialize(assemble.held(matches, ready), "held")


def _run(spark: SparkSession, sf: str, noisy: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = docs(spark, sf)
    lines = L.lines(d)
    boxes, matches = sort_pages(L.blocks(d, noisy), lines, for_language("english"))
    return boxes, matches, lines


@query()
def sort_pages_clean(spark, sf):
    boxes, matches, _ = _run(spark, sf, False)
    return assemble.assembled(matches, boxes).select("page_id", "text", long(F.size("paragraphs")).alias("n_paragraphs"))


@query()
def sort_pages_noisy(spark, sf):
    boxes, matches, _ = _run(spark, sf, True)
    return assemble.assembled(matches, boxes).select("page_id", "text", long(F.size("paragraphs")).alias("n_paragraphs"))


@query()
def page_stats(spark, sf):
    boxes, matches, _ = _run(spark, sf, True)
    return assemble.stats(matches, boxes).drop("elapsed_ms")


@query()
def unhandled_lines(spark, sf):
    return assemble.unhandled(_run(spark, sf, True)[1])


@query()
def lcs_accuracy(spark, sf):
    boxes, matches, _ = _run(spark, sf, False)
    got = assemble.assembled(matches, boxes).select("page_id", F.col("text").alias("sorted"))
    own = docs(spark, sf).select(F.col("doc_id").alias("page_id"), text().alias("canonical"))
    return evaluate.accuracy(own.join(got, "page_id", "left").withColumn("sorted", F.coalesce("sorted", F.lit(""))))
