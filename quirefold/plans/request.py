"""Sort requests end to end: validation, engine parsing, search, response rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.config import SorterConfig, for_language
from quirefold.functions import text as T
from quirefold.operators import assemble
from quirefold.plans.pages import sort_pages
from quirefold.sources import engines


def canonical_lines(requests: DataFrame) -> DataFrame:
    out = requests.select("page_id", F.posexplode("lines").alias("line_no", "text"))
    return out.withColumn("norm", T.normalize_text(F.col("text"))).withColumn("is_blank", F.trim("text") == "")


def respond(requests: DataFrame, language: str = "english", config: SorterConfig | None = None) -> DataFrame:
    """``page_id, document, unhandled, stats, problem``: a response for each request, valid or not.

    ``requests(page_id, engine, lines, input_json, page_width, page_height)``.
    """
    bad = engines.problems(requests).withColumnRenamed("field", "problem")
    good = requests.join(bad.select("page_id"), "page_id", "left_anti")
    boxes = reduce(DataFrame.unionByName, [engines.read(name, good.where(F.lower("engine") == name)) for name in engines.names()])
    ready, matches = sort_pages(boxes, canonical_lines(good), config or for_language(language))
    out = assemble.responses(matches, ready).withColumn("problem", F.lit(None).cast("string"))
    return out.unionByName(bad.select("page_id", "problem"), allowMissingColumns=True)
