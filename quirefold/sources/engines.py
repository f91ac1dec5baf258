"""Readers of word boxes: each turns rows of engine output into one schema of boxes.

A reader takes ``requests(page_id, input_json, page_width, page_height)`` and returns ``page_id, index, text, left, top,
width, height, confidence, line_id, extractor, page_width, page_height``. Requests that it must refuse are in
``problems()``; they give no boxes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

Reader = Callable[[DataFrame], DataFrame]
_readers: dict[str, Reader] = {}

TESSERACT = "struct<words:array<struct<text:string,line_num:int,left:double,top:double,width:double,height:double,conf:double>>>"
EASYOCR = "struct<results:array<struct<bbox:array<array<double>>,text:string,confidence:double>>>"
RECT = "struct<left:double,top:double,width:double,height:double>"
APPLE = "array<struct<text:string,confidence:double,words:array<struct<text:string,left:double,top:double,width:double,height:double,confidence:double>>>>"
NEUTRAL = f"array<struct<text:string,bounds:{RECT},normalized_conf:double,line_id:string,engine:string>>"
#: Confidence, in percent, below which a word goes; and a Latin word among complex scripts.
LEAST, LEAST_LATIN, COMPLEX_SHARE = 20, 50, 0.3


def register(name: str):
    def add(reader: Reader) -> Reader:
        _readers[name.lower()] = reader
        return reader

    return add


def names() -> list[str]:
    return sorted(_readers)


def supported(name: str) -> bool:
    return name.lower() in _readers


def read(name: str, requests: DataFrame) -> DataFrame:
    if not supported(name):
        raise ValueError(f"unknown engine {name!r}; there are {', '.join(names())}")
    return _readers[name.lower()](requests)


def _boxes(df: DataFrame, index: str, extractor) -> DataFrame:
    kept = ("page_id", index, "text", "left", "top", "width", "height", "confidence", "line_id")
    return df.select(*(F.col(c).alias("index") if c == index else F.col(c) for c in kept), F.lit(extractor).alias("extractor") if isinstance(extractor, str) else extractor.alias("extractor"), "page_width", "page_height")


def _exploded(requests: DataFrame, schema: str, items) -> DataFrame:
    parsed = requests.select("page_id", "page_width", "page_height", F.from_json("input_json", schema).alias("j"))
    return parsed.select("page_id", "page_width", "page_height", F.posexplode(items(F.col("j"))).alias("at", "w")).select("page_id", "page_width", "page_height", "at", "w.*")


@register("tesseract")
def tesseract(requests: DataFrame) -> DataFrame:
    """Low confidences go; on pages of complex scripts uncertain Latin words go as well. Positions count what is left."""
    words = _exploded(requests, TESSERACT, lambda j: j["words"]).withColumn("text", F.coalesce("text", F.lit("")))
    conf = F.floor("conf")
    share = F.avg(F.regexp_like(F.col("text"), F.lit(T.COMPLEX)).cast("double")).over(Window.partitionBy("page_id"))
    words = words.withColumn("share", share).where((F.col("text") != "") & (conf >= LEAST))
    words = words.where(~((F.col("share") > COMPLEX_SHARE) & T.latin_majority(F.col("text")) & (conf < LEAST_LATIN)))
    words = words.withColumn("index", F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1)
    scaled = words.select("page_id", "index", "text", *((F.col(c) / F.col(d)).alias(c) for c, d in (("left", "page_width"), ("top", "page_height"), ("width", "page_width"), ("height", "page_height"))), (conf / 100.0).alias("confidence"), F.col("line_num").cast("string").alias("line_id"), "page_width", "page_height")
    return _boxes(scaled, "index", "tesseract")


@register("easyocr")
def easyocr(requests: DataFrame) -> DataFrame:
    """Four-cornered pixel boxes, drawn in by a fixed margin; no lines."""
    rows = _exploded(requests, EASYOCR, lambda j: j["results"]).where((F.coalesce("text", F.lit("")) != "") & (F.size("bbox") == 4))
    x0, y0, x2, y2 = (F.col("bbox")[k][j].cast("int") for k, j in ((0, 0), (0, 1), (2, 0), (2, 1)))
    rows = rows.withColumn("index", F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1)
    w, h = F.col("page_width"), F.col("page_height")
    rows = rows.withColumns({"left": (x0 + 2) / w, "top": (y0 + 2) / h, "width": (x2 - x0 - 5) / w, "height": (y2 - y0 - 5) / h, "line_id": F.lit(None).cast("string")})
    return _boxes(rows, "index", "easyocr")


@register("apple")
def apple(requests: DataFrame) -> DataFrame:
    """Lines of words in fractions; a word has its line's confidence. Empty words leave gaps in the positions."""
    parsed = requests.select("page_id", "page_width", "page_height", F.posexplode(F.from_json("input_json", APPLE)).alias("line", "l"))
    words = parsed.select("page_id", "page_width", "page_height", "line", F.col("l.confidence").alias("confidence"), F.posexplode("l.words").alias("k", "w"))
    words = words.withColumn("index", F.row_number().over(Window.partitionBy("page_id").orderBy("line", "k")) - 1).where(F.coalesce("w.text", F.lit("")) != "")
    words = words.select("page_id", "index", F.col("w.text").alias("text"), *(F.coalesce(f"w.{c}", F.lit(0.0)).alias(c) for c in ("left", "top", "width", "height")), "confidence", F.col("line").cast("string").alias("line_id"), "page_width", "page_height")
    return _boxes(words, "index", "apple")


def apple_files(spark, path: str) -> DataFrame:
    """One request row ``page_id, input_json`` for each file of that engine's output, numbered by path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("input_json"))
    return files.select((F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("page_id"), "path", "input_json")


def _outside(box):
    """A named box whose corner is no fraction of the page. What is not given is 0."""
    at = lambda c: F.coalesce(box["bounds"][c], F.lit(0.0))
    return (F.coalesce(box["text"], F.lit("")) != "") & ~(at("left").between(0, 1) & at("top").between(0, 1))


@register("blocks")
def neutral(requests: DataFrame) -> DataFrame:
    """The neutral format, an array of boxes in fractions of the page; a page with a corner outside 0 to 1 is refused."""
    parsed = requests.select("page_id", "page_width", "page_height", F.from_json("input_json", NEUTRAL).alias("j")).where(~F.exists("j", _outside))
    rows = parsed.select("page_id", "page_width", "page_height", F.posexplode("j").alias("at", "w")).where(F.coalesce("w.text", F.lit("")) != "")
    rows = rows.select("page_id", "at", F.col("w.text").alias("text"), *(F.coalesce(f"w.bounds.{c}", F.lit(0.0)).alias(c) for c in ("left", "top", "width", "height")), F.coalesce("w.normalized_conf", F.lit(0.0)).alias("confidence"), F.when(F.col("w.line_id") != "", F.col("w.line_id")).alias("line_id"), "w.engine", "page_width", "page_height")
    return _boxes(rows, "at", F.when(F.coalesce("engine", F.lit("")) != "", F.col("engine")).otherwise("blocks"))


def _unreadable(requests: DataFrame):
    """Whether the named engine must refuse ``input_json``: no JSON of its form, no words at all, a corner off the page."""
    name, parse = F.lower("engine"), lambda schema: F.from_json("input_json", schema)
    none = lambda items: F.coalesce(F.size(items), F.lit(0)) < 1
    boxes = parse(NEUTRAL)
    return (
        F.when(name == "tesseract", none(parse(TESSERACT)["words"]))
        .when(name == "easyocr", none(parse(EASYOCR)["results"]))
        .when(name == "apple", parse(APPLE).isNull())
        .when(name == "blocks", boxes.isNull() | F.exists(boxes, _outside))
        .otherwise(False)
    )


def problems(requests: DataFrame) -> DataFrame:
    """``page_id, field`` of requests that break a rule: the first field that does."""
    known = F.lower("engine").isin(names())
    field = (
        F.when(F.coalesce("engine", F.lit("")) == "", "engine")
        .when(~known, "engine")
        .when(F.coalesce("page_width", F.lit(0)) <= 0, "page_width")
        .when(F.coalesce("page_height", F.lit(0)) <= 0, "page_height")
        .when(F.coalesce(F.size("lines"), F.lit(0)) < 1, "lines")
        .when(F.coalesce(F.trim("input_json"), F.lit("")) == "", "input_json")
        .when(F.coalesce(_unreadable(requests), F.lit(True)), "input_json")
    )
    return requests.select("page_id", field.alias("field")).where("field is not null")


def poppler_tsv(rows: DataFrame) -> DataFrame:
    """Text layer rows ``doc, row_no, level, page_num, par_num, block_num, line_num, left, top, width, height, text``.

    A ###PAGE### row opens a page and gives its size; other rows with ### and blank ones go. Sizes are clamped.
    """
    order = Window.partitionBy("doc").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.col("text") == "###PAGE###"
    rows = rows.withColumn("pw", F.last(F.when(opens, F.col("width")), ignorenulls=True).over(order)).withColumn("ph", F.last(F.when(opens, F.col("height")), ignorenulls=True).over(order))
    rows = rows.where(~F.col("text").startswith("###") & (F.trim("text") != "") & (F.col("pw") > 0) & (F.col("ph") > 0))
    left, top = T.clamp01(F.col("left") / F.col("pw")), T.clamp01(F.col("top") / F.col("ph"))
    return rows.select(
        "doc",
        F.col("page_num").alias("page_no"),
        (F.row_number().over(Window.partitionBy("doc", "page_num").orderBy("row_no")) - 1).alias("index"),
        "text",
        left.alias("left"),
        top.alias("top"),
        F.least(T.clamp01(F.col("width") / F.col("pw")), 1.0 - left).alias("width"),
        F.least(T.clamp01(F.col("height") / F.col("ph")), 1.0 - top).alias("height"),
        F.concat_ws("-", "page_num", "par_num", "block_num", "line_num").alias("line_id"),
        F.lit(1.0).alias("confidence"),
        F.lit("pdftext").alias("extractor"),
    )


def tesseract_tsv(rows: DataFrame) -> DataFrame:
    """Word rows (level 5) of a TSV read with its header; an empty line number falls back to the block's."""
    number = F.when(F.coalesce("line_num", F.lit("")) != "", F.col("line_num")).otherwise(F.col("block_num"))
    return rows.where((F.col("level") == "5") & (F.trim("text") != "")).select("text", number.cast("int").alias("line_num"), *(F.col(c).cast("double").alias(c) for c in ("left", "top", "width", "height", "conf")))


def merge_slices(words: DataFrame, slices: DataFrame) -> DataFrame:
    """Words of the slices of a tall page in the page's fractions, lines numbered on.

    ``slices(page_id, slice_no, height)`` in pixels; ``words(page_id, slice_no, top, height, line_num, ...)`` in
    fractions of their slice.
    """
    lines = words.groupBy("page_id", "slice_no").agg((F.max("line_num") + 1).alias("n_lines"))
    before = Window.partitionBy("page_id").orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.join(lines, ["page_id", "slice_no"], "left").select(
        "page_id",
        "slice_no",
        F.col("height").alias("slice_height"),
        F.coalesce(F.sum("height").over(before), F.lit(0)).alias("offset"),
        F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("line_base"),
        F.sum("height").over(Window.partitionBy("page_id")).alias("page_px"),
    )
    out = words.join(placed, ["page_id", "slice_no"])
    return out.withColumn("top", (F.col("top") * F.col("slice_height") + F.col("offset")) / F.col("page_px")).withColumn("height", F.col("height") * F.col("slice_height") / F.col("page_px")).withColumn("line_num", F.col("line_num") + F.col("line_base"))


def canonical_files(spark, path: str) -> DataFrame:
    """One row for each text file: its path, bytes, and lines."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.split("value", "\n").alias("lines"))
