"""Preparation of boxes and lines: vocabulary, hyphens, line repair, orientation, right-to-left repair, chains."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.shared import materialize


def vocabulary(tokens: DataFrame) -> DataFrame:
    return tokens.select("page_id", "tok").distinct()


def word_index(boxes: DataFrame) -> DataFrame:
    """``page_id, norm, cands``: the positions of each normalized word."""
    return boxes.groupBy("page_id", "norm").agg(F.sort_array(F.collect_list("index")).alias("cands"))


def split_hyphens(boxes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Boxes of hyphenated words cut into equal parts, if every part is a word of the page's lines; then renumbered."""
    parts = F.array_remove(F.split("text", "[-‑ ]"), "")
    cut = boxes.withColumn("parts", parts)
    many = (F.size("parts") > 1) & ~F.regexp_like(F.col("text"), F.lit(r"^[0-9\-‑ ]+$"))
    pieces = cut.where(many).select("page_id", "index", F.explode("parts").alias("part"))
    keyed = pieces.withColumn("tok", T.normalize_core(F.col("part"))).where("tok <> ''")
    known = keyed.join(vocabulary(tokens).withColumn("known", F.lit(1)), ["page_id", "tok"], "left")
    ok = known.groupBy("page_id", "index").agg(F.every(F.col("known").isNotNull()).alias("split"))
    joined = cut.join(ok, ["page_id", "index"], "left").withColumn("parts", F.when(F.coalesce("split", F.lit(False)), F.col("parts")).otherwise(F.array("text")))
    n = F.size("parts")
    out = joined.select("*", F.posexplode("parts").alias("part_no", "part")).withColumns({"left": F.col("left") + F.col("width") / n * F.col("part_no"), "width": F.col("width") / n, "hyphen_after": F.col("part_no") < n - 1, "text": F.col("part")})
    order = Window.partitionBy("page_id").orderBy("index", "part_no")
    out = out.withColumn("new_index", F.row_number().over(order) - 1)
    return out.drop("index", "parts", "part", "part_no", "split").withColumnRenamed("new_index", "index")


def line_repair(boxes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Keys of alien boxes, read off their neighbours in the engine's line where the page's lines leave one choice.

    First the words between two known ones and at the start of a line, then, on the repaired keys, those at the end.
    """
    # both sides are read several times
    boxes, tokens = materialize(boxes, "repair-boxes"), materialize(tokens, "repair-tokens")
    vocab = vocabulary(tokens).withColumnRenamed("tok", "norm").withColumn("known", F.lit(True))
    step = Window.partitionBy("page_id", "line_no").orderBy("pos")
    tri = tokens.select("page_id", F.lag("tok").over(step).alias("a"), F.col("tok").alias("b"), F.lead("tok").over(step).alias("c")).where("a is not null and c is not null").distinct()
    tri = materialize(tri, "repair-triples")
    only = lambda keys, word: tri.groupBy("page_id", *keys).agg(F.min(word).alias("fix"), F.count_distinct(word).alias("n")).where("n = 1").drop("n")
    row = Window.partitionBy("page_id", "line_id").orderBy("index")

    def around(df: DataFrame) -> DataFrame:
        df = df.drop("known").join(vocab, ["page_id", "norm"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
        cols = {"n_line": F.count("*").over(Window.partitionBy("page_id", "line_id"))}
        for name, shift in (("p2", 2), ("p1", 1), ("n1", -1), ("n2", -2)):
            cols[name] = F.lag("norm", shift).over(row)
            cols[f"{name}_known"] = F.lag("known", shift).over(row)
        return df.withColumns(cols)

    lined, rest = boxes.where("line_id is not null"), boxes.where("line_id is null")
    now = around(lined)
    middle = now.where("not known and p1_known and n1_known").join(only(["a", "c"], "b").withColumnsRenamed({"a": "p1", "c": "n1"}), ["page_id", "p1", "n1"])
    first = now.where("not known and p1 is null and n_line >= 3 and n1_known and n2_known").join(only(["b", "c"], "a").withColumnsRenamed({"b": "n1", "c": "n2"}), ["page_id", "n1", "n2"])
    fixes = middle.select("page_id", "index", "fix").unionByName(first.select("page_id", "index", "fix"))
    one = lined.join(fixes, ["page_id", "index"], "left").withColumn("was", F.col("norm")).withColumn("norm", F.coalesce("fix", "norm")).withColumnRenamed("fix", "fix1")
    last = around(one).where("not known and n1 is null and n_line >= 3 and p1_known and p2_known").join(only(["a", "b"], "c").withColumnsRenamed({"a": "p2", "b": "p1"}), ["page_id", "p2", "p1"])
    two = one.join(last.select("page_id", "index", "fix"), ["page_id", "index"], "left")
    suggested = F.coalesce("fix", "fix1")
    two = two.withColumn("suggested", suggested).withColumn("norm", F.coalesce("fix", "norm")).withColumn("edits", F.when(suggested.isNotNull(), F.levenshtein("was", suggested))).drop("fix", "fix1", "was")
    return two.unionByName(rest.withColumn("suggested", F.lit(None).cast("string")).withColumn("edits", F.lit(None).cast("int")))


def vertical_votes(boxes: DataFrame) -> DataFrame:
    """``page_id, vertical, horizontal, is_vertical`` from how the engine's lines of at least three boxes run."""
    row = Window.partitionBy("page_id", "line_id").orderBy("index")
    moved = boxes.where("line_id is not null").select("page_id", "line_id", F.abs(F.col("left") - F.lag("left").over(row)).alias("dx"), F.abs(F.col("top") - F.lag("top").over(row)).alias("dy"))
    votes = moved.groupBy("page_id", "line_id").agg(F.count("*").alias("n"), F.sum("dx").alias("dx"), F.sum("dy").alias("dy")).where("n >= 3")
    out = votes.groupBy("page_id").agg(F.count_if(F.col("dy") > F.col("dx")).alias("vertical"), F.count_if(F.col("dy") <= F.col("dx")).alias("horizontal"))
    return out.withColumn("is_vertical", (F.col("vertical") >= 3) & (F.col("vertical") >= 2 * F.col("horizontal")))


def vertical_flow(boxes: DataFrame) -> DataFrame:
    """The same from consecutive boxes that are not wide, for pages without lines; at least 30 votes."""
    order = Window.partitionBy("page_id").orderBy("index")
    narrow = F.col("width") * F.col("page_width") < 1.6 * F.col("height") * F.col("page_height")
    moved = boxes.select("page_id", "line_id", narrow.alias("narrow"), F.lag(narrow).over(order).alias("before"), F.abs(F.col("left") - F.lag("left").over(order)).alias("dx"), F.abs(F.col("top") - F.lag("top").over(order)).alias("dy"))
    counted = moved.where("narrow and before")
    out = counted.groupBy("page_id").agg(F.count_if(F.col("dy") > F.col("dx")).alias("vertical"), F.count_if(F.col("dy") <= F.col("dx")).alias("horizontal"))
    return out.withColumn("is_vertical", (F.col("vertical") >= 30) & (F.col("vertical") >= 2 * F.col("horizontal")))


def vertical_pages(boxes: DataFrame) -> DataFrame:
    """``page_id`` of the pages whose text runs down: by the engine's lines, or by pairs of boxes where no box has a line.

    Of a pair of consecutive boxes, overlap decides: squarish ones below each other count as down, the next beside the
    last, of any width, as across. At least 30 down and twice those across.
    """
    order = Window.partitionBy("page_id").orderBy("index")
    last = {c: F.lag(c).over(order) for c in ("left", "top", "width", "height")}
    left, top, width, height = (F.col(c) for c in last)
    beside = (last["top"] < top + height) & (top < last["top"] + last["height"])
    below = (last["left"] < left + width) & (left < last["left"] + last["width"])
    square = (last["height"] > 0) & (height > 0) & (last["width"] < 1.6 * last["height"]) & (width < 1.6 * height)
    pairs = boxes.select("page_id", "line_id", (beside & ~below & (left >= last["left"])).alias("across"), (below & ~beside & (top > last["top"]) & square).alias("down"))
    flow = pairs.groupBy("page_id").agg(F.count("line_id").alias("lined"), F.count_if("across").alias("across"), F.count_if("down").alias("down"))
    flow = flow.where("lined = 0 and down >= 30 and down >= 2 * across").select("page_id")
    return vertical_votes(boxes).where("is_vertical").select("page_id").unionByName(flow)


def rtl_repair(words: DataFrame) -> DataFrame:
    """Characters of right-to-left words, and the words of lines that are mostly such, in reading order.

    A line is a run of equal ``line_id``; ``words(page_id, index, line_id, text)``.
    """
    order = Window.partitionBy("page_id").orderBy("index")
    rtl = T.rtl_majority(F.col("text"))
    runs = words.withColumn("rtl", rtl).withColumn("cut", F.coalesce((F.lag("line_id").over(order) != F.col("line_id")).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("cut").over(order))
    line = Window.partitionBy("page_id", "run")
    runs = runs.withColumn("most", F.count_if("rtl").over(line) * 2 > F.count("*").over(line))
    key = Window.partitionBy("page_id").orderBy("run", F.when(F.col("most"), -F.col("index")).otherwise(F.col("index")))
    return runs.select("page_id", (F.row_number().over(key) - 1).alias("index"), "line_id", F.when(F.col("rtl"), F.reverse("text")).otherwise(F.col("text")).alias("text"))


def chains(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """``page_id, line_no, pos, tok, cands``: the number of boxes that each token may be; null where the word is missing.

    Which boxes they are is for the kernel, which has a page's boxes at hand; to copy them to each token would be
    quadratic in a frequent word.
    """
    counts = boxes.groupBy("page_id", "norm").agg(F.count("*").alias("cands")).withColumnRenamed("norm", "tok")
    return tokens.select("page_id", "line_no", "pos", "tok").join(counts, ["page_id", "tok"], "left")


def missing(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """The tokens that no box is."""
    known = boxes.select("page_id", F.col("norm").alias("tok")).distinct()
    return tokens.join(known, ["page_id", "tok"], "left_anti")


def hole_budget(chain: DataFrame, share: float = 0.2) -> DataFrame:
    """``page_id, line_no, n, missing, holes_allowed``: lines that may treat missing words as holes."""
    out = chain.groupBy("page_id", "line_no").agg(F.count("*").alias("n"), F.count_if(F.col("cands").isNull()).alias("missing"))
    allowed = (F.col("missing") > 0) & (F.col("missing") <= F.floor(F.col("n") * F.lit(share))) & (F.col("n") - F.col("missing") >= 2)
    return out.withColumn("holes_allowed", allowed)


def islands(boxes: DataFrame) -> DataFrame:
    """Boxes with ``island``: runs without a vertical gap, of one line, or of consecutive positions where a box has no line."""
    order = Window.partitionBy("page_id").orderBy("index")
    prev = lambda c: F.lag(c).over(order)
    same = F.when(F.col("line_id").isNotNull() & prev("line_id").isNotNull(), F.col("line_id") == prev("line_id")).otherwise(F.col("index") == prev("index") + 1)
    close = F.col("top") - (prev("top") + prev("height")) <= 1.5 * F.greatest("height", prev("height"))
    cut = F.when(prev("index").isNull() | ~(same & close), 1).otherwise(0)
    return boxes.withColumn("cut", cut).withColumn("island", F.sum("cut").over(order)).drop("cut")


#: A leftover sentence goes on behind these words.
GOES_ON = ("about", "at", "in", "on", "to", "for", "with", "by", "of", "and", "or", "but", "the", "a", "an")
#: Boxes of one engine line that may be a header.
HEADER = 4
#: An upper-case letter by the first byte of the text alone, which also takes that of most letters of two bytes.
_UPPER = r"^[A-Z\x{80}-\x{5BF}\x{600}-\x{7BF}]"


def _sentence_numbers(boxes: list[dict]) -> list[int]:
    """The sentence of each box of an island; each cut hangs on what the sentence before it holds."""
    out, start, line = [], 0, None
    for at, box in enumerate(boxes):
        own = box.get("line")
        if at > start and None not in (own, line) and own != line:
            last, ahead = boxes[at - 1], boxes[at : at + HEADER + 1]
            before = sum(b.get("line") == line for b in boxes[start:at])
            short = len(ahead) <= HEADER or any(b.get("line") != own for b in ahead)
            if last["ends"] or before <= HEADER or (short and box["upper"] and not last["goes_on"]):
                start = at
        line = own if own is not None else line
        out.append((out[-1] if out else 0) + (at == start and at > 0))
    return out


def _pieces(islands: pd.Series) -> pd.Series:
    return islands.map(lambda w: _sentence_numbers(json.loads(w)))


def cut_headers(boxes: DataFrame) -> DataFrame:
    """``boxes`` of ``islands`` with islands cut where the engine's line changes behind a sentence end or at a header.

    A header is a run of at most ``HEADER`` boxes of one engine line: before the change, or behind it if it starts in
    upper case and the word before does not go on. Lines change inside an island only over boxes without one.
    """
    line = F.nullif(F.col("line_id"), F.lit(""))
    goes_on = F.lower(F.trim("text")).isin(*GOES_ON)
    box = F.struct("index", line.alias("line"), T.ends_sentence(F.col("text")).alias("ends"), goes_on.alias("goes_on"), F.regexp_like(F.col("text"), F.lit(_UPPER)).alias("upper"))
    many = boxes.groupBy("page_id", "island").agg(F.sort_array(F.collect_list(box)).alias("w"), F.count_distinct(line).alias("n")).where("n > 1")
    cut = many.select("page_id", "w", F.pandas_udf(_pieces, "array<int>")(F.to_json("w")).alias("out"))
    pieces = cut.select("page_id", F.explode(F.arrays_zip(F.transform("w", lambda x: x["index"]).alias("index"), F.col("out").alias("no"))).alias("p")).select("page_id", "p.index", "p.no")
    order = Window.partitionBy("page_id").orderBy("island", "no")
    return boxes.join(pieces, ["page_id", "index"], "left").fillna(0, ["no"]).withColumn("island", F.dense_rank().over(order).cast("long")).drop("no")


def resegment(words: DataFrame) -> DataFrame:
    """Lines cut anew behind each sentence end: ``page_id, line_no, text`` from ``page_id, index, text``."""
    order = Window.partitionBy("page_id").orderBy("index")
    ended = F.coalesce(F.lag(T.ends_sentence(F.col("text")).cast("int")).over(order), F.lit(0))
    numbered = words.withColumn("ended", ended).withColumn("line_no", F.sum("ended").over(order))
    texts = numbered.groupBy("page_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("index", "text"))).alias("w"))
    return texts.select("page_id", "line_no", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))
