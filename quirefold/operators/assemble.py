"""From matched lines to documents: sentences, leftovers, grouping, byte spans, unhandled lines and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.config import ReadingOrder
from quirefold.functions import text as T
from quirefold.operators import prepare
from quirefold.operators.search import COUNTS
from quirefold.shared import materialize


def found_boxes(matches: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes on the paths of found lines: ``page_id, line_no, part, k`` and the box."""
    nodes = matches.where("found").select("page_id", "line_no", "part", F.posexplode("path").alias("k", "index")).where("index >= 0")
    return nodes.join(boxes, ["page_id", "index"])


def leftovers(matches: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes that no line has claimed, as islands of contiguous lines, cut at headers."""
    taken = matches.where("found").select("page_id", F.explode("path").alias("index"))
    return prepare.cut_headers(materialize(prepare.islands(boxes.join(taken, ["page_id", "index"], "left_anti")), "islands"))


def _key(text: Column) -> Column:
    return F.replace(T.normalize_text(text), F.lit(" "), F.lit(""))


def _texts(loose: DataFrame) -> DataFrame:
    """``page_id, island, w, key`` of leftover boxes: their texts in order, and the key of the whole."""
    spans = loose.groupBy("page_id", "island").agg(F.sort_array(F.collect_list(F.struct("index", "text"))).alias("w"))
    return spans.withColumn("key", _key(F.array_join(F.transform("w", lambda x: x["text"]), " ")))


def _open_lines(matches: DataFrame) -> DataFrame:
    """Lines and parts of lines that the search has not found."""
    rows = matches.where("not is_blank and original <> '' and (not found or size(path) = 0)")
    return rows.select("page_id", "line_no", "part", T.normalize_text(F.col("original")).alias("norm")).withColumn("ckey", F.replace("norm", F.lit(" "), F.lit(""))).where("ckey <> ''")


def held(matches: DataFrame, boxes: DataFrame) -> DataFrame:
    """``matches``, where unfound lines that lie whole in a leftover island are found, without a path.

    Of equal parts of a line, the first.
    """
    lines, spans = _open_lines(matches), _texts(leftovers(matches, boxes)).select("page_id", "key")
    hits = lines.join(spans, "page_id").where(F.contains("key", F.col("ckey"))).groupBy("page_id", "line_no", "ckey").agg(F.min("part").alias("part"))
    hits = hits.select("page_id", "line_no", "part", F.lit(True).alias("held"))
    return matches.join(hits, ["page_id", "line_no", "part"], "left").withColumn("found", F.col("found") | F.coalesce("held", F.lit(False))).drop("held")


#: Canonical lines in an island may be so many numbers apart, and must make up this share of it.
APART, COVERED = 2, 0.5


def cut_leftovers(matches: DataFrame, boxes: DataFrame) -> DataFrame:
    """The boxes of ``leftovers`` with a ``piece`` of their island: cut where the island holds several unfound lines.

    The lines must follow one another and cover half of the island. A piece ends before the box that would pass the end
    of its line, counted in bytes of the keys.
    """
    loose = materialize(leftovers(matches, boxes), "loose")
    spans = _texts(loose)
    near = spans.join(_open_lines(matches), "page_id").where(F.contains("key", F.col("ckey")))
    start = F.octet_length(F.substr(F.col("key"), F.lit(1), F.position(F.col("ckey"), F.col("key")) - 1))
    line = F.struct(start.alias("start"), "line_no", "part", (start + F.octet_length("norm")).alias("end"), F.octet_length("ckey").alias("bytes"))
    many = near.groupBy("page_id", "island").agg(F.sort_array(F.collect_list(line)).alias("m"), F.first("w").alias("w"), F.first("key").alias("key")).where(F.size("m") > 1)
    steps = F.zip_with(F.slice("m", 2, F.size("m")), F.slice("m", 1, F.size("m") - 1), lambda b, a: b["line_no"] - a["line_no"])
    covered = F.aggregate("m", F.lit(0), lambda n, x: n + x["bytes"]) / F.octet_length("key")
    many = many.where(F.forall(steps, lambda d: d <= APART) & (covered >= COVERED)).withColumn("w", F.transform("w", lambda x: F.struct(x["index"].alias("index"), F.octet_length(_key(x["text"])).alias("bytes"))))
    many = materialize(many.select("page_id", "island", "w", F.transform("m", lambda x: x["end"]).alias("ends")), "cut-islands")
    state = "struct<at:int,line:int,piece:int,held:int,out:array<struct<index:int,piece:int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit(0).alias("piece"), F.lit(0).alias("held"), F.array().cast("array<struct<index:int,piece:int>>").alias("out")).cast(state)

    def walk(s, x):
        past = (s["line"] < F.size("ends") - 1) & (s["at"] + x["bytes"] > F.get("ends", s["line"]))
        turn = past & (s["held"] > 0)
        piece = s["piece"] + turn.cast("int")
        return F.struct((s["at"] + x["bytes"]).alias("at"), (s["line"] + past.cast("int")).alias("line"), piece.alias("piece"), (F.when(turn, 0).otherwise(s["held"]) + 1).alias("held"), F.concat(s["out"], F.array(F.struct(x["index"].cast("int").alias("index"), piece.alias("piece")))).alias("out")).cast(state)

    pieces = many.select("page_id", F.explode(F.aggregate("w", zero, walk)["out"]).alias("p")).select("page_id", "p.index", "p.piece")
    return loose.join(pieces, ["page_id", "index"], "left").fillna(0, ["piece"])


def sentences(matches: DataFrame, boxes: DataFrame) -> DataFrame:
    """``page_id, line_no, first, words, reading_order, handler``: found parts of lines, and leftover islands with the line that holds them.

    An island belongs to the canonical line that contains it or lies in it, by the largest ratio of their lengths in
    bytes; the earlier of equals; -1 if there is none.
    """
    word = F.struct(F.col("k").alias("at"), "index", "text", "left", "top", "width", "height")
    found = found_boxes(matches, boxes).groupBy("page_id", "line_no", "part").agg(F.sort_array(F.collect_list(word)).alias("words"), F.min("index").alias("first"), F.max("reading_order").alias("reading_order"), F.max("handler").alias("handler"))
    loose = cut_leftovers(matches, boxes).withColumn("k", F.col("index")).withColumn("island", F.struct("island", "piece"))
    spans = loose.groupBy("page_id", "island").agg(F.sort_array(F.collect_list(word)).alias("words"), F.min("index").alias("first"), F.max("reading_order").alias("reading_order"), F.max("handler").alias("handler"), _key(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), " ")).alias("key"))
    lines = matches.where("part = 0 and not is_blank").select("page_id", F.col("line_no").alias("cand"), _key(F.col("original")).alias("ckey")).where("ckey <> ''")
    holds = F.contains("ckey", F.col("key")) | F.contains("key", F.col("ckey"))
    ratio = F.least(F.octet_length("key"), F.octet_length("ckey")) / F.greatest(F.octet_length("key"), F.octet_length("ckey"))
    near = spans.where("key <> ''").select("page_id", "island", "key").join(lines, "page_id").where(holds)
    best = near.groupBy("page_id", "island").agg(F.max(F.struct(ratio.alias("r"), (-F.col("cand")).alias("c"))).alias("m")).select("page_id", "island", (-F.col("m.c")).alias("line_no"))
    placed = spans.join(best, ["page_id", "island"], "left").select("page_id", F.coalesce("line_no", F.lit(-1)).cast("int").alias("line_no"), "first", "words", "reading_order", "handler")
    return found.select("page_id", "line_no", "first", "words", "reading_order", "handler").unionByName(placed)


def paragraphs(sents: DataFrame) -> DataFrame:
    """``page_id, rank, line_no, handler, reading_order, text, words, bounds``: sentences of one canonical line merged, in line order, unmatched ones last.

    Sentences of a line, and those without one, go from top to bottom, of vertical pages by columns and then from top to bottom.
    """
    head, order = F.col("words")[0], F.col("reading_order")
    along = F.when(order == int(ReadingOrder.VERTICAL_TTB_RTL), -(head["left"] + head["width"])).when(order == int(ReadingOrder.VERTICAL_TTB_LTR), head["left"]).otherwise(head["top"])
    tie = F.when(order >= int(ReadingOrder.VERTICAL_TTB_RTL), head["top"]).otherwise(head["left"])
    key = F.struct(along.alias("along"), tie.alias("tie"), "first")
    merged = sents.withColumn("key", key).withColumn("grp", F.when(F.col("line_no") < 0, F.col("first")).otherwise(F.lit(-1))).groupBy("page_id", "line_no", "grp").agg(F.max("handler").alias("handler"), F.max("reading_order").alias("reading_order"), F.min("key").alias("key"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("key", "words"))), lambda x: x["words"])).alias("words"))
    place = Window.partitionBy("page_id").orderBy(F.when(F.col("line_no") < 0, 1).otherwise(0), "line_no", "key")
    return merged.select("page_id", (F.row_number().over(place) - 1).alias("rank"), "line_no", "handler", "reading_order", *_text_and_bounds())


#: A gap of so many box sizes, of a size of at least so much of the page, parts two unmatched sentences.
BREAK, LEAST_SIZE = 1.5, 0.01


def paragraph_gaps(paras: DataFrame) -> DataFrame:
    """``page_id, rank`` of unmatched paragraphs that lie far behind the unmatched one before them, where reading advances."""
    before = Window.partitionBy("page_id").orderBy("rank")
    last, head, order = F.col("last"), F.col("words")[0], F.col("reading_order")
    rows = paras.select("page_id", "rank", "line_no", "reading_order", "words", F.lag(F.get("words", F.size("words") - 1)).over(before).alias("last"), F.lag("line_no").over(before).alias("last_line"))
    down = order >= int(ReadingOrder.VERTICAL_TTB_RTL)
    size = F.when(down, F.greatest(last["width"], head["width"])).otherwise(F.greatest(last["height"], head["height"]))
    gap = F.when(order == int(ReadingOrder.VERTICAL_TTB_RTL), last["left"] - (head["left"] + head["width"])).when(down, head["left"] - (last["left"] + last["width"])).otherwise(head["top"] - (last["top"] + last["height"]))
    return rows.where((F.col("line_no") < 0) & (F.col("last_line") < 0) & (size >= LEAST_SIZE) & (gap > BREAK * size)).select("page_id", "rank")


def sorted_lines(matches: DataFrame, boxes: DataFrame) -> DataFrame:
    """``page_id, no, text``: the lines of each page's document with the empty ones that documents leave out.

    Those are the blank lines between the first and the last line that has boxes, and one before each of
    ``paragraph_gaps``; a page of at most one line has none.
    """
    whole = materialize(paragraphs(sentences(matches, boxes)), "paragraphs")
    lines = whole.where("line_no >= 0").groupBy("page_id").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    blanks = matches.where("is_blank").join(lines, "page_id").where("line_no > lo and line_no < hi").select("page_id", "line_no").distinct()
    few = matches.groupBy("page_id").agg(F.count("*").alias("n")).where("n <= 1").select("page_id")
    gaps = paragraph_gaps(whole).join(few, "page_id", "left_anti")
    # unmatched paragraphs are behind all lines; a gap is before its paragraph
    tail = F.when(F.col("line_no") < 0, F.lit(2**31 - 1)).otherwise(F.col("line_no"))
    rows = resegmented(whole, matches).join(few.withColumn("few", F.lit(True)), "page_id", "left").select("page_id", F.when(F.col("few"), F.lit(0)).otherwise(tail).alias("at"), "rank", F.lit(1).alias("sub"), F.trim("text").alias("text"))
    empty = lambda df, at, rank: df.select("page_id", at.alias("at"), rank.alias("rank"), F.lit(0).alias("sub"), F.lit("").alias("text"))
    out = rows.unionByName(empty(blanks, F.col("line_no"), F.lit(-1))).unionByName(empty(gaps, F.lit(2**31 - 1), F.col("rank")))
    return out.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("at", "rank", "sub")) - 1).alias("no"), "text")


def _text_and_bounds() -> tuple[Column, Column, Column]:
    w = F.col("words")
    bounds = F.struct(F.array_min(F.transform(w, lambda x: x["top"])).alias("top"), F.array_min(F.transform(w, lambda x: x["left"])).alias("left"), F.array_max(F.transform(w, lambda x: x["top"] + x["height"])).alias("bottom"), F.array_max(F.transform(w, lambda x: x["left"] + x["width"])).alias("right"))
    return F.array_join(T.join_words(F.col("handler"), w), "").alias("text"), w, bounds.alias("bounds")


def resegmented(paras: DataFrame, matches: DataFrame) -> DataFrame:
    """``paras`` with the words of pages of at most one line, in their order, cut anew behind each sentence end."""
    few = matches.groupBy("page_id").agg(F.count("*").alias("n")).where("n <= 1").select("page_id")
    order = Window.partitionBy("page_id").orderBy("rank", "k")
    words = paras.join(few, "page_id").select("page_id", "rank", "line_no", "handler", "reading_order", F.posexplode("words").alias("k", "w"))
    ended = F.coalesce(F.lag(T.ends_sentence(F.col("w.text")).cast("int")).over(order), F.lit(0))
    cut = words.withColumn("ended", ended).withColumn("no", F.sum("ended").over(order).cast("int"))
    own = cut.groupBy("page_id", "no").agg(F.min("line_no").alias("line_no"), F.max("handler").alias("handler"), F.max("reading_order").alias("reading_order"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "k", "w"))), lambda x: x["w"]).alias("words"))
    return paras.join(few, "page_id", "left_anti").unionByName(own.select("page_id", F.col("no").alias("rank"), "line_no", "handler", "reading_order", *_text_and_bounds()))


def assembled(matches: DataFrame, boxes: DataFrame) -> DataFrame:
    """The documents of matched pages."""
    return documents(resegmented(paragraphs(sentences(matches, boxes)), matches))


def documents(paras: DataFrame) -> DataFrame:
    """``page_id, text, paragraphs``: one structured document for each page, spans in bytes."""
    order = Window.partitionBy("page_id").orderBy("rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0))
    p = paras.withColumn("start", start)
    # each word's bytes with the space behind it, added up, are where the next one starts
    spaced = F.transform(T.join_words(F.col("handler"), F.col("words")), F.octet_length)
    ends = F.aggregate(spaced, F.array(F.col("start").cast("bigint")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    p = p.withColumn("starts", ends)
    tokens = F.transform("words", lambda w, k: F.struct(w["text"].alias("text"), F.get("starts", k).alias("start"), (F.get("starts", k) + F.octet_length(w["text"])).alias("end"), w["left"].alias("left"), w["top"].alias("top"), w["width"].alias("width"), w["height"].alias("height")))
    entry = F.struct("rank", "text", F.col("start"), (F.col("start") + F.octet_length("text")).alias("end"), "bounds", tokens.alias("tokens"))
    return p.groupBy("page_id").agg(F.sort_array(F.collect_list(entry)).alias("paragraphs")).select("page_id", F.array_join(F.transform("paragraphs", lambda x: x["text"]), "\n").alias("text"), "paragraphs")


def rescued_blanks(lines: DataFrame, reach: int = 5) -> DataFrame:
    """``page_id, line_no`` of blank lines between the first and the last line with text, with one within ``reach`` lines."""
    up = Window.partitionBy("page_id").orderBy("line_no")
    own = F.when(~F.col("is_blank"), F.col("line_no"))
    near = lines.withColumn("before", F.last(own, ignorenulls=True).over(up)).withColumn("after", F.first(own, ignorenulls=True).over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    close = (F.col("line_no") - F.col("before") <= reach) | (F.col("after") - F.col("line_no") <= reach)
    return near.where(F.col("is_blank") & F.col("before").isNotNull() & F.col("after").isNotNull() & close).select("page_id", "line_no")


def unhandled(matches: DataFrame) -> DataFrame:
    """Lines that were neither found nor split, trimmed."""
    return matches.where("not found and not split and not is_blank").select("page_id", "line_no", "part", F.trim("original").alias("text")).where("text <> ''")


def stats(matches: DataFrame, boxes: DataFrame) -> DataFrame:
    """Counts of each page; lines that only leftovers hold are neither found by the search nor unhandled."""
    count = lambda name: F.max(F.col("counts")[COUNTS.index(name)]).alias(name)
    rows = matches.groupBy("page_id").agg(
        F.count_distinct("line_no").alias("canonical_lines"),
        F.count_if(F.col("found") & (F.col("is_blank") | (F.size("path") > 0))).alias("lines_found"),
        F.count_if(~F.col("found") & ~F.col("split") & ~F.col("is_blank") & (F.trim("original") != "")).alias("lines_unhandled"),
        *(count(c) for c in COUNTS),
        F.sum(F.size(F.filter("path", lambda x: x >= 0))).alias("boxes_matched"),
        F.sum(F.size(F.filter("path", lambda x: x < 0))).alias("holes"),
        F.max("elapsed_ms").alias("elapsed_ms"),
    )
    repaired = F.count_if(F.col("suggested").isNotNull()) if "suggested" in boxes.columns else F.lit(0).cast("long")
    own = boxes.groupBy("page_id").agg(F.count("*").alias("input_blocks"), repaired.alias("line_repairs"))
    out = rows.join(own, "page_id", "left").fillna(0, ["input_blocks", "line_repairs"])
    return out.withColumn("leftover_blocks", F.col("input_blocks") - F.col("boxes_matched"))


def responses(matches: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row for each page: the document, its unhandled lines and its statistics."""
    left = unhandled(matches).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "part", "text"))).alias("u")).select("page_id", F.transform("u", lambda x: x["text"]).alias("unhandled"))
    docs = assembled(matches, boxes)
    own = stats(matches, boxes)
    return own.join(docs, "page_id", "left").join(left, "page_id", "left").select("page_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), "paragraphs").alias("document"), F.coalesce("unhandled", F.array().cast("array<string>")).alias("unhandled"), F.struct(*(c for c in own.columns if c != "page_id")).alias("stats"))


def write_json(pages: DataFrame, path: str) -> None:
    pages.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_text(pages: DataFrame, path: str) -> None:
    pages.select(F.col("document.text").alias("value")).write.mode("overwrite").text(path)
