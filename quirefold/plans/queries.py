"""Registered queries of the reading-order operators over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions.geometry import BoxColumns, Geometry, with_geometry
from quirefold.operators import evaluate
from quirefold.operators import prepare as P
from quirefold.plans import layout as L
from quirefold.sources import engines as S
from quirefold.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def text(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


def long(c) -> F.Column:
    return c.cast("long")


@query(f"SELECT doc_id, {L.sql_normalize('''coalesce(text, '')''')} AS norm FROM documents")
def normalize_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_core(text()).alias("norm"))


@query()
def normalize_full(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_text(text()).alias("norm"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), 'https?://[^\s]+')) AS BIGINT) AS n_urls,
CAST(len(regexp_extract_all(coalesce(text, ''), '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b')) AS BIGINT) AS n_emails,
CAST(len(regexp_extract_all(coalesce(text, ''), '\+?[0-9]+(?:-[0-9]+)+')) AS BIGINT) AS n_phones FROM documents""")
def normalize_protected(spark, sf):
    n = lambda p: long(F.size(F.regexp_extract_all(text(), F.lit(p), F.lit(0))))
    return docs(spark, sf).select("doc_id", n(T.URL).alias("n_urls"), n(T.EMAIL).alias("n_emails"), n(T.PHONE).alias("n_phones"))


@query("WITH " + L.SQL_WORDS + " SELECT word, count(*) AS n FROM words GROUP BY word")
def tokenize_words(spark, sf):
    return docs(spark, sf).select(F.explode(T.tokenize_words(text())).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]', '', 'g')) AS BIGINT) AS n_chars FROM documents")
def tokenize_chars(spark, sf):
    return docs(spark, sf).select("doc_id", long(F.size(T.tokenize_characters(text()))).alias("n_chars"))


_SHARES = f"""SELECT doc_id, coalesce(text, '') AS t, greatest(length(coalesce(text, '')), 1) AS n,
 len(regexp_extract_all(coalesce(text, ''), '[{T.CJK}]')) AS c, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9 .,]')) AS e FROM documents"""


@query(f"SELECT doc_id, round(c / n, 6) AS cjk, round(e / n, 6) AS english FROM ({_SHARES})")
def script_confidence(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(T.cjk_share(text()), 6).alias("cjk"), F.round(T.english_share(text()), 6).alias("english"))


@query(f"SELECT doc_id, CASE WHEN t = '' THEN 'english' WHEN c >= e AND c / n >= 0.8 THEN 'cjk' WHEN e > c AND e / n >= 0.8 THEN 'english' ELSE 'mixed' END AS handler FROM ({_SHARES})")
def language_handler(spark, sf):
    return docs(spark, sf).select("doc_id", T.language_handler(text()).alias("handler"))


_PAIRS = "(VALUES ('中', '文'), ('a', '文'), ('文', 'b'), ('a', 'b'), ('カ', '字'), ('', 'x')) AS p(l, r)"


@query(f"SELECT h AS handler, l, r, h = 'english' OR NOT (regexp_matches(l, '[{T.CJK}]') AND regexp_matches(r, '[{T.CJK}]')) AS needs FROM {_PAIRS}, (VALUES ('english'), ('cjk'), ('mixed')) AS hs(h)")
def needs_space_pairs(spark, sf):
    pairs = spark.sql("SELECT h AS handler, l, r FROM VALUES ('english'), ('cjk'), ('mixed') AS hs(h) CROSS JOIN VALUES ('中', '文'), ('a', '文'), ('文', 'b'), ('a', 'b'), ('カ', '字'), ('', 'x') AS p(l, r)")
    return pairs.withColumn("needs", T.needs_space(F.col("handler"), F.col("l"), F.col("r")))


_ABBR = " OR ".join(f"ends_with(s, '{a}')" for a in T.ABBREVIATIONS)
_SENT = r"""regexp_replace(trim(word), '[''"‘’“”)\]}»]+$', '')"""


@query("WITH " + L.SQL_WORDS + f""" SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {_SENT} AS s FROM words)
 WHERE ends_with(s, '!') OR ends_with(s, '?') OR (ends_with(s, '.') AND NOT regexp_matches(s, '\\b[A-Z]\\.([A-Z]\\.)*$') AND NOT ({_ABBR})) GROUP BY doc_id""")
def sentence_final_tokens(spark, sf):
    words = docs(spark, sf).select("doc_id", F.explode(T.tokenize_words(text())).alias("word"))
    return words.where(T.ends_sentence(F.col("word"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("WITH " + L.SQL_LINES + " SELECT page_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST(is_blank AS INT)) AS BIGINT) AS n_blank, CAST(max(strlen(norm)) AS BIGINT) AS longest FROM lines GROUP BY page_id")
def canonical_lines(spark, sf):
    out = L.lines(docs(spark, sf)).groupBy("page_id")
    return out.agg(F.count("*").alias("n_lines"), F.count_if("is_blank").alias("n_blank"), long(F.max(F.octet_length("norm"))).alias("longest"))


@query("WITH " + L.SQL_BLOCKS + " SELECT page_id, index, text, round(\"left\", 6) AS x, round(top, 6) AS y, line_id, CAST(conf AS INT) AS conf FROM boxes")
def layout_blocks(spark, sf):
    return L.blocks(docs(spark, sf)).select("page_id", long(F.col("index")).alias("index"), "text", F.round("left", 6).alias("x"), F.round("top", 6).alias("y"), "line_id", "conf")


def _requests(spark, sf, item, wrap) -> DataFrame:
    """Engine output of the synthetic pages: JSON of each page's boxes in order."""
    boxes = L.blocks(docs(spark, sf))
    rows = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.col("index").alias("at"), item.alias("v")))).alias("items"))
    return rows.select("page_id", F.to_json(wrap(F.transform("items", lambda x: x["v"]))).alias("input_json"), F.lit(1000).alias("page_width"), F.lit(1000).alias("page_height"))


_SCAN = "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY index) - 1 AS BIGINT) AS pos, text"


@query("WITH " + L.SQL_BLOCKS + f", ok AS (SELECT * FROM boxes WHERE conf >= 20) {_SCAN}, conf / 100::DOUBLE AS confidence, line_id FROM ok")
def tesseract_scan(spark, sf):
    px = lambda c: (F.col(c) * 1000.0).alias(c)
    item = F.struct("text", F.col("line_id").cast("int").alias("line_num"), px("left"), px("top"), px("width"), px("height"), F.col("conf").cast("double").alias("conf"))
    out = S.read("tesseract", _requests(spark, sf, item, lambda a: F.struct(a.alias("words"))))
    return out.select("page_id", long(F.col("index")).alias("pos"), "text", "confidence", "line_id")


@query("WITH " + L.SQL_BLOCKS + f" {_SCAN}, round((round(\"left\" * 1000) + 2) / 1000, 6) AS x, round((round(top * 1000) + 2) / 1000, 6) AS y, 0.075::DOUBLE AS w FROM boxes")
def easyocr_scan(spark, sf):
    x, y = F.round(F.col("left") * 1000), F.round(F.col("top") * 1000)
    box = F.array(F.array(x, y), F.array(x + 80, y), F.array(x + 80, y + 20), F.array(x, y + 20))
    item = F.struct(box.alias("bbox"), "text", (F.col("conf") / 100.0).alias("confidence"))
    out = S.read("easyocr", _requests(spark, sf, item, lambda a: F.struct(a.alias("results"))))
    return out.select("page_id", long(F.col("index")).alias("pos"), "text", F.round("left", 6).alias("x"), F.round("top", 6).alias("y"), F.round("width", 6).alias("w"))


@query("WITH " + L.SQL_BLOCKS + ', ok AS (SELECT page_id FROM boxes GROUP BY page_id HAVING max(top) <= 1) SELECT page_id, index AS pos, text, line_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY index) - 1 AS rn FROM boxes) JOIN ok USING (page_id)'.replace("index AS pos", "CAST(rn AS BIGINT) AS pos"))
def blocks_scan_validated(spark, sf):
    item = F.struct("text", F.struct("left", "top", "width", "height").alias("bounds"), (F.col("conf") / 100.0).alias("normalized_conf"), "line_id", F.lit("").alias("engine"))
    out = S.read("blocks", _requests(spark, sf, item, lambda a: a))
    return out.select("page_id", long(F.col("index")).alias("pos"), "text", "line_id")


@query("WITH " + L.SQL_BLOCKS + f""", l AS (SELECT page_id, line_id, avg(conf / 100::DOUBLE) AS c, dense_rank() OVER (PARTITION BY page_id ORDER BY CAST(line_id AS INT)) - 1 AS n FROM boxes GROUP BY page_id, line_id)
 SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY index) - 1 AS BIGINT) AS pos, text, round(c, 6) AS confidence, CAST(n AS VARCHAR) AS line_id FROM boxes JOIN l USING (page_id, line_id)""")
def apple_scan(spark, sf):
    boxes = L.blocks(docs(spark, sf))
    word = F.struct("index", F.struct("text", "left", "top", "width", "height", F.lit(0.0).alias("confidence")).alias("w"))
    by_line = boxes.groupBy("page_id", F.col("line_id").cast("int").alias("n")).agg(F.avg(F.col("conf") / 100.0).alias("c"), F.sort_array(F.collect_list(word)).alias("ws"))
    line = F.struct("n", F.struct(F.lit("").alias("text"), F.col("c").alias("confidence"), F.transform("ws", lambda x: x["w"]).alias("words")).alias("l"))
    rows = by_line.groupBy("page_id").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    requests = rows.select("page_id", F.to_json(F.transform("ls", lambda x: x["l"])).alias("input_json"), F.lit(1000).alias("page_width"), F.lit(1000).alias("page_height"))
    out = S.read("apple", requests)
    return out.select("page_id", long(F.col("index")).alias("pos"), "text", F.round("confidence", 6).alias("confidence"), "line_id")


@query("""WITH s AS (SELECT n_nationkey AS page_id, unnest(range(3)) AS slice_no FROM nation), h AS (SELECT *, 1500 + 10 * page_id - 100 * slice_no AS height FROM s),
 o AS (SELECT *, coalesce(sum(height) OVER (PARTITION BY page_id ORDER BY slice_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(height) OVER (PARTITION BY page_id) AS px FROM h)
 SELECT CAST(page_id AS BIGINT) AS page_id, CAST(slice_no AS INT) AS slice_no, round((0.5 * height + off) / px, 6) AS top, round(0.1 * height / px, 6) AS h, CAST(slice_no * 5 + 4 AS BIGINT) AS line_num FROM o""")
def slice_merge_offsets(spark, sf):
    base = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slice_no"))
    slices = base.withColumn("height", 1500 + 10 * F.col("page_id") - 100 * F.col("slice_no"))
    words = base.withColumns({"top": F.lit(0.5), "height": F.lit(0.1), "line_num": F.lit(4)})
    out = S.merge_slices(words, slices)
    return out.select("page_id", "slice_no", F.round("top", 6).alias("top"), F.round("height", 6).alias("h"), long(F.col("line_num")).alias("line_num"))


@query("WITH " + L.SQL_TOKENS + " SELECT page_id, count(DISTINCT tok) AS n FROM toks GROUP BY page_id")
def vocabulary(spark, sf):
    return P.vocabulary(L.line_tokens(docs(spark, sf))).groupBy("page_id").agg(F.count("*").alias("n"))


@query("WITH " + L.SQL_NORM_BLOCKS + " SELECT page_id, norm, string_agg(CAST(index AS VARCHAR), ',' ORDER BY index) AS cands FROM nb GROUP BY page_id, norm")
def word_index(spark, sf):
    out = P.word_index(L.normalized(L.blocks(docs(spark, sf))))
    return out.select("page_id", "norm", F.array_join(F.col("cands").cast("array<string>"), ",").alias("cands"))


_CHAIN = "WITH " + L.SQL_NORM_BLOCKS + ", " + L.SQL_TOKENS + ", idx AS (SELECT page_id, norm, count(*) AS k FROM nb GROUP BY page_id, norm), chain AS (SELECT t.page_id, t.line_no, t.pos, t.tok, i.k FROM toks t LEFT JOIN idx i ON t.page_id = i.page_id AND t.tok = i.norm)"


def _chain(spark, sf) -> DataFrame:
    d = docs(spark, sf)
    return P.chains(L.line_tokens(d), L.normalized(L.blocks(d)))


@query(_CHAIN + " SELECT page_id, CAST(line_no AS INT) AS line_no, CAST(sum(coalesce(k, 0)) AS BIGINT) AS n_candidates FROM chain GROUP BY page_id, line_no")
def chain_candidates(spark, sf):
    return _chain(spark, sf).groupBy("page_id", "line_no").agg(long(F.sum(F.coalesce("cands", F.lit(0)))).alias("n_candidates"))


@query(_CHAIN + " SELECT page_id, CAST(line_no AS INT) AS line_no, CAST(pos AS INT) AS pos, tok FROM chain WHERE k IS NULL")
def chain_missing(spark, sf):
    d = docs(spark, sf)
    return P.missing(L.line_tokens(d), L.normalized(L.blocks(d))).select("page_id", "line_no", "pos", "tok")


@query(_CHAIN + " SELECT page_id, CAST(line_no AS INT) AS line_no, n, missing, missing > 0 AND missing <= floor(n * 0.2) AND n - missing >= 2 AS holes_allowed FROM (SELECT page_id, line_no, count(*) AS n, count(*) FILTER (k IS NULL) AS missing FROM chain GROUP BY page_id, line_no)")
def hole_budget(spark, sf):
    return P.hole_budget(_chain(spark, sf))


def _steps(spark, sf) -> DataFrame:
    boxes = L.normalized(L.blocks(docs(spark, sf)))
    order = Window.partitionBy("page_id").orderBy("index")
    own = ("left", "top", "width", "height", "page_width", "page_height", "index")
    out = boxes.select("page_id", *(F.lag(c).over(order).alias(f"a_{c}") for c in own), *(F.col(c).alias(f"b_{c}") for c in own)).where("a_index is not null")
    return with_geometry(out)


_STEP_SQL = (
    "WITH "
    + L.SQL_NORM_BLOCKS
    + """, st AS (SELECT page_id, index AS bi, "left" AS bl, top AS bt, lag("left") OVER w AS al, lag(top) OVER w AS atop, lag(index) OVER w AS ai FROM nb WINDOW w AS (PARTITION BY page_id ORDER BY index)),
 g AS (SELECT *, 0.08::DOUBLE AS w, 0.02::DOUBLE AS h, bl - (al + 0.08::DOUBLE) AS gap, sqrt((al - bl) * (al - bl) + (atop - bt) * (atop - bt)) AS cd FROM st WHERE ai IS NOT NULL),
 c AS (SELECT *, atop <= bt + h AND atop + h >= bt AND bl >= al AS seq,
  CAST(trunc(atop * 1000) AS INT) + CAST(trunc(h * 1000) AS INT) < CAST(trunc(bt * 1000) AS INT) + 3 AND al + w > bl AND bt - (atop + h) <= 2 * h AS wrap,
  (bl > al + w AND bt + h < atop) OR (bl - (al + w) > 0.15 AND abs(bt - atop) < 2 * h) AS col FROM g),
 k AS (SELECT *, CASE WHEN seq AND cd <= w + w THEN 'sequential' WHEN seq THEN 'jump' WHEN wrap THEN 'wrap' WHEN col THEN 'column' ELSE 'far' END AS step_class,
  CASE WHEN seq AND cd <= w + w THEN 0.1 + gap WHEN seq THEN 25 + gap WHEN wrap THEN 1.0 + (bt - (atop + h)) WHEN col THEN 25 + gap ELSE 100 + cd END AS cost FROM c)"""
)


@query(_STEP_SQL + " SELECT page_id, step_class, count(*) AS n FROM k GROUP BY page_id, step_class")
def step_distance_classes(spark, sf):
    return _steps(spark, sf).groupBy("page_id", "step_class").agg(F.count("*").alias("n"))


@query(_STEP_SQL + " SELECT page_id, ai, bi, round(cost, 5) AS cost FROM k WHERE step_class = 'wrap'")
def wrap_steps(spark, sf):
    return _steps(spark, sf).where("step_class = 'wrap'").select("page_id", long(F.col("a_index")).alias("ai"), long(F.col("b_index")).alias("bi"), F.round("step_cost", 5).alias("cost"))


@query(_STEP_SQL + " SELECT page_id, ai, bi, round(cost, 5) AS cost FROM k WHERE step_class IN ('jump', 'column')")
def column_jumps(spark, sf):
    return _steps(spark, sf).where("step_class in ('jump', 'column')").select("page_id", long(F.col("a_index")).alias("ai"), long(F.col("b_index")).alias("bi"), F.round("step_cost", 5).alias("cost"))


@query("WITH " + L.SQL_NORM_BLOCKS + ", " + L.SQL_TOKENS + " SELECT n.page_id, n.index, n.text FROM nb n WHERE NOT EXISTS (SELECT 1 FROM toks t WHERE t.page_id = n.page_id AND t.tok = n.norm)")
def leftover_blocks(spark, sf):
    d = docs(spark, sf)
    vocab = P.vocabulary(L.line_tokens(d)).withColumnRenamed("tok", "norm")
    return L.normalized(L.blocks(d)).join(vocab, ["page_id", "norm"], "left_anti").select("page_id", long(F.col("index")).alias("index"), "text")


@query("WITH " + L.SQL_BLOCKS + """, f AS (SELECT *, CASE WHEN lag(index) OVER w IS NULL OR line_id IS DISTINCT FROM lag(line_id) OVER w OR top - (lag(top) OVER w + lag(height) OVER w) > 1.5 * greatest(height, lag(height) OVER w) THEN 1 ELSE 0 END AS cut FROM boxes WINDOW w AS (PARTITION BY page_id ORDER BY index)),
 i AS (SELECT *, sum(cut) OVER (PARTITION BY page_id ORDER BY index) AS island FROM f) SELECT page_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(index) AS first, string_agg(text, ' ' ORDER BY index) AS text FROM i GROUP BY page_id, island""")
def leftover_islands(spark, sf):
    out = P.islands(L.blocks(docs(spark, sf))).groupBy("page_id", long(F.col("island")).alias("island"))
    out = out.agg(F.count("*").alias("n"), long(F.min("index")).alias("first"), F.sort_array(F.collect_list(F.struct("index", "text"))).alias("w"))
    return out.select("page_id", "island", "n", "first", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))


@query("WITH " + L.SQL_BLOCKS + """, m AS (SELECT page_id, line_id, abs("left" - lag("left") OVER w) AS dx, abs(top - lag(top) OVER w) AS dy FROM boxes WINDOW w AS (PARTITION BY page_id, line_id ORDER BY index)),
 v AS (SELECT page_id, line_id, sum(dx) AS dx, sum(dy) AS dy FROM m GROUP BY page_id, line_id HAVING count(*) >= 3),
 c AS (SELECT page_id, count(*) FILTER (dy > dx) AS vertical, count(*) FILTER (dy <= dx) AS horizontal FROM v GROUP BY page_id) SELECT *, vertical >= 3 AND vertical >= 2 * horizontal AS is_vertical FROM c""")
def vertical_detect(spark, sf):
    return P.vertical_votes(L.blocks(docs(spark, sf)))


@query("WITH " + L.SQL_BLOCKS + " SELECT page_id, CAST(count(*) AS BIGINT) AS n_words, round(avg(conf), 6) AS mean_conf, round(min(\"left\"), 6) AS x0, round(min(top), 6) AS y0, round(max(\"left\" + width), 6) AS x1, round(max(top + height), 6) AS y1 FROM boxes GROUP BY page_id")
def page_bounds(spark, sf):
    b = L.blocks(docs(spark, sf)).groupBy("page_id")
    return b.agg(F.count("*").alias("n_words"), F.round(F.avg("conf"), 6).alias("mean_conf"), F.round(F.min("left"), 6).alias("x0"), F.round(F.min("top"), 6).alias("y0"), F.round(F.max(F.col("left") + F.col("width")), 6).alias("x1"), F.round(F.max(F.col("top") + F.col("height")), 6).alias("y1"))


@query("WITH " + L.SQL_WORDS + """, s AS (SELECT doc_id, pos, word, sum(strlen(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM words) SELECT doc_id AS page_id, CAST(pos AS INT) AS pos, CAST(e - strlen(word) - 1 AS BIGINT) AS span_start, CAST(e - 1 AS BIGINT) AS span_end FROM s""")
def token_spans(spark, sf):
    w = docs(spark, sf).select(F.col("doc_id").alias("page_id"), F.posexplode(T.tokenize_words(text())).alias("pos", "word"))
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.octet_length("word") + 1).over(upto)
    return w.select("page_id", "pos", (end - F.octet_length("word") - 1).alias("span_start"), (end - 1).alias("span_end"))


@query("WITH " + L.SQL_WORDS + f""", f AS (SELECT doc_id, pos, word, {_SENT} AS s FROM words), e AS (SELECT *, CASE WHEN ends_with(s, '!') OR ends_with(s, '?') OR (ends_with(s, '.') AND NOT regexp_matches(s, '\\b[A-Z]\\.([A-Z]\\.)*$') AND NOT ({_ABBR})) THEN 1 ELSE 0 END AS fin FROM f),
 l AS (SELECT *, coalesce(sum(fin) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM e)
 SELECT doc_id AS page_id, CAST(line_no AS BIGINT) AS line_no, string_agg(word, ' ' ORDER BY pos) AS text FROM l GROUP BY doc_id, line_no""")
def no_canonical_resegment(spark, sf):
    w = docs(spark, sf).select(F.col("doc_id").alias("page_id"), F.posexplode(T.tokenize_words(text())).alias("index", "text"))
    return P.resegment(w).withColumn("line_no", long(F.col("line_no")))


@query("WITH " + L.SQL_NORM_BLOCKS + ", " + L.SQL_TOKENS + """, tri AS MATERIALIZED (SELECT DISTINCT page_id, lag(tok) OVER w AS a, tok AS b, lead(tok) OVER w AS c FROM toks WINDOW w AS (PARTITION BY page_id, line_no ORDER BY pos)),
 v AS MATERIALIZED (SELECT DISTINCT page_id, tok FROM toks), n0 AS MATERIALIZED (SELECT nb.page_id, index, line_id, norm, v.tok IS NOT NULL AS known FROM nb LEFT JOIN v ON nb.page_id = v.page_id AND nb.norm = v.tok),
 ctx AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY page_id, line_id) AS n, lag(norm) OVER w AS p1, lead(norm) OVER w AS n1, lead(norm, 2) OVER w AS n2, lag(known) OVER w AS k1, lead(known) OVER w AS l1, lead(known, 2) OVER w AS l2 FROM n0 WINDOW w AS (PARTITION BY page_id, line_id ORDER BY index)),
 mid AS (SELECT page_id, a, c, min(b) AS fix FROM tri WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY page_id, a, c HAVING count(DISTINCT b) = 1),
 fst AS (SELECT page_id, b, c, min(a) AS fix FROM tri WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY page_id, b, c HAVING count(DISTINCT a) = 1),
 lst AS (SELECT page_id, a, b, min(c) AS fix FROM tri WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY page_id, a, b HAVING count(DISTINCT c) = 1),
 r1 AS MATERIALIZED (SELECT x.page_id, index, fix FROM ctx x JOIN mid m ON x.page_id = m.page_id AND p1 = a AND n1 = c WHERE NOT known AND k1 AND l1 UNION ALL SELECT x.page_id, index, fix FROM ctx x JOIN fst m ON x.page_id = m.page_id AND n1 = b AND n2 = c WHERE NOT known AND p1 IS NULL AND n >= 3 AND l1 AND l2),
 one AS MATERIALIZED (SELECT n0.page_id, n0.index, line_id, coalesce(r1.fix, norm) AS norm, known OR r1.fix IS NOT NULL AS known, r1.fix AS f1 FROM n0 LEFT JOIN r1 ON n0.page_id = r1.page_id AND n0.index = r1.index),
 ctx2 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY page_id, line_id) AS n, lag(norm) OVER w AS p1, lag(norm, 2) OVER w AS p2, lead(norm) OVER w AS n1, lag(known) OVER w AS k1, lag(known, 2) OVER w AS k2 FROM one WINDOW w AS (PARTITION BY page_id, line_id ORDER BY index)),
 r2 AS (SELECT x.page_id, index, fix FROM ctx2 x JOIN lst m ON x.page_id = m.page_id AND p2 = a AND p1 = b WHERE NOT known AND n1 IS NULL AND n >= 3 AND k1 AND k2)
 SELECT page_id, index, suggested FROM (SELECT one.page_id, one.index, coalesce(r2.fix, f1) AS suggested FROM one LEFT JOIN r2 ON one.page_id = r2.page_id AND one.index = r2.index) WHERE suggested IS NOT NULL""")
def line_repair(spark, sf):
    d = docs(spark, sf)
    out = P.line_repair(L.normalized(L.blocks(d)), L.line_tokens(d))
    return out.where("suggested is not null").select("page_id", long(F.col("index")).alias("index"), "suggested")


@query("SELECT doc_id AS page_id, CAST(i.item_id AS BIGINT) AS item_id FROM documents d JOIN benchmark i ON contains(d.text, i.text) WHERE i.text <> ''")
def containment_match(spark, sf):
    """Items within documents: the rarest word of an item picks the documents whose text is then searched."""
    d = docs(spark, sf).where("text is not null")
    items = table(spark, sf, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("item"))
    # whole words of an item, without the first and the last, are whole words of a document that holds it
    inner = items.select("item_id", "item", F.explode(F.array_distinct(F.slice(T.tokenize_words(F.col("item")), 2, F.greatest(F.size(T.tokenize_words(F.col("item"))) - 2, F.lit(0))))).alias("word"))
    words = d.select("doc_id", F.explode(F.array_distinct(T.tokenize_words(F.col("text")))).alias("word"))
    counts = words.join(F.broadcast(inner.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    pick = inner.join(counts, "word", "left").groupBy("item_id", "item").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "word")).alias("m")).select("item_id", "item", F.col("m.word").alias("word"))
    held = words.join(pick, "word").select("doc_id", "item_id", "item")
    short = items.join(inner.select("item_id").distinct(), "item_id", "left_anti")
    sure = d.join(held, "doc_id").where(F.contains("text", F.col("item"))).select(F.col("doc_id").alias("page_id"), long(F.col("item_id")).alias("item_id"))
    return sure.unionByName(d.join(short, F.contains("text", F.col("item"))).select(F.col("doc_id").alias("page_id"), long(F.col("item_id")).alias("item_id")))


def _sql_rewrites() -> str:
    by = lambda old, new: f"list_transform(list_filter(range(1, length(word) + 1), lambda i: substr(word, i, {len(old)}) = '{old}'), lambda i: substr(word, 1, i - 1) || '{new}' || substr(word, i + {len(old)}))"
    return f"flatten([{', '.join(by(old, new) for old, new in evaluate.CONFUSIONS)}])"


_POOLS = f"CASE WHEN regexp_matches(c, '{evaluate.IDEOGRAPH}') THEN '{evaluate.IDEOGRAPHS}' WHEN regexp_matches(c, '\\p{{Nd}}') THEN '0123456789' WHEN regexp_matches(c, '\\p{{Lu}}') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' ELSE 'abcdefghijklmnopqrstuvwxyz' END"


@query("WITH " + L.SQL_WORDS + f""", c AS (SELECT doc_id AS page_id, pos, word, regexp_matches(word, '{evaluate.LETTER}') AS able, (doc_id * 7919 + pos * 10473) % 1009 AS draw FROM words),
 r AS (SELECT *, row_number() OVER (PARTITION BY page_id, able ORDER BY draw, pos) AS k, count(*) FILTER (able) OVER (PARTITION BY page_id) AS n FROM c),
 w AS (SELECT *, CASE WHEN able AND k <= round(n * 0.05) THEN {_sql_rewrites()} END AS found, list_filter(range(1, length(word) + 1), lambda i: regexp_matches(substr(word, i, 1), '{evaluate.LETTER}')) AS spots FROM r),
 s AS (SELECT *, CASE WHEN len(found) = 0 THEN spots[1 + draw % len(spots)] END AS spot, substr(word, CASE WHEN len(found) = 0 THEN spots[1 + draw % len(spots)] ELSE 1 END, 1) AS c FROM w),
 p AS (SELECT *, replace({_POOLS}, c, '') AS pool FROM s)
 SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN found IS NULL THEN word WHEN len(found) > 0 THEN found[1 + draw % len(found)] ELSE substr(word, 1, spot - 1) || substr(pool, 1 + draw % length(pool), 1) || substr(word, spot + 1) END AS noisy FROM p""")
def noise_injection(spark, sf):
    """One word in twenty of each page, drawn by position."""
    w = docs(spark, sf).select(F.col("doc_id").alias("page_id"), F.posexplode(T.tokenize_words(text())).alias("pos", "word"))
    draw = (F.col("page_id") * 7919 + F.col("pos").cast("long") * 10473) % 1009
    return evaluate.inject_noise(w, 0.05, draw=draw).select("page_id", "pos", F.col("word").alias("noisy"))


_RATCHET = """WITH r AS (SELECT o_custkey AS k, avg(o_totalprice) / 5000 AS acc FROM orders GROUP BY o_custkey), b AS (SELECT c_custkey AS k, c_acctbal / 100 AS acc FROM customer)
 SELECT CAST(coalesce(r.k, b.k) AS BIGINT) AS k, round(greatest(coalesce(b.acc, 0), coalesce(floor(r.acc * 100) / 100, 0)), 2) AS baseline, coalesce(r.acc < b.acc - 0.05, false) AS failed FROM r FULL JOIN b ON r.k = b.k"""


@query(_RATCHET)
def ratchet_baselines(spark, sf):
    runs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.avg("o_totalprice") / 5000).alias("accuracy"))
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 100).alias("accuracy"))
    return evaluate.ratchet(runs, base, "k").select(long(F.col("k")).alias("k"), F.round("baseline", 2).alias("baseline"), "failed")
