"""Further registered queries: orientation, right-to-left repair, hyphens, experiments, text layers, anchors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import assemble, evaluate, prepare
from quirefold.plans import layout as L
from quirefold.plans.queries import docs, long, query, text
from quirefold.sources import engines
from quirefold.tables import table

LATIN, HEBREW = "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתךםןף"


@query("WITH " + L.SQL_BLOCKS + """, m AS (SELECT page_id, abs("left" - lag("left") OVER w) AS dx, abs(top - lag(top) OVER w) AS dy, lag(index) OVER w AS p FROM boxes WINDOW w AS (PARTITION BY page_id ORDER BY index)),
 c AS (SELECT page_id, count(*) FILTER (dy > dx) AS vertical, count(*) FILTER (dy <= dx) AS horizontal FROM m WHERE p IS NOT NULL GROUP BY page_id) SELECT *, vertical >= 30 AND vertical >= 2 * horizontal AS is_vertical FROM c""")
def vertical_flow(spark, sf):
    """Square boxes of the synthetic pages."""
    return prepare.vertical_flow(L.blocks(docs(spark, sf)).withColumn("width", F.lit(20 / 1000.0)))


@query("WITH " + L.SQL_WORDS + f""", r AS (SELECT doc_id AS page_id, pos, CAST(pos // 10 AS VARCHAR) AS line_id, CASE WHEN (pos // 10) % 2 = 0 THEN translate(word, '{LATIN}', '{HEBREW}') ELSE word END AS text FROM words),
 f AS (SELECT *, len(regexp_extract_all(text, '[֐-ࣿיִ-ﻼ]')) * 2 > length(text) AS rtl FROM r),
 m AS (SELECT *, sum(CAST(rtl AS INT)) OVER (PARTITION BY page_id, line_id) * 2 > count(*) OVER (PARTITION BY page_id, line_id) AS most FROM f)
 SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CAST(line_id AS INT), CASE WHEN most THEN -pos ELSE pos END) - 1 AS BIGINT) AS index, CASE WHEN rtl THEN reverse(text) ELSE text END AS text FROM m""")
def rtl_repair(spark, sf):
    """Every second row of the synthetic pages in Hebrew letters."""
    words = docs(spark, sf).select("doc_id", F.posexplode(T.tokenize_words(text())).alias("pos", "word"))
    row = F.floor(F.col("pos") / 10)
    own = words.select(F.col("doc_id").alias("page_id"), F.col("pos").alias("index"), row.cast("string").alias("line_id"), F.when(row % 2 == 0, F.translate("word", LATIN, HEBREW)).otherwise(F.col("word")).alias("text"))
    return prepare.rtl_repair(own).select("page_id", long(F.col("index")).alias("index"), "text")


@query()
def hyphen_explode(spark, sf):
    d = docs(spark, sf)
    return prepare.split_hyphens(L.blocks(d), L.line_tokens(d)).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("hyphen_after").alias("n_cut"))


@query("""WITH r AS (SELECT o_orderpriority AS variant, o_custkey AS k, avg(o_totalprice) AS acc FROM orders GROUP BY 1, 2)
 SELECT r.variant, round(avg(r.acc - b.acc), 4) AS mean_delta, count(*) AS n FROM r JOIN r b ON r.k = b.k AND b.variant = '1-URGENT' WHERE r.variant <> '1-URGENT' GROUP BY r.variant""")
def experiment_delta(spark, sf):
    runs = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("variant"), F.col("o_custkey").alias("case")).agg(F.avg("o_totalprice").alias("accuracy"))
    return evaluate.experiment_deltas(runs, "1-URGENT").withColumn("mean_delta", F.round("mean_delta", 4))


@query("WITH " + L.SQL_BLOCKS + " SELECT page_id AS doc, CAST(row_number() OVER (PARTITION BY page_id ORDER BY index) - 1 AS BIGINT) AS pos, text, round(\"left\", 6) AS x, round(least(top, 1), 6) AS y, '1-0-0-' || line_id AS line_id FROM boxes WHERE text NOT LIKE '###%'")
def poppler_scan(spark, sf):
    """The synthetic pages as text-layer rows, each behind the row that opens its page."""
    boxes = L.blocks(docs(spark, sf))
    zero = F.lit(0)
    words = boxes.select(F.col("page_id").alias("doc"), (F.col("index") + 1).alias("row_no"), F.lit(1).alias("page_num"), zero.alias("par_num"), zero.alias("block_num"), F.col("line_id").alias("line_num"), *((F.col(c) * 1000).alias(c) for c in ("left", "top", "width", "height")), "text")
    opens = boxes.select(F.col("page_id").alias("doc")).distinct().select("doc", zero.alias("row_no"), F.lit(1).alias("page_num"), zero.alias("par_num"), zero.alias("block_num"), F.lit("0").alias("line_num"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"), F.lit("###PAGE###").alias("text"))
    out = engines.poppler_tsv(words.unionByName(opens))
    return out.select("doc", long(F.col("index")).alias("pos"), "text", F.round("left", 6).alias("x"), F.round("top", 6).alias("y"), "line_id")


@query("WITH " + L.SQL_LINES + """, f AS (SELECT page_id, line_no FROM lines WHERE NOT is_blank AND line_no % 3 = 0), t AS (SELECT page_id, line_no FROM lines WHERE NOT is_blank AND line_no % 3 <> 0),
 d AS (SELECT t.page_id, t.line_no, f.line_no AS anchor, rank() OVER (PARTITION BY t.page_id, t.line_no ORDER BY abs(t.line_no - f.line_no)) AS r FROM t JOIN f ON t.page_id = f.page_id)
 SELECT page_id, CAST(line_no AS INT) AS line_no, CAST(anchor AS INT) AS anchor FROM d WHERE r = 1""")
def anchor_nearest(spark, sf):
    """Nearest found lines of the others, ties kept; here every third line counts as found. A page without any gives none."""
    lines = L.lines(docs(spark, sf)).where("not is_blank").select("page_id", "line_no")
    up = Window.partitionBy("page_id").orderBy("line_no")
    found = F.when(F.col("line_no") % 3 == 0, F.col("line_no"))
    # the last found line before and the first one behind, without a limit on how far they are
    near = lines.withColumn("before", F.last(found, ignorenulls=True).over(up)).withColumn("after", F.first(found, ignorenulls=True).over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    near = near.where("line_no % 3 <> 0").withColumn("least", F.least(F.col("line_no") - F.col("before"), F.col("after") - F.col("line_no")))
    both = near.select("page_id", "line_no", "least", F.explode(F.array("before", "after")).alias("anchor"))
    return both.where("abs(line_no - anchor) = least").select("page_id", "line_no", "anchor")


@query("WITH " + L.SQL_WORDS + """, l AS (SELECT doc_id AS page_id, pos AS line_no, pos % 9 NOT IN (0, 1) AS is_blank FROM words), b AS (SELECT page_id, min(line_no) AS lo, max(line_no) AS hi FROM l WHERE NOT is_blank GROUP BY page_id)
 SELECT l.page_id, CAST(l.line_no AS INT) AS line_no FROM l JOIN b ON l.page_id = b.page_id AND l.line_no > lo AND l.line_no < hi WHERE l.is_blank
 AND (l.line_no % 9 IN (2, 3, 4, 5, 6) OR l.line_no % 9 IN (4, 5, 6, 7, 8))""")
def blank_line_rescue(spark, sf):
    """Words as lines, of which two of nine hold text: blank ones between found ones, with a found one within five lines."""
    words = docs(spark, sf).select(F.col("doc_id").alias("page_id"), F.posexplode(T.tokenize_words(text())).alias("line_no", "word"))
    return assemble.rescued_blanks(words.select("page_id", "line_no", (~(F.col("line_no") % 9).isin(0, 1)).alias("is_blank")))
