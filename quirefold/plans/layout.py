"""Word boxes from plain texts by integer arithmetic: the pages that the queries work on.

Each document is a page of 1000 by 1000 pixels with ten words a row; words are misread and dropped by fixed residues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as T

PAGE = 1000


def blocks(docs: DataFrame, noisy: bool = True) -> DataFrame:
    """``page_id, index, text, left, top, width, height, line_id, conf, page_width, page_height`` of each word box."""
    words = docs.select("doc_id", F.posexplode(T.tokenize_words(F.coalesce("text", F.lit("")))).alias("pos", "word"))
    row, col = F.floor(F.col("pos") / 10), F.col("pos") % 10
    d, p = F.col("doc_id"), F.col("pos")
    misread = ((d * 7 + p * 13) % 50 == 0) if noisy else F.lit(False)
    out = words.select(
        d.alias("page_id"),
        p.alias("index"),
        F.when(misread, F.concat(F.col("word"), F.lit("~x"))).otherwise(F.col("word")).alias("text"),
        ((50 + 90 * col) / F.lit(1000.0)).alias("left"),
        ((50 + 30 * row) / F.lit(1000.0)).alias("top"),
        F.lit(80 / 1000.0).alias("width"),
        F.lit(20 / 1000.0).alias("height"),
        row.cast("string").alias("line_id"),
        ((d * 31 + p * 17) % 100).cast("int").alias("conf"),
        F.lit(PAGE).alias("page_width"),
        F.lit(PAGE).alias("page_height"),
    )
    return out.where((F.col("page_id") * 11 + F.col("index") * 19) % 97 != 0) if noisy else out


def lines(docs: DataFrame) -> DataFrame:
    """Canonical lines: ``page_id, line_no, text, norm, is_blank``."""
    out = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    return out.withColumn("norm", T.normalize_core(F.col("text"))).withColumn("is_blank", F.trim("text") == "")


def line_tokens(docs: DataFrame) -> DataFrame:
    """``page_id, line_no, pos, tok`` of each normalized token of each canonical line."""
    return lines(docs).select("page_id", "line_no", F.posexplode(T.tokenize_words(F.col("norm"))).alias("pos", "tok"))


def keyed(rows: DataFrame, word: str = "text", key: str = "norm") -> DataFrame:
    """``rows`` with the key of their ``word``: each distinct word is normalized once, and joined back.

    A word may be a third of all rows, so the few words are joined by their measured size, or by a join that splits skew.
    """
    names = rows.select(F.col(word).alias("_word")).distinct().select("_word", T.normalize_core(F.col("_word")).alias(key))
    return rows.join(names, rows[word] == names["_word"]).drop("_word")


def normalized(boxes: DataFrame) -> DataFrame:
    """Boxes with their key; those that normalize to blank go."""
    return keyed(boxes).where("norm <> ''")


#: The same tables for DuckDB.
SEP = r"""[\s\x0B\-.,:;!?“”‘’"—–…·•«»‒―‑()\[\]{}|@#*&+=~\^°©®™¿¡`。，！？；：、（）《》「」『』【】｛｝]+"""


def sql_normalize(col: str) -> str:
    base = f"strip_accents(replace(replace({col}, 'ß', 'ss'), 'ẞ', 'SS'))"
    spaced = f"""regexp_replace(replace(replace({base}, '’', ''''), '''', ''), '{SEP}', ' ', 'g')"""
    return f"rtrim(array_to_string(list_transform(string_split(lower(trim({spaced})), ' '), lambda x: CASE WHEN regexp_matches(x, '[\\p{{L}}\\p{{N}}_]') THEN x || ' ' ELSE x END), ''))"


SQL_WORDS = "words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents))"
SQL_BLOCKS = (
    SQL_WORDS
    + """, boxes AS MATERIALIZED (SELECT doc_id AS page_id, pos AS index, CASE WHEN (doc_id * 7 + pos * 13) % 50 = 0 THEN word || '~x' ELSE word END AS text,
 (50 + 90 * (pos % 10)) / 1000::DOUBLE AS "left", (50 + 30 * (pos // 10)) / 1000::DOUBLE AS top, 80 / 1000::DOUBLE AS width, 20 / 1000::DOUBLE AS height,
 CAST(pos // 10 AS VARCHAR) AS line_id, (doc_id * 31 + pos * 17) % 100 AS conf FROM words WHERE (doc_id * 11 + pos * 19) % 97 <> 0)"""
)
SQL_NORM_BLOCKS = SQL_BLOCKS + f", nb AS MATERIALIZED (SELECT b.*, n.norm FROM boxes b JOIN (SELECT text, {sql_normalize('text')} AS norm FROM (SELECT DISTINCT text FROM boxes)) n ON b.text = n.text WHERE n.norm <> '')"
SQL_LINES = f"lines AS (SELECT doc_id AS page_id, line_no, text, {sql_normalize('text')} AS norm, trim(text) = '' AS is_blank FROM (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"
SQL_TOKENS = SQL_LINES + ", toks AS MATERIALIZED (SELECT page_id, line_no, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM (SELECT page_id, line_no, list_filter(string_split(norm, ' '), lambda x: x <> '') AS t FROM lines))"
