"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

Every item is cut into windows of ``width`` consecutive words (a shorter item is one window). The document frequency of
the test terms is counted over all documents; the rarest term of each window is its anchor, and a window with a term
that never occurs is dropped. The index stores the postings of the anchors — document, position, and the words around
it — next to one directory row for each document with its number of words. The posting lists are then intersected with
the windows from the rarest term outwards: the words at the offsets of the other terms must be theirs. With ``slop`` a
window also matches where all its words stand within ``slop`` more words than it has (proximity).

The sets of test terms and anchors are broadcast in slices of a bounded size, one pass over the documents for each; the
windows themselves are joined to the stored postings by whatever join their measured size allows.

Defined cases: null and empty texts have no words and no hits; an item without words is ignored; items with equal
windows all count; repeated rows get the same result; an empty benchmark leaves every document clean; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import lower_ascii, materialize, without
from quirefold.tables import table

WIDTH = 8
#: Everything that is no word: the ASCII range without digits and lower-case letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of terms that one broadcast may hold.
TERM_BYTES = 16 << 20
CONTAMINATED = 2


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``phrase, item_id`` of each window of each item, distinct."""
    cut = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = cut.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))).alias("start"))
    return cut.select(F.concat_ws(" ", F.slice("w", F.col("start") + 1, F.lit(width))).alias("phrase"), "item_id").distinct()


def slices(terms: DataFrame) -> list[DataFrame]:
    """``terms`` in parts of at most about TERM_BYTES, by a hash of the term."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0)).alias("b")).first()["b"]
    parts = -(-size // TERM_BYTES) or 1
    if parts == 1:
        return [terms]
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(2 * parts)) == k) for k in range(2 * parts)]


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, df``: the number of occurrences of each test term in all documents."""
    found = docs.select(F.explode(words(F.col("text"))).alias("term"))
    counted = [found.join(F.broadcast(part), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")) for part in slices(terms)]
    return reduce(DataFrame.unionByName, counted)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key (``k1, k2``) that repeated rows share and that is never null."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"))


def postings(docs: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """The stored index: a row for each posting of an anchor, and one with the empty term for each document."""
    rows = keyed(docs).select("doc_id", "k1", "k2", words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "k1", "k2", "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("p", "term"))
    lists = []
    for k, part in enumerate(slices(anchors)):
        own = part if k else part.unionByName(part.sparkSession.range(1).select(F.lit("").alias("term")))
        hit = rows.join(F.broadcast(own), "term")
        lists.append(
            hit.select(
                "term",
                "doc_id",
                "k1",
                "k2",
                (F.col("p") - 1).alias("pos"),
                F.size("w").alias("n_words"),
                F.when(F.col("term") == "", F.array().cast("array<string>")).otherwise(F.slice("w", F.greatest(F.col("p") - reach, F.lit(1)), F.least(F.col("p"), F.lit(reach + 1)) + reach)).alias("near"),
                F.least(F.col("p") - 1, F.lit(reach)).alias("here"),
            )
        )
    return materialize(reduce(DataFrame.unionByName, lists), "postings")


def match(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the matches (``k1, k2, phrase, start, len, kind``) and the windows (``phrase, item_id``)."""
    wins = materialize(windows(items, width), "windows")
    phrases = wins.select("phrase").distinct().select("phrase", F.split("phrase", " ").alias("terms"))
    parts = phrases.select("phrase", "terms", F.posexplode("terms").alias("offset", "term"))
    df = materialize(frequencies(docs, materialize(parts.select("term").distinct(), "terms")), "frequencies")
    ranked = parts.join(df, "term", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "term")).alias("a"), F.count("*").cast("int").alias("len"))
    anchored = materialize(ranked.where("a.df > 0").select("phrase", "len", F.col("a.term").alias("term"), F.col("a.offset").alias("offset")), "anchored")
    reach = width - 1 + slop
    index = postings(docs, materialize(anchored.select("term").distinct(), "anchors"), reach)
    near = index.where("term <> ''").join(anchored, "term")
    first = F.col("here") - F.col("offset")
    exact = (first >= 0) & (F.concat_ws(" ", F.slice("near", F.greatest(first, F.lit(0)) + 1, F.col("len"))) == F.col("phrase"))
    found = near.where(exact).select("k1", "k2", "phrase", (F.col("pos") - F.col("offset")).alias("start"), "len", F.lit("phrase").alias("kind"))
    if slop:
        spans = F.filter(F.sequence(F.greatest(F.col("here") - F.col("len") - slop + 1, F.lit(0)), F.col("here")), lambda at: F.size(F.array_except(F.split("phrase", " "), F.slice("near", at + 1, F.col("len") + slop))) == 0)
        loose = near.where(~exact).withColumn("spans", spans).where(F.size("spans") > 0)
        found = found.unionByName(loose.select("k1", "k2", "phrase", (F.col("pos") - F.col("here") + F.element_at("spans", -1)).alias("start"), (F.col("len") + slop).alias("len"), F.lit("proximity").alias("kind")))
    return index, materialize(found.distinct(), "matches"), wins


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, leaked`` of every row of ``docs``.

    ``contaminated`` asks for windows of two items; ``leaked`` for one window of full width, or two items of any length.
    """
    index, found, wins = match(docs, items, width)
    # counted by document: the longest window found says whether one is of full width
    whole = found.groupBy("k1", "k2").agg((F.max("len") >= width).alias("whole"))
    hit = found.select("k1", "k2", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_hit"))
    held = found.select("k1", "k2", "phrase").distinct().join(wins, "phrase").select("k1", "k2", F.col("item_id").cast("string").alias("item")).distinct()
    held = held.groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("items"))
    rows = index.where("term = ''").select("doc_id", "k1", "k2", F.col("n_words").cast("long").alias("n_words"))
    out = rows.join(hit.join(held, ["k1", "k2"]).join(whole, ["k1", "k2"]), ["k1", "k2"], "left")
    n_items = F.coalesce("n_items", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_items >= CONTAMINATED).alias("contaminated"), (F.coalesce("whole", F.lit(False)) | (n_items >= CONTAMINATED)).alias("leaked"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark: none that is ``leaked``.

    A passage of one item is enough, if it has the full width; a short item alone, which may be any common word, is not.
    Null and empty texts hold nothing and stay; an empty benchmark keeps all; repeated rows fall or stay together.
    """
    return without(docs, decontaminate(docs, items).select("doc_id", (~F.col("leaked")).alias("kept")), "kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("leaked")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 8) AS l, array_to_string(w[s:s + least(len(w), 8) - 1], ' ') AS phrase
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, s, l, array_to_string(w[s:s + l - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lens WHERE len(w) >= l)),
m AS (SELECT DISTINCT doc_id, s, l, phrase FROM dw WHERE phrase IN (SELECT phrase FROM bw)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m JOIN bw USING (phrase)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
