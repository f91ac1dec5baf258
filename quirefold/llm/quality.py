"""Quality: an interpolated modified Kneser-Ney n-gram model of trusted text.

Each language has a model of ``ORDER`` bytes over its trusted documents (those labelled of good quality) outside one fold,
whose documents set the thresholds. Tasks count the n-grams of their texts; the counts of all orders, the continuation
counts, the discounts and the context totals are aggregations of those, and the probability of every n-gram that any
document holds is found by joins of the count tables, sharded by n-gram and by context, from order 1 upwards. The
finished table is sent to the documents in slices of at most ``SLICE`` n-grams, one at a time and one pass each; a
document's perplexity is the exponential of its mean negative log-probability over all bytes of its whole text.

The score that is judged is the smoothed perplexity: the same mean after ``PRIOR`` further bytes at the language's median
cost, so that a few bytes prove little. A document is rejected if it is above the ``UPPER`` quantile of its language's
held-out trusted documents. Quantiles are taken from counts on a grid of ``1 / GRID`` nats, so no group is collected.

Defined cases: a null or empty text has no perplexity and is kept; a null language is a language of its own; a language
without trusted text outside the fold has no model, perplexity and threshold, and its documents are kept; one without
trusted text inside the fold takes its quantiles from its other trusted documents; labels that are null or contradict
(good and bad for one id) do not make a document trusted; a null doc_id is never trusted; repeated rows get the same
result; empty documents or labels give no rows or no verdicts; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm.common import discard, materialize, without
from quirefold.shared import release
from quirefold.tables import table

ORDER = 5
BITS = 8 * ORDER
MASK = (1 << BITS) - 1
#: Probabilities of one slice: 12 bytes each.
SLICE = 4_000_000
#: The quantile of held-out trusted documents up to which documents are kept, and steps of a nat that tell costs apart.
UPPER, GRID = 0.995, 1000
#: One fold of the trusted documents is not trained on and sets the quantiles.
FOLDS = 5
#: Bytes at the language's median cost that every text is given.
PRIOR = 200
#: A language that no key of the model has.
UNKNOWN = (1 << 22) - 1
#: Bytes of text that a task counts at once.
CHUNK = 1 << 19


def gram_keys(texts: list[str | None], langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key (language above, last ORDER bytes below) of each byte of each text, and the number of its text."""
    pad = b"\xff" * (ORDER - 1)
    raw = [pad + (t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    lengths = np.array([len(r) for r in raw])
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = np.zeros(max(0, len(data) - ORDER + 1), np.int64)
    for k in range(ORDER):
        keys = (keys << 8) | data[k : k + len(keys)]
    held = inside[ORDER - 1 :] >= ORDER - 1
    owner = owner[ORDER - 1 :][held]
    return keys[held] | (langs[owner].astype(np.int64) << BITS), owner


def _chunks(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    sizes = rows["text"].str.len().fillna(0).to_numpy()
    group = (np.cumsum(sizes) // CHUNK).astype(int)
    for _, part in rows.groupby(group, sort=False):
        yield part


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the n-grams of a task's texts, merged as they grow."""
    keys, counts, held = [], [], 0
    for rows in frames:
        for part in _chunks(rows):
            k, c = np.unique(gram_keys(list(part["text"]), part["lid"].to_numpy())[0], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > 1_000_000:
                k, at = np.unique(np.concatenate(keys), return_inverse=True)
                keys, counts = [k], [np.bincount(at, np.concatenate(counts)).astype(np.int64)]
                held = len(k)
                if held > 700_000:
                    yield pd.DataFrame({"g": keys[0], "c": counts[0]})
                    keys, counts, held = [], [], 0
    if keys:
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        yield pd.DataFrame({"g": k, "c": np.bincount(at, np.concatenate(counts)).astype(np.int64)})


def _context(g):
    low = g.bitwiseAND(F.lit(MASK))
    return (g - low) + F.shiftright(low, 8)


def _suffix(order: int, g):
    """Without the first of ``order`` bytes."""
    return g.bitwiseAND(F.lit(~(0xFF << (8 * (order - 1)))))


def _lid(g):
    return F.shiftright(g, BITS)


def counts_by_order(highest: DataFrame) -> dict[int, DataFrame]:
    """Raw counts of the highest order, and continuation counts (distinct left extensions) below it."""
    out = {ORDER: highest}
    for order in range(ORDER, 1, -1):
        out[order - 1] = materialize(out[order].groupBy(_suffix(order, F.col("g")).alias("g")).agg(F.count("*").alias("c")), f"count{order - 1}")
    return out


def discounts(counts: DataFrame) -> DataFrame:
    """``lid, d1, d2, d3`` from the counts of counts; a row for each language."""
    n = counts.groupBy(_lid(F.col("g")).alias("lid")).agg(*(F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(k: int):
        usable = (F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0)
        value = F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        return F.when(usable, F.least(F.greatest(value, F.lit(0.05)), F.lit(k - 0.05))).otherwise(0.75 * k).alias(f"d{k}")

    return n.select("lid", d(1), d(2), d(3))


def probabilities(counts: dict[int, DataFrame], wanted: DataFrame) -> DataFrame:
    """``g, p`` for every n-gram of ``wanted`` (distinct ``g`` of the highest order)."""
    asked = {ORDER: wanted}
    for order in range(ORDER, 1, -1):
        asked[order - 1] = materialize(asked[order].select(_suffix(order, F.col("g")).alias("g")).distinct(), f"asked{order - 1}")
    below = asked[1].select(F.col("g").alias("s")).withColumn("q", F.lit(1.0 / 256)).withColumn("s", _lid(F.col("s"))).distinct()
    for order in range(1, ORDER + 1):
        own = counts[order]
        d = discounts(own)
        ctx = own.groupBy(_context(F.col("g")).alias("h")).agg(F.sum("c").cast("double").alias("total"), *(F.count_if(t).alias(n) for n, t in (("n1", F.col("c") == 1), ("n2", F.col("c") == 2), ("n3", F.col("c") >= 3))))
        ctx = ctx.withColumn("lid", _lid(F.col("h"))).join(d, "lid")
        ctx = ctx.select("h", "total", ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("gamma"), "d1", "d2", "d3")
        rows = asked[order].select("g", _context(F.col("g")).alias("h"), (_suffix(order, F.col("g")) if order > 1 else _lid(F.col("g"))).alias("s"))
        rows = rows.join(own, "g", "left").join(ctx, "h", "left").join(below, "s")
        cut = F.when(F.col("c") >= 3, F.col("d3")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d1"))
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise(F.greatest(F.coalesce("c", F.lit(0)) - cut, F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("q"))
        below = materialize(rows.select(F.col("g").alias("s"), p.alias("q")), f"prob{order}")
    return below.select(F.col("s").alias("g"), F.col("q").alias("p"))


def languages(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``lang, lid``: a number for each language of trusted documents. A row for each language."""
    held = docs.join(trusted.hint("merge"), "doc_id", "left_semi").select("lang").distinct()
    return materialize(held.select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).cast("int").alias("lid")), "languages")


def numbered(docs: DataFrame, langs: DataFrame) -> DataFrame:
    """Documents with the number of their language, null where there is none, and a key that only repeated rows share."""
    names = langs.withColumnRenamed("lang", "name")
    rows = docs.select("doc_id", "text", "lang").join(names, F.col("lang").eqNullSafe(F.col("name")), "left")
    return rows.select("doc_id", "text", "lang", "lid", F.xxhash64("doc_id", "text", "lang").alias("k"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def _score_pass(part):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, cost = part.value
        for rows in frames:
            total, size = [], []
            for chunk in _chunks(rows):
                keys, owner = gram_keys(list(chunk["text"]), chunk["lid"].fillna(UNKNOWN).to_numpy(np.int64))
                at = np.minimum(np.searchsorted(g, keys), max(0, len(g) - 1))
                value = np.where(g[at] == keys, cost[at], 0) if len(g) else np.zeros(len(keys))
                total.append(np.bincount(owner, value, minlength=len(chunk)))
                size.append(np.bincount(owner, minlength=len(chunk)))
            if len(rows):
                yield rows[["doc_id", "lang", "lid", "k"]].assign(cost=np.concatenate(total), size=np.concatenate(size).astype(np.int64))

    return run


def costs(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``doc_id, lang, lid, size, cost`` of every row: bytes and nats, by one slice of the model after the other."""
    spark = rows.sparkSession
    parts = -(-model.count() // SLICE) or 1
    passes = []
    for k in range(parts):
        part = model.where(F.pmod(F.xxhash64("g"), F.lit(parts)) == k).select("g", (-F.log("p")).cast("float").alias("cost")).toArrow()
        g = part["g"].to_numpy()
        order = np.argsort(g)
        sent = spark.sparkContext.broadcast((g[order], part["cost"].to_numpy()[order]))
        del part, g, order
        passes.append(materialize(rows.mapInPandas(_score_pass(sent), "doc_id long, lang string, lid int, k long, cost double, size long"), "costs"))
        sent.destroy()
    if parts == 1:
        return passes[0].select("doc_id", "lang", "lid", "size", "cost")
    key = ("doc_id", "lang", "lid", "k", "size")
    summed = reduce(DataFrame.unionByName, passes).groupBy(*key).agg((F.sum("cost") * parts / F.count("*")).alias("cost"), (F.count("*") / parts).cast("int").alias("copies"))
    out = materialize(summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "lang", "lid", "size", "cost"), "costs")
    discard(*passes)
    return out


def quantile(rows: DataFrame, value, share: float, name: str) -> DataFrame:
    """``lid, name``: the smallest step of the grid up to which ``share`` of each language's rows lie."""
    bins = rows.select("lid", F.ceil(value * GRID).alias("bin")).groupBy("lid", "bin").agg(F.count("*").alias("n"))
    below = Window.partitionBy("lid").orderBy("bin")
    reached = bins.select("lid", "bin", F.sum("n").over(below).alias("at"), F.sum("n").over(Window.partitionBy("lid")).alias("all"))
    return reached.where(F.col("at") >= share * F.col("all")).groupBy("lid").agg((F.min("bin") / GRID).alias(name))


def thresholds(scored: DataFrame, trusted: DataFrame) -> DataFrame:
    """``lid, middle, upper`` in nats a byte, from the trusted rows of ``scored``: those of the fold where it has any."""
    own = scored.where("lid is not null and size > 0").join(trusted.hint("merge"), "doc_id", "left_semi").withColumn("held", tested())
    own = own.join(own.groupBy("lid").agg(F.max("held").alias("any_held")), "lid").where("held or not any_held")
    own = materialize(own.select("lid", "size", "cost"), "trusted")
    middle = materialize(quantile(own, F.col("cost") / F.col("size"), 0.5, "middle"), "middle")
    return middle.join(quantile(own.join(middle, "lid"), smoothed(), UPPER, "upper"), "lid")


def smoothed():
    return (F.col("cost") + PRIOR * F.col("middle")) / (F.col("size") + PRIOR)


def tested():
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, n_bytes, perplexity, smoothed, threshold, kept`` of every row of ``docs``."""
    trusted = materialize(trusted_ids(labels), "trusted-ids")
    trained = trusted.where(~tested())
    rows = numbered(docs, languages(docs, trained))
    # a merge at every size, so that the plan does not change as the labels grow
    highest = rows.join(trained.hint("merge"), "doc_id", "left_semi").select("text", "lid").mapInPandas(_count, "g long, c long")
    counts = counts_by_order(materialize(highest.groupBy("g").agg(F.sum("c").alias("c")), f"count{ORDER}"))
    wanted = materialize(rows.where("lid is not null").select("text", "lid").mapInPandas(_count, "g long, c long").select("g").distinct(), "wanted")
    model = materialize(probabilities(counts, wanted), "model")
    discard(wanted, *counts.values())
    release(docs.sparkSession)
    scored = costs(rows, model)
    # a row for each language on the right
    out = scored.join(F.broadcast(materialize(thresholds(scored, trusted), "thresholds")), "lid", "left")
    perplexity = F.when((F.col("size") > 0) & F.col("upper").isNotNull(), F.exp(F.col("cost") / F.col("size")))
    judged = F.when(F.col("size") > 0, smoothed())
    return out.select("doc_id", "lang", F.col("size").alias("n_bytes"), perplexity.alias("perplexity"), F.exp(judged).alias("smoothed"), F.exp("upper").alias("threshold"), F.coalesce(judged <= F.col("upper"), F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    return without(docs, score(docs, labels), "kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
