"""Substring deduplication by level-wise doubling.

Level by level, only windows that repeat between different texts are extended to twice their length. The first level
has windows of ``ceil(width / 2)`` words. A window of ``width`` words is the union of two of them that overlap, so it
can only repeat if they do; of the first-level windows inside it, the one with the smallest hash stands for all, and
equal windows choose the same one. Thus about a quarter of the first-level windows is counted and no repeat is missed.
The windows of ``width`` words around a repeated one are counted next. What is removed depends on no longer window, so
``substring_dedup`` stops there; ``spans`` goes on doubling until no candidate survives, to report the longest passages.

Equal texts are one class with the smallest doc_id of its rows, so copies are compared once. Only thin rows (hash, text
hash, position) are shuffled at the first level; texts move once, to be kept for those that have candidates. A task
settles what it can see itself, at both levels: a window that it finds in two texts repeats for certain, and goes on as
two rows that tell the other tasks. So the rows of a window that a third of all texts hold are as many as the tasks.

A text's identity is 64 bits of xxHash, unless another text with a different second hash has the same: those are found
and renamed. A final window's identity has 128 bits. Defined cases: null and empty texts have no words; texts shorter
than a window lose nothing; rows with the same doc_id don't remove from one another; a null doc_id counts as larger
than all others; repeated rows get the same result; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm import shingles
from quirefold.llm.common import discard, materialize
from quirefold.shared import release
from quirefold.tables import table

WIDTH = 13
LAST = (1 << 63) - 1
LEVEL = "w1 long, w2 long, did long, rid long, pos int, sure boolean"
#: Rows that a task looks through for repeats at once.
HELD = 1_000_000
#: Texts that share 64 bits of their hashes with another.
MOST_RENAMED = 100_000


def half(width: int) -> int:
    return -(-width // 2)


def chosen(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First-level window hashes, and for each window of ``width`` words the position of its smallest one."""
    first = shingles.windows(hashes, half(width))
    n = len(hashes) - width + 1
    if n <= 0:
        return first, np.zeros(0, np.int64)
    inside = np.lib.stride_tricks.sliding_window_view(first, width - half(width) + 1)
    return first, np.arange(n) + inside.argmin(axis=1)


def rows_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def renamed(rows: DataFrame) -> DataFrame | None:
    """``k, k2, own``: new names of texts that share ``k`` with another; about one for 2**65 pairs of texts."""
    shared = rows.groupBy("k").agg(F.min("k2").alias("lo"), F.max("k2").alias("hi")).where("lo < hi").select("k", "lo")
    moved = rows.join(shared, "k").where("k2 <> lo").select("k", "k2").distinct().limit(MOST_RENAMED + 1).collect()
    if len(moved) > MOST_RENAMED:
        raise RuntimeError("more texts share 64 bits of their hashes than can be")
    own = lambda r: int(shingles.mix(np.array([r["k"] ^ r["k2"]], np.int64).view(np.uint64)).view(np.int64)[0])
    return rows.sparkSession.createDataFrame([(r["k"], r["k2"], own(r)) for r in moved], "k long, k2 long, own long") if moved else None


def named(rows: DataFrame, moved: DataFrame | None) -> DataFrame:
    if moved is None:
        return rows.drop("k2")
    return rows.join(F.broadcast(moved), ["k", "k2"], "left").withColumn("k", F.coalesce("own", "k")).drop("k2", "own")


def _hash(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        split = [shingles.split(t, lower=False) for t in rows["text"]]
        yield rows[["doc_id", "did", "k", "k2"]].assign(n_words=[len(w) for w in split], whole=[_hash(w) for w in split])


def _extremes(order: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest value of each group of sorted rows."""
    ordered = values[order]
    return np.minimum.reduceat(ordered, starts), np.maximum.reduceat(ordered, starts)


def _first_level(width: int):
    """Rows ``h, k, pos, sure``: windows to be counted, positions (-1 says only that the window is there), and windows that
    repeat for certain, under names of their own that nothing waits for."""

    def settled(out: list[tuple[np.ndarray, int, np.ndarray]]) -> pd.DataFrame:
        h = np.concatenate([o[0] for o in out])
        k = np.repeat(np.array([o[1] for o in out], np.int64), [len(o[0]) for o in out])
        pos = np.concatenate([o[2] for o in out])
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        lo, hi = _extremes(order, starts, k)
        twice = lo < hi
        sure = np.zeros(len(h), bool)
        sure[order] = np.repeat(twice, np.diff(np.append(starts, len(h))))
        own = np.where(sure, shingles.mix(h.view(np.uint64) ^ shingles.mix(k.view(np.uint64))).view(np.int64), h)
        tell = h[order[starts[twice]]]
        none = np.full(len(tell), -1, np.int32)
        return pd.DataFrame({"h": np.concatenate((own, tell, tell)), "k": np.concatenate((k, lo[twice], hi[twice])), "pos": np.concatenate((pos, none, none)), "sure": np.concatenate((sure, np.zeros(2 * len(tell), bool)))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        held = 0
        for rows in frames:
            for k, h in zip(rows["k"].tolist(), shingles.hash_texts(rows["text"], lower=False)):
                if k in seen:
                    continue
                seen.add(k)
                first, at = chosen(h, width)
                at = np.unique(at)
                if len(at):
                    out.append((first[at].view(np.int64), k, at.astype(np.int32)))
                    held += len(at)
                    if held >= HELD:
                        yield settled(out)
                        out, held = [], 0
        if out:
            yield settled(out)

    return run


def _candidates(width: int):
    """Rows of ``LEVEL``: the windows around repeated ones. A window that the task finds in a smaller document is ``sure``."""

    def settled(out: list[tuple]) -> pd.DataFrame:
        w1, w2, pos = (np.concatenate([o[j] for o in out]) for j in (0, 1, 4))
        lengths = [len(o[0]) for o in out]
        did, rid = (np.repeat(np.array([o[j] for o in out], np.int64), lengths) for j in (2, 3))
        order = np.lexsort((w2, w1))
        a, b = w1[order], w2[order]
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        lo, _ = _extremes(order, starts, did)
        least = np.empty(len(w1), np.int64)
        least[order] = np.repeat(lo, np.diff(np.append(starts, len(w1))))
        sure = did > least
        own = np.where(sure, shingles.mix(w1.view(np.uint64) ^ shingles.mix(rid.view(np.uint64))).view(np.int64), w1)
        return pd.DataFrame({"w1": own, "w2": w2, "did": did, "rid": rid, "pos": pos, "sure": sure})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        out: list[tuple] = []
        held = 0
        for rows in frames:
            hashed = shingles.hash_texts((unpack.decompress(p).decode() for p in rows["packed"]), lower=False)
            for rid, did, h, places in zip(rows["rid"], rows["did"], hashed, rows["places"]):
                _, at = chosen(h, width)
                hit = np.flatnonzero(np.isin(at, places))
                if len(hit):
                    out.append((shingles.windows(h, width)[hit].view(np.int64), shingles.windows(h, width, salt=1)[hit].view(np.int64), did, rid, hit.astype(np.int32)))
                    held += len(hit)
                    if held >= HELD:
                        yield settled(out)
                        out, held = [], 0
        if out:
            yield settled(out)

    return run


def _windows(width: int):
    """The windows around repeated ones, by text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for rows in frames:
            hashed = shingles.hash_texts((unpack.decompress(p).decode() for p in rows["packed"]), lower=False)
            for rid, did, h, places in zip(rows["rid"], rows["did"], hashed, rows["places"]):
                hit = np.flatnonzero(np.isin(chosen(h, width)[1], places))
                yield pd.DataFrame({"w1": shingles.windows(h, width)[hit].view(np.int64), "w2": shingles.windows(h, width, salt=1)[hit].view(np.int64), "did": np.full(len(hit), did), "rid": np.full(len(hit), rid), "pos": hit.astype(np.int32)})

    return run


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=1)
    for rows in frames:
        yield rows[["k", "did", "places"]].assign(packed=[pack.compress(t.encode()) for t in rows["text"]])


def _cut(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for rows in frames:
            n_removed, kept = [], []
            for packed, starts in zip(rows["packed"], rows["starts"]):
                words = shingles.split(unpack.decompress(packed).decode(), lower=False)
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, starts, 1)
                np.add.at(depth, np.asarray(starts) + width, -1)
                covered = np.cumsum(depth)[:-1] > 0
                n_removed.append(int(covered.sum()))
                kept.append(_hash([w for w, c in zip(words, covered) if not c]))
            yield pd.DataFrame({"k": rows["k"], "n_removed": n_removed, "kept": kept})

    return run


class Repeats:
    """The repeated windows of ``docs``: ``rows`` (all rows), ``texts`` (those with candidates) and ``marks``."""

    def __init__(self, docs: DataFrame, width: int = WIDTH):
        self.width = width
        base = rows_of(docs)
        rows = materialize(base.mapInPandas(_whole, "doc_id long, did long, k long, k2 long, n_words long, whole string"), "rows")
        moved = renamed(rows)
        base, self.rows = named(base, moved), named(rows, moved)
        self.classes = self.rows.groupBy("k").agg(F.min("did").alias("first_id"))
        thin = base.select("k", "text").mapInPandas(_first_level(width), "h long, k long, pos int, sure boolean")
        same = Window.partitionBy("h")
        repeated = thin.withColumns({"lo": F.min("k").over(same), "hi": F.max("k").over(same)}).where("(sure or lo < hi) and pos >= 0")
        places = repeated.groupBy("k").agg(F.collect_set("pos").alias("places"))
        places = materialize(places.join(self.classes, "k").withColumnRenamed("first_id", "did"), "places")
        release(docs.sparkSession)
        texts = base.select("k", "did", "text").join(places.hint("merge"), ["k", "did"]).select("k", "did", "places", "text")
        self.texts = materialize(texts.mapInPandas(_pack, "k long, did long, places array<int>, packed binary").dropDuplicates(["k"]).withColumn("rid", F.monotonically_increasing_id()), "texts")
        discard(places)
        release(docs.sparkSession)
        level = self.texts.mapInPandas(_candidates(width), LEVEL).withColumn("lo", F.min("did").over(Window.partitionBy("w1", "w2")))
        self.marks = materialize(level.where("sure or did > lo").groupBy("rid").agg(F.collect_list("pos").alias("starts")), "marks")
        release(docs.sparkSession)


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs``."""
    found = Repeats(docs, width)
    cut = found.texts.select("k", "rid", "packed").join(found.marks, "rid").mapInPandas(_cut(width), "k long, n_removed long, kept string")
    out = found.rows.join(found.classes.join(cut, "k", "left"), "k")
    copy = (F.col("did") > F.col("first_id")) & (F.col("n_words") >= width)
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )


def spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The longest levels of repeated passages: ``doc_id, start, length`` by doubling ``width`` until none repeats.

    Two windows of one length that both repeat and lie end to end are the candidates of twice that length.
    """
    found = Repeats(docs, width)
    unpack = found.texts.mapInPandas(_windows(width), "w1 long, w2 long, did long, rid long, pos int")
    twice = unpack.groupBy("w1", "w2").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo < hi").select("w1", "w2")
    level, length, out = materialize(unpack.join(twice, ["w1", "w2"]), "level"), width, []
    while not level.isEmpty():
        out.append(level.select("did", F.col("pos").alias("start"), F.lit(length).alias("length")))
        right = level.select(F.col("w1").alias("r1"), F.col("w2").alias("r2"), "rid", (F.col("pos") - length).alias("pos"))
        pairs = level.join(right, ["rid", "pos"]).select(F.xxhash64("w1", "w2", "r1", "r2").alias("w1"), F.xxhash64("r2", "w1", "r1", "w2").alias("w2"), "did", "rid", "pos")
        twice = pairs.groupBy("w1", "w2").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo < hi").select("w1", "w2")
        level, length = materialize(pairs.join(twice, ["w1", "w2"]), "level"), 2 * length
    if not out:
        return found.rows.limit(0).select(F.col("did").alias("doc_id"), F.lit(0).alias("start"), F.lit(0).alias("length"))
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union.groupBy("did", "start").agg(F.max("length").alias("length")).withColumnRenamed("did", "doc_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
lo AS (SELECT t, min(doc_id) AS lo FROM win GROUP BY t),
hit AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM win JOIN lo USING (t) WHERE doc_id > lo)),
cov AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string([x[1] FOR x IN list_zip(w, range(1, len(w) + 1)) IF ps IS NULL OR NOT list_contains(ps, x[2])], ' ')) AS kept_sha256
FROM d LEFT JOIN cov USING (doc_id)
"""
