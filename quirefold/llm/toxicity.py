"""Toxicity: a character n-gram linear classifier with naive-Bayes scaled features.

A document's features are the distinct character n-grams of its whole lower-cased text, hashed into a fixed number of
slots and binarised. Each feature is scaled by the naive-Bayes log-count ratio of the two classes, and a logistic model
with L2 penalty is fitted over the scaled features. Fitting uses a bounded sample of labelled rows (``sample``, taken by
a hash of the id); scoring covers every row and whole texts, in one pass without a shuffle. The model is two arrays of
``SLOTS`` entries at most, so what is broadcast has a fixed bound.

Defined cases: a null text counts as empty; an empty text scores the model's intercept; rows without a label, or with a
null label, are scored and never learned from; with only one class among the labelled rows every score is
close to that class (0 without any labelled row); repeated rows get the same score; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import materialize
from quirefold.tables import table

GRAMS, SLOT_BITS = (4, 5, 6), 20
SLOTS = 1 << SLOT_BITS
#: Labelled rows that the model is fitted on at most.
SAMPLE = 8_000
#: A feature takes part if it occurs in so many sampled documents, with at least this absolute log-count ratio.
MIN_DOCS, MIN_RATIO = 4, 1.5
FOLDS = 5


def gram_slots(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: the position's text number, and its slot, over all positions of all texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    with np.errstate(over="ignore"):
        spread = (codes + np.uint32(1)) * np.uint32(0x9E3779B1)
        spread ^= spread >> np.uint32(15)
        for n in GRAMS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + spread[k : len(codes) - n + 1 + k]
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x85EBCA6B)
            whole = owner[: len(h)] == owner[n - 1 :]
            yield owner[: len(h)][whole], (h >> np.uint32(32 - SLOT_BITS))[whole]


def features(text: str | None) -> np.ndarray:
    """The distinct slots of one whole text."""
    slots = [s for _, s in gram_slots([f" {(text or '').lower()} "])]
    return np.unique(np.concatenate(slots)).astype(np.int32) if slots else np.zeros(0, np.int32)


@dataclass
class Model:
    weight: np.ndarray
    intercept: float

    def score(self, texts: list[str | None], slice_chars: int = 2_000_000) -> np.ndarray:
        out, part, chars, at = np.full(len(texts), self.intercept), [], 0, 0
        for k, text in enumerate(texts):
            part.append(f" {(text or '').lower()} ")
            chars += len(part[-1])
            if chars >= slice_chars or k == len(texts) - 1:
                seen = []
                for owner, slots in gram_slots(part):
                    hit = np.flatnonzero(self.weight[slots])
                    seen.append(owner[hit].astype(np.int64) << SLOT_BITS | slots[hit])
                pairs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
                out[at : at + len(part)] += np.bincount(pairs >> SLOT_BITS, self.weight[pairs & (SLOTS - 1)], minlength=len(part))
                at, part, chars = at + len(part), [], 0
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def ratios(in_toxic: np.ndarray, in_all: np.ndarray, toxic: int, total: int) -> np.ndarray:
    """Naive-Bayes log-count ratio of each feature with add-one smoothing; 0 for features that take no part."""
    ratio = np.log((in_toxic + 1) / (toxic + 2)) - np.log((in_all - in_toxic + 1) / (total - toxic + 2))
    return np.where((in_all < MIN_DOCS) | (np.abs(ratio) < MIN_RATIO), 0.0, ratio)


def fit(rows: list[np.ndarray], toxic: np.ndarray, names: np.ndarray, scale: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> Model:
    """Logistic regression over binarised features; ``names`` are the slots that take part, ``scale`` their ratios."""
    toxic = toxic.astype(float)
    weight, positive = np.zeros(SLOTS, np.float32), toxic.sum()
    if positive in (0, len(toxic)):
        return Model(weight, 30.0 if positive else -30.0)
    b = float(np.log(positive / (len(toxic) - positive)))
    owner, slot = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    col = np.searchsorted(names, slot)
    w = np.full(len(names), 0.01)
    m = [np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0]
    for step in range(1, steps + 1):
        z = b + np.bincount(owner, (w * scale)[col], minlength=len(toxic))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / len(toxic)
        grad, db = np.bincount(col, err[owner], minlength=len(names)) * scale + penalty * w, err.sum()
        m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.99 * m[1] + 0.01 * grad**2
        m[2], m[3] = 0.9 * m[2] + 0.1 * db, 0.99 * m[3] + 0.01 * db**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.05 * (m[0] / fix) / (np.sqrt(m[1] / fix2) + 1e-9)
        b -= 0.05 * (m[2] / fix) / (np.sqrt(m[3] / fix2) + 1e-9)
    weight[names] = w * scale
    return Model(weight, float(b))


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    # ``chosen`` has at most ``sample`` rows of two numbers
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, SLOTS), np.int64)
        for part in frames:
            for text, toxic in zip(part["text"], part["toxic"]):
                own = features(text)
                seen[1, own] += 1
                if toxic:
                    seen[0, own] += 1
        slots = np.flatnonzero(seen[1])
        yield pd.DataFrame({"slot": slots, "in_toxic": seen[0, slots], "in_all": seen[1, slots]})

    # at most SLOTS rows
    slots = rows.mapInPandas(count, "slot int, in_toxic long, in_all long").groupBy("slot").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_all").alias("in_all")).where(F.col("in_all") >= MIN_DOCS).toPandas().sort_values("slot")
    totals = rows.agg(F.count("*").alias("total"), F.coalesce(F.sum((F.col("toxic") != 0).cast("long")), F.lit(0)).alias("toxic")).first()
    scale = ratios(slots["in_toxic"].to_numpy(float), slots["in_all"].to_numpy(float), totals["toxic"], totals["total"])
    names, scale = slots["slot"].to_numpy()[scale != 0], scale[scale != 0]
    sent = docs.sparkSession.sparkContext.broadcast(names)

    def select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        takes_part = np.zeros(SLOTS, bool)
        takes_part[sent.value] = True
        for part in frames:
            own = (features(t) for t in part["text"])
            yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"] != 0, "slots": [f[takes_part[f]].tobytes() for f in own]})

    got = rows.mapInPandas(select, "doc_id long, toxic boolean, slots binary").toPandas().sort_values(["doc_id", "slots"])
    return fit([np.frombuffer(s, np.int32) for s in got["slots"]], got["toxic"].to_numpy(), names, scale)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weight).astype(np.int32), model.weight[model.weight != 0], model.intercept))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, values, intercept = sent.value
        weight = np.zeros(SLOTS, np.float32)
        weight[at] = values
        own = Model(weight, intercept)
        for rows in frames:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": own.score(list(rows["text"]))})

    scored = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
