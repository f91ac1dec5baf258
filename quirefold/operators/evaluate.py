"""Evaluation: noise, LCS accuracy, ratcheting baselines, deltas of experiments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

#: Misreadings, tried before any other substitution.
CONFUSIONS = (
    ("rn", "m"),
    ("m", "rn"),
    ("cl", "d"),
    ("d", "cl"),
    ("l", "1"),
    ("1", "l"),
    ("I", "l"),
    ("O", "0"),
    ("0", "O"),
    ("e", "c"),
    ("c", "e"),
    ("h", "b"),
    ("u", "v"),
    ("S", "5"),
    ("B", "8"),
)
#: What an ideograph may turn into.
IDEOGRAPHS = "的一是不了人在有我他这中大来上国和生到子们地出道也时年得就那要下以"
LETTER = r"[\p{L}\p{Nd}]"
IDEOGRAPH = "[一-鿿぀-ヿ가-힯]"
TOLERANCE = 0.05


def _places(word: Column, holds) -> Column:
    """The places of ``word``, from 1, that ``holds`` is true of."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), holds)


def _rewrites(word: Column) -> Column:
    """The word after each misreading that it allows, in the order of rules and places."""

    def by(old: str, new: str) -> Column:
        at = _places(word, lambda i: F.substr(word, i, F.lit(len(old))) == old)
        return F.transform(at, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.lit(new), F.substr(word, i + len(old))))

    return F.concat(*(by(old, new) for old, new in CONFUSIONS))


def _nth(items: Column, draw: Column) -> Column:
    return F.get(items, F.pmod(draw, F.size(items)).cast("int"))


def corrupt(word: Column, draw: Column) -> Column:
    """The word with one misreading, or else with one letter or digit replaced by another of its class, as ``draw`` says."""
    pool = lambda text, c: F.filter(F.array(*map(F.lit, text)), lambda x: x != c)
    lower = "abcdefghijklmnopqrstuvwxyz"

    def other(c: Column) -> Column:
        digit, upper = F.regexp_like(c, F.lit(r"^\p{Nd}")), F.regexp_like(c, F.lit(r"^\p{Lu}"))
        return F.when(F.regexp_like(c, F.lit(IDEOGRAPH)), _nth(pool(IDEOGRAPHS, c), draw)).when(digit, _nth(pool("0123456789", c), draw)).when(upper, _nth(pool(lower.upper(), c), draw)).otherwise(_nth(pool(lower, c), draw))

    spots = _places(word, lambda i: F.regexp_like(F.substr(word, i, F.lit(1)), F.lit(LETTER)))
    at = _nth(spots, draw)
    swapped = F.concat(F.substr(word, F.lit(1), at - 1), other(F.substr(word, at, F.lit(1))), F.substr(word, at + 1))
    found = _rewrites(word)
    return F.when(F.size(found) > 0, _nth(found, draw)).when(F.size(spots) > 0, swapped).otherwise(word)


def inject_noise(words: DataFrame, rate: float, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """Misread a share of each page's words that hold a letter or digit; ``words(page_id, pos, word)``.

    ``draw`` chooses the words (the smallest draws first) and their misreadings; a seeded hash, if it is not given.
    """
    drawn = words.withColumn("draw", F.xxhash64(F.lit(seed), "page_id", "pos") if draw is None else draw).withColumn("able", F.regexp_like(F.col("word"), F.lit(LETTER)))
    rank = F.row_number().over(Window.partitionBy("page_id", "able").orderBy("draw", "pos"))
    n = F.count_if("able").over(Window.partitionBy("page_id"))
    hit = drawn.withColumn("hit", F.col("able") & (rank <= F.round(n * rate)))
    return hit.withColumn("word", F.when(F.col("hit"), corrupt(F.col("word"), F.col("draw"))).otherwise(F.col("word"))).drop("draw", "able", "hit")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[str, int] = {}
    for k, unit in enumerate(a):
        places[unit] = places.get(unit, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for unit in b:
        met = row & places.get(unit, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)])


def accuracy(pages: DataFrame) -> DataFrame:
    """``page_id, accuracy``: percent of canonical units found in order; from ``page_id, canonical, sorted``."""
    units = pages.select("page_id", T.score_units(F.col("canonical")).alias("c"), T.score_units(F.col("sorted")).alias("s"))
    score = F.when(F.size("c") == 0, F.when(F.size("s") == 0, 100.0).otherwise(0.0)).otherwise(100.0 * F.pandas_udf(_lcs, "int")("c", "s") / F.size("c"))
    return units.select("page_id", score.alias("accuracy"))


def ratchet(runs: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """``key, baseline, failed``: baselines only rise; a run fails below its baseline by more than the tolerance."""
    old, new = baselines.select(key, F.col("accuracy").alias("old")), runs.select(key, F.col("accuracy").alias("new"))
    joined = old.join(new, key, "full")
    raised = F.greatest(F.coalesce("old", F.lit(0.0)), F.coalesce(F.floor(F.col("new") * 100) / 100, F.lit(0.0)))
    return joined.select(key, raised.alias("baseline"), F.coalesce(F.col("new") < F.col("old") - TOLERANCE, F.lit(False)).alias("failed"))


def experiment_deltas(results: DataFrame, base: str) -> DataFrame:
    """``variant, mean_delta, n`` against the variant ``base``; ``results(variant, case, accuracy)``."""
    b = results.where(F.col("variant") == base).select("case", F.col("accuracy").alias("base_accuracy"))
    out = results.where(F.col("variant") != base).join(b, "case")
    return out.groupBy("variant").agg(F.avg(F.col("accuracy") - F.col("base_accuracy")).alias("mean_delta"), F.count("*").alias("n"))
