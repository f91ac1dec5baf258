"""Exact deduplication: static binary-fuse filters per immutable snapshot, exact buckets for what they let through.

A *snapshot* is immutable: one row per distinct digest (``digest, keep_id, n``), dealt into buckets by digest, with one
binary-fuse filter per bucket. An incoming batch is first grouped by digest on its own (new-batch duplicates never
reach the snapshot twice), then each distinct digest is screened by the filter of its bucket. Negatives are new for
certain; positives join the exact bucket, and the texts of everything that looks equal are compared byte for byte.

Ids and counts travel with digests. Texts move once, for the byte check, after a map-side combine: a group of copies of
any size shuffles one text per task.

Defined cases: a null text counts as empty; empty texts equal one another; a repeated doc_id is a row like any other;
an empty batch or snapshot gives no rows from its side; further columns are ignored. Two different texts with one
SHA-256 digest stop the job with an error instead of being merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import materialize, without
from quirefold.tables import table

#: Digests that one filter is meant to hold; the number of buckets follows from it.
KEYS_PER_FILTER = 200_000


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over keys, varied by seed."""
    with np.errstate(over="ignore"):
        h = keys ^ np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class FuseFilter:
    """A static 3-wise binary-fuse filter with 16-bit fingerprints: no false negatives, about 2**-16 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        start = (((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)
        mask = np.uint64(segment - 1)
        first = start * segment
        return np.stack([first + (h & mask).astype(np.int64), first + segment + ((h >> np.uint64(11)) & mask).astype(np.int64), first + 2 * segment + ((h >> np.uint64(22)) & mask).astype(np.int64)])

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel in waves: all slots with one key left are freed at once, and assigned in reverse order of waves."""
        keys = np.unique(keys.astype(np.uint64))
        n = max(1, len(keys))
        segment = 1 << int(np.clip(np.floor(np.log(n) / np.log(3.33) + 2.25), 2, 11))
        for attempt in range(100):
            factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) * (1.05 + 0.02 * attempt)
            segments = max(1, int(np.ceil(n * factor / segment)) - 2)
            seed = int(_mix(np.array([attempt + 1], np.uint64), 0x5EED)[0])
            h = _mix(keys, seed)
            at, size = cls._slots(h, segment, segments), (segments + 2) * segment
            count = np.bincount(at.ravel(), minlength=size)
            ids = np.zeros(size, np.int64)
            for row in at:
                np.bitwise_xor.at(ids, row, np.arange(len(keys)))
            waves, left = [], len(keys)
            alone = np.flatnonzero(count == 1)
            while len(alone):
                key, pick = np.unique(ids[alone], return_index=True)
                slot = alone[pick]
                waves.append((key, slot))
                left -= len(key)
                for row in at[:, key]:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(ids, row, key)
                near = np.unique(at[:, key])
                alone = near[count[near] == 1]
            if left == 0:
                out, prints = np.zeros(size, np.uint16), cls._prints(h)
                for key, slot in reversed(waves):
                    a, b, c = (out[at[j, key]] for j in range(3))
                    out[slot] = 0
                    own = [np.where(at[j, key] == slot, 0, v) for j, v in enumerate((a, b, c))]
                    out[slot] = prints[key] ^ own[0] ^ own[1] ^ own[2]
                return cls(seed, segment, segments, out)
        raise RuntimeError("no seed peels these keys")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64), self.seed)
        a, b, c = (self.table[row] for row in self._slots(h, self.segment, self.segments))
        return self._prints(h) == a ^ b ^ c


def _buckets(n: int) -> int:
    return max(1, -(-n // KEYS_PER_FILTER))


def _key64(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)


def _bucket(buckets: int):
    """By bytes of the digest that the filter's key does not use."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest`` of every row: SHA-256 over the text's UTF-8 bytes."""
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))


def grouped(digested: DataFrame) -> DataFrame:
    """Duplicates within one batch: one row per digest with the largest id and the number of rows, combined map-side."""
    return digested.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))


class Snapshot:
    """An immutable snapshot: exact buckets (``digest, keep_id, n, bucket``) and one filter row per bucket."""

    def __init__(self, exact: DataFrame, filters: DataFrame, buckets: int):
        self.exact, self.filters, self.buckets = exact, filters, buckets

    @classmethod
    def build(cls, groups: DataFrame) -> Snapshot:
        exact = materialize(groups, "snapshot")
        buckets = _buckets(exact.count())
        exact = exact.withColumn("bucket", _bucket(buckets))

        def fuse(rows: pd.DataFrame) -> pd.DataFrame:
            f = FuseFilter.build(_key64(rows["digest"]))
            return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "seed": [str(f.seed)], "segment": [f.segment], "segments": [f.segments], "slots": [f.table.tobytes()]})

        filters = exact.select("bucket", "digest").groupBy("bucket").applyInPandas(fuse, "bucket int, seed string, segment int, segments int, slots binary")
        return cls(exact, materialize(filters, "filters"), buckets)

    def screen(self, groups: DataFrame) -> DataFrame:
        """``groups`` with ``hit``: False is new for certain. A bucket holds distinct digests, so its size is even."""

        def probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if len(rows) and len(filters):
                f = filters.iloc[0]
                hit = FuseFilter(int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["slots"], np.uint16)).contains(_key64(rows["digest"]))
            else:
                hit = np.zeros(len(rows), bool)
            return rows[["digest", "keep_id", "n"]].assign(hit=hit)

        dealt = groups.withColumn("bucket", _bucket(self.buckets))
        return dealt.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(probe, "digest binary, keep_id long, n long, hit boolean")


def byte_check(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """Compare the texts of all rows whose digest is in ``suspects``: ``digest, equal``; stops on a collision."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest")).groupBy("digest", "text").agg(F.count("*").alias("n"))
    # an inner join stays above the aggregation, so that one plan holds at every size
    seen = texts.groupBy("digest").agg(F.count("*").alias("texts")).join(suspects.select("digest"), "digest")
    return seen.select("digest", F.when(F.col("texts") == 1, True).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("boolean")).alias("equal"))


def dedup_batch(snapshot: Snapshot, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups over snapshot and batch (``digest, keep_id, n``), and those of them whose texts must be compared."""
    new = materialize(snapshot.screen(grouped(batch)), "screened")
    exact = snapshot.exact.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
    met = new.where("hit").join(exact, "digest", "left")
    joined = met.select("digest", F.greatest("keep_id", "old_id").alias("keep_id"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), F.col("old_id").isNotNull().alias("old"))
    joined = materialize(joined, "joined")
    fresh = new.where("not hit").select("digest", "keep_id", "n")
    kept = exact.join(joined.where("old").select("digest"), "digest", "left_anti").select("digest", F.col("old_id").alias("keep_id"), F.col("old_n").alias("n"))
    groups = fresh.unionByName(joined.select("digest", "keep_id", "n")).unionByName(kept)
    return groups, groups.where("n > 1")


def exact_dedup(docs: DataFrame, arrived=None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    ``arrived`` is a boolean Column that says which rows are the incoming batch; the others are the snapshot. By
    default ids are dealt into the two by hash. The result does not depend on it: all rows are grouped with all.
    """
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if arrived is None else arrived
    rows = materialize(digests(docs).withColumn("batch", F.coalesce(batch, F.lit(True))), "digests")
    snapshot = Snapshot.build(grouped(rows.where("not batch")))
    groups, suspects = dedup_batch(snapshot, rows.where("batch"))
    groups = materialize(groups, "groups")
    checked = byte_check(docs, materialize(groups.where("n > 1").select("digest"), "suspects"))
    groups = groups.join(checked, "digest", "left").where("n = 1 or equal")
    out = rows.select("doc_id", "digest").join(groups.select("digest", "keep_id", "n"), "digest")
    return out.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without exact copies: of equal texts the one with the largest doc_id stays."""
    return without(docs, exact_dedup(docs), "kept")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
