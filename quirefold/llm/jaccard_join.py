"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Documents with equal sets are one class from the start. A *small* set (up to a boundary) is enumerated: with
``|a n b| >= 3/4 max(|a|, |b|)`` two small sets share a subset whose size depends on the larger one alone, so each set
emits its subsets of those fixed sizes. A *large* set is found by scanning inverted lists: its rarest shingles, as many
as a partner must share one of, are posted, and so are those of the small sets that a large one can reach. The boundary
is the one of least cost, from the histogram of set sizes.

"Rarest" means: shingles that repeat within a partition's distinct sets are counted, the counts are added up, and the
heaviest ``HEAVY`` of them go last; the order decides how long the lists are, never what is found.

No list is paired with itself. Each set is compared with one hub of its lists first, the set that is in most lists; then
with the hub of the largest component of its lists; in the end only pairs of a list that are in different components
after that, and that pass the filters on sizes, positions and distances to a common hub, are compared. Joins are merges at
every size, so that the plan does not change as the input grows. Every comparison is on all shingles of whole texts, by 64-bit hashes within the pair. What is returned is the component of each document:
links inside a component need not be listed.

A set goes by 64 bits of its digest; sets of different 128-bit digests that share them are found and renamed. The texts
that are compared lie in buckets of that id, so that only pairs move.

Defined cases: null and empty texts have no shingles, no links, and are their own component; fewer than five words are
one shingle; equal sets link; a null doc_id is its own component; repeated rows give equal rows; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm import shingles
from quirefold.llm.common import components, discard, materialize, without
from quirefold.shared import bucketed, drop, release
from quirefold.tables import table

WIDTH = 5
#: Similarity 75/100.
NUM, DEN = 75, 100
#: Heaviest shingles that are known to all tasks: at most 12 bytes each.
HEAVY, HEAVY_HERE = 1 << 20, 2
#: A posted shingle may have to be compared; an enumerated subset rarely has.
LIST_COST, LARGEST_SMALL = 8, 16
#: Hubs of another component that a set is compared with.
STARS = 4
#: Sets that share 64 bits of their digests with another.
MOST_RENAMED = 100_000


def least_overlap(n: int) -> int:
    """What a set of size n shares at least with any linked set that is not larger."""
    return -(-NUM * n // DEN)


def posted(n: int) -> int:
    """How many of its first shingles a set must post."""
    return n - least_overlap(n) + 1


def subset_sizes(n: int) -> list[int]:
    """Sizes of the subsets that a small set shares with partners of its size or larger."""
    return sorted({least_overlap(m) for m in range(n, DEN * n // NUM + 1)} & set(range(1, n + 1)))


def boundary(sizes: Counter) -> int:
    """The largest size that is enumerated: the one of least total cost."""

    def cost(b: int) -> int:
        light = sum(c * sum(comb(n, k) for k in subset_sizes(n)) for n, c in sizes.items() if n <= b)
        return light + sum(c * posted(n) * LIST_COST for n, c in sizes.items() if DEN * n >= NUM * (b + 1))

    return min(range(LARGEST_SMALL + 1), key=lambda b: (cost(b), b))


def set_id(s: np.ndarray) -> int:
    return int(np.frombuffer(blake2b(s.tobytes(), digest_size=8).digest(), np.int64)[0])


def set_ids(s: np.ndarray) -> tuple[int, int]:
    """A digest of 128 bits; its first half is the set's id unless another set has the same."""
    first, second = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(first), int(second)


def named(s: np.ndarray, moved: dict[tuple[int, int], int]) -> int:
    own = set_ids(s)
    return moved.get(own, own[0])


def renamed(sets: DataFrame) -> dict[tuple[int, int], int]:
    """New ids of sets that share their id with another: about one for 2**65 pairs of sets, so they fit the driver."""
    shared = sets.where("n > 0").groupBy("sid").agg(F.min("sid2").alias("lo"), F.max("sid2").alias("hi")).where("lo < hi").select("sid", "lo")
    rows = sets.join(shared, "sid").where("sid2 <> lo").select("sid", "sid2").distinct().limit(MOST_RENAMED + 1).collect()
    if len(rows) > MOST_RENAMED:
        raise RuntimeError("more sets share 64 bits of their digests than can be")
    return {(r["sid"], r["sid2"]): int(shingles.mix(np.array([r["sid"] ^ r["sid2"]], np.int64).view(np.uint64)).view(np.int64)[0]) for r in rows}


def _first_pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sizes and ids of the sets, then the shingles that repeat among the distinct sets of this partition."""
    seen: set[tuple[int, int]] = set()
    parts: list[np.ndarray] = []
    many = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merged() -> tuple[np.ndarray, np.ndarray]:
        values, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        parts.clear()
        keep = counts >= HEAVY_HERE
        values, at = np.unique(np.concatenate((many[0], values[keep])), return_inverse=True)
        return values, np.bincount(at, np.concatenate((many[1], counts[keep])), minlength=len(values)).astype(np.int64)

    held = 0
    for rows in frames:
        n, ids = [], []
        for s in shingles.shingle_sets(rows["text"], WIDTH):
            n.append(len(s))
            ids.append(i := set_ids(s))
            if len(s) and i not in seen:
                seen.add(i)
                parts.append(s)
                held += len(s)
                if held >= 1_000_000:
                    many, held = merged(), 0
        yield pd.DataFrame({"doc_id": rows["doc_id"], "n": n, "sid": [i[0] for i in ids], "sid2": [i[1] for i in ids], "heavy": pd.Series([None] * len(n), dtype="Int64"), "weight": pd.Series([None] * len(n), dtype="Int64")})
    many = merged()
    none = pd.Series([None] * len(many[0]), dtype="Int64")
    yield pd.DataFrame({"doc_id": none, "n": none, "sid": none, "sid2": none, "heavy": many[0].view(np.int64), "weight": many[1]})


def _posting_pass(heavy, small: int, moved: dict[tuple[int, int], int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, weights = heavy.value
        seen: set[int] = set()
        for rows in frames:
            out: list[tuple[np.ndarray, int, int, np.ndarray]] = []
            total = 0
            for s in shingles.shingle_sets(rows["text"], WIDTH):
                n = len(s)
                if n == 0 or (i := named(s, moved)) in seen:
                    continue
                seen.add(i)
                if n <= small:
                    keys = [np.array(c, np.uint64) for k in subset_sizes(n) for c in combinations(s.tolist(), k)]
                    out.append((np.array([set_id(k) for k in keys], np.int64), i, n, np.full(len(keys), -1, np.int32)))
                if DEN * n >= NUM * (small + 1):
                    p = posted(n)
                    if len(names):
                        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                        weight = np.where(names[at] == s, weights[at], 0)  # by powers of four
                        first = s[np.lexsort((s, weight))[:p]]
                    else:
                        first = s[:p]
                    out.append((first.view(np.int64), i, n, np.arange(p, dtype=np.int32)))
                total += len(out[-1][0])
                if total > 200_000:
                    yield _posting_frame(out)
                    out, total = [], 0
            if out:
                yield _posting_frame(out)

    return run


def _posting_frame(out: list) -> pd.DataFrame:
    lengths = [len(o[0]) for o in out]
    return pd.DataFrame({"key": np.concatenate([o[0] for o in out]), "sid": np.repeat(np.array([o[1] for o in out], np.int64), lengths), "n": np.repeat(np.array([o[2] for o in out], np.int32), lengths), "pos": np.concatenate([o[3] for o in out])})


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    sets = lambda packed: shingles.shingle_sets((unpack.decompress(p).decode("utf-8", "surrogatepass") for p in packed), WIDTH)
    for rows in frames:
        for k in range(0, len(rows), 100):
            part = rows.iloc[k : k + 100]
            own = dict(zip(part["a"], part["text_a"]))
            left = dict(zip(own, sets(own.values())))
            linked, apart = [], []
            for a, other in zip(part["a"], sets(part["text_b"])):
                both = len(np.intersect1d(left[a], other, assume_unique=True))
                union = len(left[a]) + len(other) - both
                linked.append(DEN * both >= NUM * union)
                apart.append(1 - both / union)
            yield part[["a", "b"]].assign(linked=linked, apart=apart)


def _pack(moved: dict[tuple[int, int], int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for rows in frames:
            # rows of one doc_id may hold several sets
            own = np.array([named(s, moved) for s in shingles.shingle_sets(rows["text"], WIDTH)], np.int64) == rows["sid"].to_numpy()
            rows = rows[own]
            yield pd.DataFrame({"sid": rows["sid"], "packed": [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in rows["text"]]})

    return run


def _possible(na, nb, pa, pb):
    """Sizes can reach the similarity, and so can what follows these positions (-1: a subset's key).

    What follows must do it alone: at the first shingle that two linked sets share, nothing before it is shared.
    """
    least = F.ceil((na + nb) * F.lit(NUM) / F.lit(NUM + DEN) - F.lit(1e-9))
    return (F.least(na, nb) * DEN >= F.greatest(na, nb) * NUM) & ((pa < 0) | (F.least(na - pa, nb - pb) >= least))


class Join:
    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", "text")
        schema = "doc_id long, n long, sid long, sid2 long, heavy long, weight long"
        both = materialize(self.docs.mapInPandas(_first_pass, schema), "sets")
        sets = both.where("heavy is null").select("doc_id", "n", "sid", "sid2")
        spark = docs.sparkSession
        moved = renamed(sets)
        if moved:
            names_ = spark.createDataFrame([(*k, v) for k, v in moved.items()], "sid long, sid2 long, own long")
            sets = sets.join(F.broadcast(names_), ["sid", "sid2"], "left").withColumn("sid", F.coalesce("own", "sid"))
        self.sets = sets.select("doc_id", "n", "sid")
        # at most HEAVY rows of two numbers
        heavy = both.where("heavy is not null").groupBy("heavy").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "heavy").limit(HEAVY).toArrow()
        names = heavy["heavy"].to_numpy().view(np.uint64)
        order = np.argsort(names)
        sent = spark.sparkContext.broadcast((names[order], np.log2(heavy["weight"].to_numpy().astype(float)[order] + 1).astype(np.int8) // 2))
        # one row for each size
        sizes = Counter({r["n"]: r["c"] for r in self.sets.where("n > 0").where(F.col("n") <= 4 * LARGEST_SMALL).groupBy("n").agg(F.count_distinct("sid").alias("c")).collect()})
        self.small = boundary(sizes)
        # dealt by key once, for the count and for the join
        rows = self.docs.mapInPandas(_posting_pass(sent, self.small, moved), "key long, sid long, n int, pos int").repartition("key")
        shared = rows.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.max("n").alias("n"), F.max("pos").alias("pos"))
        # all columns are used, so that both sides read one exchange
        shared = shared.where("lo < hi and n > 0 and pos >= -1").select("key")
        # sets in many shared lists lie in the middle of their neighbours; a set is in no more lists than it has shingles
        lists = rows.join(shared, "key").dropDuplicates(["key", "sid"])
        self.lists = materialize(lists.withColumn("lists", F.count("*").over(Window.partitionBy("sid"))), "lists")
        need = self.lists.select("sid").distinct()
        one = self.sets.groupBy("sid").agg(F.min("doc_id").alias("doc_id")).join(need.hint("merge"), "sid")
        sent.unpersist()
        release(spark)
        found = self.docs.join(one.hint("merge"), "doc_id").select("sid", "text").mapInPandas(_pack(moved), "sid long, packed binary")
        # the exchange by id serves the choice of one row and the buckets
        self.texts = bucketed(found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sid").dropDuplicates(["sid"]), "sid", "texts")
        release(spark)

    def verify(self, pairs: DataFrame) -> DataFrame:
        """``a, b, linked, apart`` (1 - similarity) of pairs of set ids."""
        a = self.texts.select(F.col("sid").alias("a"), F.col("packed").alias("text_a"))
        b = self.texts.select(F.col("sid").alias("b"), F.col("packed").alias("text_b"))
        out = materialize(pairs.select("a", "b").join(b.hint("merge"), "b").join(a.hint("merge"), "a").mapInPandas(_compare, "a long, b long, linked boolean, apart double"), "verified")
        release(pairs.sparkSession)
        return out

    @staticmethod
    def hubs(lists: DataFrame) -> DataFrame:
        """The set of each list that is in most lists."""
        return lists.groupBy("key").agg(F.max(F.struct("lists", "sid", "n", "pos")).alias("h"), F.count("*").alias("c"))

    @staticmethod
    def best(met: DataFrame, most: int = 1) -> DataFrame:
        """``sid, hub``: the hubs that a set shares most lists with."""
        shared = met.groupBy("sid", "hub").agg(F.count("*").alias("c"))
        if most == 1:
            return shared.groupBy("sid").agg(F.max(F.struct("c", "hub")).alias("m")).select("sid", F.col("m.hub").alias("hub"))
        rank = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("c"), F.desc("hub")))
        return shared.withColumn("rank", rank).where(F.col("rank") <= most).select("sid", "hub")

    @staticmethod
    def pairs(best: DataFrame) -> DataFrame:
        return best.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct()

    def hub_pairs(self) -> DataFrame:
        met = self.lists.join(self.hubs(self.lists).hint("merge"), "key").where(F.col("sid") != F.col("h.sid"))
        met = met.where(_possible(F.col("n"), F.col("h.n"), F.col("pos"), F.col("h.pos")))
        return materialize(self.best(met.select("sid", F.col("h.sid").alias("hub"))), "hubs")

    def open_lists(self, parts: DataFrame) -> DataFrame:
        """Lists whose sets are in more than one component, with the components."""
        labelled = self.lists.join(parts.withColumnRenamed("node", "sid").hint("merge"), "sid", "left").withColumn("part", F.coalesce("component", "sid")).drop("component")
        mixed = labelled.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
        return materialize(labelled.join(mixed.hint("merge"), "key"), "open")

    def star_pairs(self, open_lists: DataFrame) -> DataFrame:
        """Sets against central members of the largest component of their lists, if that is another one.

        Each list puts up a member of its own, so a set meets several; the STARS most frequent are compared.
        """
        score = F.col("lists") + F.pmod(F.xxhash64("sid", "key"), F.lit(8))
        own = open_lists.groupBy("key", "part").agg(F.max(F.struct(score.alias("score"), "sid", "n", "pos")).alias("h"), F.count("*").alias("c"))
        top = own.groupBy("key").agg(F.max(F.struct("c", "part", "h")).alias("t")).select("key", F.col("t.part").alias("top"), F.col("t.h").alias("h"))
        met = open_lists.join(top.hint("merge"), "key").where(F.col("part") != F.col("top"))
        met = met.where(_possible(F.col("n"), F.col("h.n"), F.col("pos"), F.col("h.pos")))
        return self.best(met.select("sid", F.col("h.sid").alias("hub")), STARS)

    @staticmethod
    def cross_pairs(open_lists: DataFrame, seen: DataFrame) -> DataFrame:
        """What is left: sets of a list in different components that the filters let through.

        ``seen(sid, hub, apart)``: distances to a common hub exclude pairs by the triangle inequality, which holds for
        the distance 1 - similarity.
        """
        known = open_lists.join(seen.hint("merge"), "sid", "left")
        x, y = (known.select("key", *(F.col(c).alias(f"{k}_{c}") for c in ("sid", "n", "pos", "part", "hub", "apart"))) for k in "ab")
        c = lambda name: (F.col(f"a_{name}"), F.col(f"b_{name}"))
        (a, b), (na, nb), (pa, pb), (ca, cb), (ha, hb), (da, db) = (c(n) for n in ("sid", "n", "pos", "part", "hub", "apart"))
        excluded = F.coalesce((ha == hb) & (F.abs(da - db) > 1 - NUM / DEN + 1e-9), F.lit(False))
        met = x.join(y, "key").where((a < b) & (ca != cb) & ~excluded & _possible(na, nb, pa, pb))
        return met.select(a.alias("a"), b.alias("b")).distinct()

    def run(self) -> DataFrame:
        """``node, component`` over set ids that link with another set."""
        first = self.hub_pairs()
        done = self.verify(self.pairs(first))
        # sets that link with their hub go by it for now; hubs that link with one another are found below
        linked = done.where("linked")
        ends = linked.select(F.col("a").alias("sid"), F.col("b").alias("hub")).unionByName(linked.select(F.col("b").alias("sid"), F.col("a").alias("hub")))
        left = self.open_lists(first.join(ends, ["sid", "hub"], "left_semi").select(F.col("sid").alias("node"), F.col("hub").alias("component")))
        star = materialize(self.pairs(self.star_pairs(left)).join(done.select("a", "b"), ["a", "b"], "left_anti"), "stars")
        discard(left)
        done = materialize(done.unionByName(self.verify(star)), "done")
        left = self.open_lists(components(done.where("linked").select("a", "b")))
        both = done.select("a", "b", "apart")
        seen = first.join(both.withColumnsRenamed({"a": "sid", "b": "hub"}).unionByName(both.select(F.col("b").alias("sid"), F.col("a").alias("hub"), "apart")), ["sid", "hub"])
        itself = first.select(F.col("hub").alias("sid"), "hub", F.lit(0.0).alias("apart")).distinct()
        seen = materialize(seen.unionByName(itself).groupBy("sid").agg(F.min(F.struct("apart", "hub")).alias("m")).select("sid", "m.hub", "m.apart"), "seen")
        cross = materialize(self.cross_pairs(left, seen).join(done.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        discard(left, seen, first, self.lists)
        del left, seen, first, star, both, itself
        release(cross.sparkSession)
        done = done.unionByName(self.verify(cross))
        drop(self.texts)
        return components(done.where("linked").select("a", "b"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    join = Join(docs)
    parts = join.run()
    classes = join.sets.where("n > 0").join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("part", F.coalesce("component", "sid"))
    heads = classes.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    labels = classes.select("sid", "part").distinct().join(heads, "part").select("sid", "component_id")
    out = join.sets.join(labels, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which one of each component stays: the one with the smallest doc_id."""
    return without(docs, jaccard_join(docs).select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), "kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
