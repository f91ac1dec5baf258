"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with ``u`` uniform from
a hash of (doc_id, child), and the smallest draw wins: each child wins in proportion to its weight, and a change of a
child's weight moves documents only into or out of that child's subtree. A new shard opens a rack and a region of its
own, so it takes documents only into itself (law ``key``).

All of it is expressions on the JVM; slots are numbered in two steps (within chunks of a shard, then offsets of the
chunks), so that no task has to sort a whole shard.

Defined cases: a null text has 0 bytes (size 16) and the CRC of the empty string; a null doc_id is hashed as its own
value; repeated rows land in one shard with different slots; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm.common import materialize
from quirefold.tables import table

SHARDS, REGIONS, RACKS = 40, 5, 2
#: Rows of a shard are numbered in this many chunks per shard.
CHUNKS = 64


@dataclass(frozen=True)
class Topology:
    """``shards``: (region, rack, shard, weight) of each leaf; the weight of an inner node is the sum of its leaves."""

    shards: tuple[tuple[int, int, int, float], ...]
    seed: int = field(default=7)

    @classmethod
    def balanced(cls, shards: int = SHARDS, regions: int = REGIONS, racks: int = RACKS) -> Topology:
        """Shards in order, spread evenly over ``regions`` times ``racks``."""
        places = regions * racks
        return cls(tuple((k * regions // shards, k * places // shards, k, 1.0) for k in range(shards)))

    def grown(self, weight: float = 1.0) -> Topology:
        """With one more shard, in a region and rack of its own."""
        region, rack, shard = (max(s[j] for s in self.shards) + 1 for j in range(3))
        return Topology((*self.shards, (region, rack, shard, weight)), self.seed)

    def children(self, level: int) -> dict[int, dict[int, float]]:
        """Parent to {child: weight}; level 0 has the regions below the root."""
        out: dict[int, dict[int, float]] = {}
        for leaf in self.shards:
            parent = 0 if level == 0 else leaf[level - 1]
            kids = out.setdefault(parent, {})
            kids[leaf[level]] = kids.get(leaf[level], 0.0) + leaf[3]
        return out


def _unit(key: Column, level: int, child: Column, seed: int) -> Column:
    """Uniform in (0, 1), from 53 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child, F.lit(seed)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def _descend(key: Column, level: int, parent: Column, kids: dict[int, dict[int, float]], seed: int) -> Column:
    """The child of ``parent`` with the smallest draw. The parent is referenced once, so plans stay small."""
    entry = lambda child, weight: F.struct(F.lit(child).alias("node"), F.lit(float(weight)).alias("weight"))
    lists = F.array(*(F.array(*(entry(c, w) for c, w in sorted(kids.get(p, {-1: 1.0}).items()))) for p in range(max(kids) + 1)))
    draws = F.transform(F.get(lists, parent), lambda k: F.struct((-F.log(_unit(key, level, k["node"], seed)) / k["weight"]).alias("draw"), k["node"].alias("node")))
    return F.array_min(draws)["node"]


def place(docs: DataFrame, topology: Topology, key: str, out: str) -> DataFrame:
    """``docs`` with the shard of each row in column ``out``."""
    node = F.lit(0)
    for level in range(3):
        node = _descend(F.col(key), level, node, topology.children(level), topology.seed)
    return docs.withColumn(out, node)


def shard(docs: DataFrame, topology: Topology | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    topology = topology or Topology.balanced()
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = place(place(rows, topology, "doc_id", "shard"), topology.grown(), "doc_id", "grown_shard")
    rows = materialize(rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit("chunk")), F.lit(CHUNKS)).cast("int")), "placed")
    sizes = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("rank") + F.col("offset")).cast("long").alias("slot"), "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
