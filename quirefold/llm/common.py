"""What the training-data operators share: written intermediate tables, row keys, word splitting, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.shared import discard, materialize

__all__ = ["SPACES", "components", "discard", "lower_ascii", "materialize", "without"]

#: White space of the word contracts: blank and the control range from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(docs: DataFrame, verdicts: DataFrame, kept: str) -> DataFrame:
    """The rows of ``docs`` but those whose doc_id has verdicts and none with ``kept``.

    Rows are addressed by doc_id: one whose rows disagree stays, and so do rows without an id. The join is a merge at
    every size, so that what is dropped is never held in memory as a whole.
    """
    gone = verdicts.where("doc_id is not null").groupBy("doc_id").agg(F.max(kept).alias("any_kept")).where("not any_kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)`` with the smallest reachable node.

    Alternating large-star and small-star rounds, each a pair of aggregations; the number of rounds is logarithmic in
    the diameter. Stars keep one row per (node, hub); hubs are only aggregated by min, so that a hub with any number of
    neighbours is combined map-side. It ends when no row has a neighbour that is not its root, which is exact: then every
    edge goes from a node to a root, each node has one edge, and no root has one downwards. Running out of rounds is an
    error, never a partial result. Nodes without edges are absent. Self-loops are ignored; no edges give no rows.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u go to the smallest of u's neighbourhood
        large = both.where("v > u").join(hub, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below u go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = materialize(large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct(), "edges")
        discard(now)
        now = nxt
        # stars are done when every node has one edge, to a node that has none downwards
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("down")).distinct())
        state = ends.groupBy("x").agg(F.sum("down").alias("down"), F.count_if(F.col("down") == 0).alias("up")).where("down > 1 or (down > 0 and up > 0)")
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    below = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return below.unionByName(below.select(F.col("component").alias("node"), "component").distinct())
