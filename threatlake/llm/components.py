"""Connected components of a link table by repeated contraction.

In each round every node moves to the neighbour (or itself) of smallest pseudo-random rank, and the
links follow; the expected number of nodes falls by a constant factor, whatever the shape of the
components, so rounds grow with the logarithm of the nodes. A hub's links are reduced by partial
aggregates and joined with skew splitting. The driver sees the number of links left, nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatlake.session import Scratch


def _moves(links: DataFrame, turn: int) -> DataFrame:
    """node, to: the best-ranked of the node and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("r"), F.col(c).alias("node"))
    best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
    return best.select(F.col("a").alias("node"), F.least(rank("a"), "best")["node"].alias("to"))


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """``links`` (a, b: bigint) -> (node, root), one row per node that has a link; equal root: connected.

    Rows with a null or with a = b are no links. The root is any node of the component.
    """
    clean = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, turn, roots = work.table(clean, "links"), 0, None
    while roots is None or not left.isEmpty():
        moves = work.table(_moves(left, turn), f"moves{turn}")
        to_a = moves.select(F.col("node").alias("a"), F.col("to").alias("na"))
        to_b = moves.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        moved = left.join(to_a, "a").join(to_b, "b").where("na <> nb")
        after = moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        if roots is None:
            roots = moves.select("node", F.col("to").alias("root"))
        else:
            on = moves.select(F.col("node").alias("root"), "to")
            roots = roots.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = work.table(roots, f"roots{turn}")
        left = work.table(after, f"left{turn}")
        for old in (f"moves{turn}", f"roots{turn - 1}", f"left{turn - 1}" if turn else "links"):
            work.drop(old)
        turn += 1
    return roots
