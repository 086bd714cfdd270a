"""Connected components by alternating stars: every node ends up linked to the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import release, saved


#: Edges up to which a step is one plan. Beyond, its parts are written, so that joins at a hub have nothing but exchanges below
#: them and can be split; the result is the same.
PLAIN_EDGES = 2_000_000


def _stars(edges: DataFrame, large: bool, split: bool) -> DataFrame:
    """One star step. Large: a node's larger neighbours move to the smallest in its neighbourhood; small: its smaller ones and
    itself. The smallest neighbour comes from a partial aggregate and goes back by a join, so a hub's neighbourhood is never
    gathered."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = saved(least, "least") if split else least
    joined = both.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = moved.filter("a <> b").distinct()
    if split:
        out = saved(out, "stars")
        release(least)
    return out


def components(edges: DataFrame, plain: int = PLAIN_EDGES) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b), from a written table; the component is its smallest node. Loops and
    repeats do no harm. The steps go on until nothing moves, however many that takes."""
    now = saved(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    n, before = now.count(), None
    while n:
        split = n > plain
        first = _stars(now, True, split)
        after = _stars(first, False, split)
        after = after if split else saved(after, "stars")
        release(now, *([first] if split else []))
        now = after
        # Both steps keep the components; nothing more moves once the sum over all edges stands still and every edge is a star's.
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        n, before = state[0], state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
