"""Connected components of an edge table by alternating large and small stars.

Every round is joins and aggregations by key, and is written to the shared folder; the number of rounds grows
with the logarithm of a component's size. A node with more than HUB neighbours, and more than a MOST_HUBS-th of
all edges' ends, is a hub: there are at most MOST_HUBS of them, their minima are broadcast, and their edges are
joined where they lie; so a star's centre is no hot key, and no task and no driver sees a component whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, discard

HUB = 1000
MOST_HUBS = 50_000


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("s")).first()
    return r["n"], r["s"]


def _with_least(edges: DataFrame, rows: int, most: int) -> DataFrame:
    """edges (a, b; `rows` of them) with m, the smallest b of each a; an a with more than `most` rows is a hub."""

    def spread(part: DataFrame) -> DataFrame:  # at most `most` rows of an a
        near = part.groupBy("a").agg(F.min("b").alias("m"), F.collect_list("b").alias("bs"))
        return near.select("a", F.explode("bs").alias("b"), "m")

    if rows <= most:
        return spread(edges)
    hubs = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("d")).filter(F.col("d") > most).select("u", "m")
    if not hubs.limit(1).count():
        return spread(edges)
    hubs = F.broadcast(hubs)
    of_hubs = edges.join(hubs, edges["a"] == hubs["u"]).select("a", "b", "m")
    return of_hubs.unionByName(spread(edges.join(hubs, edges["a"] == hubs["u"], "left_anti")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of an edge (a, b: long); loops and repeats are allowed."""
    # a > b in every edge
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(now)
    while before[0]:
        n = before[0]
        most = max(HUB, 2 * n // MOST_HUBS)
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        # large star: larger neighbours of a go to the smallest node around a; settled, as its plan would be part of all that follow
        large = cut(_with_least(both, 2 * n, most).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        # small star: a and its smaller neighbours go to the smallest of them
        near = _with_least(large, n, most)
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = near.select(F.explode(ends).alias("e")).select("e.*").filter("a <> b").distinct()
        old, now = now, cut(small)
        discard(old, large)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
