"""Connected components of an edge table, by alternating large-star and small-star steps. Nothing is collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.store import cut


def _star(pairs: DataFrame) -> DataFrame:
    """Each neighbour ``v`` of ``u`` with ``m``, the least of u and its neighbours: a map-side minimum, then a join on the same key.

    A root may have a third of all pairs; its rows of the join are then split by adaptive execution, as the other side has one row.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): component is the least id that can be reached.

    ``keep`` cuts the lineage after each round by a table in the shared folder.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _star(large).select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("v"))).filter("u <> v").distinct()
        now = keep(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # now every id but the roots has one edge, to its root
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
