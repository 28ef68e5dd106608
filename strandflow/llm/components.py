"""Connected components by alternating large and small stars, as joins and minima.

No neighbour list is gathered: a star step needs only each node's smallest
neighbour, so a node with any number of links is spread over tasks by the
partial aggregate and by Spark's split of skewed joins. Only a count and a
checksum of the links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import materialize, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(a, b) with a > b; large: each node's larger neighbours, small: its smaller ones and itself, to its smallest."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of links(a, b) that isn't itself the smallest."""
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
        wide = materialize(_star(now, True), "links")
        new = materialize(_star(wide, False), "links")
        release(now, wide)
        now = new
