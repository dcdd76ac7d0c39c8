"""Connected components of links, by alternating large and small stars.

Each round hangs every node under the least node it sees; links only ever join nodes of one
component, and the rounds needed grow with the logarithm of its size. Rounds are cut by tables in
the shared folder. Nothing but two sums per round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlift.session import materialise


def components(links: DataFrame, label: str = "stars") -> DataFrame:
    """``node, component`` for every node of ``links`` (two long columns ``a`` and ``b``); the
    component is its least node."""
    stars = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    stars, before = materialise(stars, label), None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialise(hung.union(least.select("u", "m")).distinct(), label)
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return roots.union(stars.select("u", "v"))
