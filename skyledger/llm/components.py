"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut, drop_cut


def _large(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest of them all and itself; b < a in the result."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours, and itself, on the smallest of them; links have b < a."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    small = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _done(links: DataFrame) -> bool:
    """Does every node hang on one node only, which hangs on none?"""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(None).alias("up")))
    seen = ends.groupBy("node").agg(F.min("up").alias("lo"), F.max("up").alias("hi"), F.max(F.col("up").isNull()).alias("holds"))
    return seen.filter("lo <> hi OR (holds AND hi IS NOT NULL)").head() is None


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node it is linked with, for every node in `links` (a, b: of one type that has an order, a <> b).

    The links of each half of a round are written to the shared folder, those before
    deleted: steps that start from files need a shuffle task per file, not one per
    partition. Rounds grow with the logarithm of the longest chain; links that are stars
    already take none. NULL ends are no links. Without links the result is empty.
    """
    at = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _done(at):
        for step in (_large, _small):
            after = cut(step(at))
            drop_cut(at)
            at = after
    roots = at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
