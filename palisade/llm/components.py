"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, written_at


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, both["u"] == least["w"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = down.join(least, down["u"] == least["w"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (u, v): the component's least node.

    Loops and repeated edges do no harm. Every round is written to the shared
    folder, and the one before it removed; the rounds end when the edges are stars
    and stay the same.
    """
    stars, at = written_at(edges.filter("u <> v").select("u", "v").distinct(), name)
    print_of = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = stars.agg(print_of).first()[0]
    while True:
        older = at
        stars, at = written_at(_small(_large(stars).distinct()).distinct(), name)
        removed(edges.sparkSession, older)
        now = stars.agg(print_of).first()[0]
        if now == before:
            break
        before = now
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
