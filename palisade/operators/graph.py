"""Bounded traversal of typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError


def traverse(edges: DataFrame, start: str, kinds: tuple[str, ...] = (), direction: str = "out", depth: int = 10) -> DataFrame:
    """(node, depth) of what start reaches, each at its least depth; at most 10 deep."""
    if not 0 <= depth <= 10:
        raise EngineError("validation_failed", "depth from 0 to 10")
    if kinds:
        edges = edges.filter(F.col("kind").isin(*kinds))
    out, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction not in ("out", "in", "both"):
        raise EngineError("validation_failed", f"direction {direction}")
    steps = out if direction == "out" else back if direction == "in" else out.unionAll(back)
    steps = steps.distinct()
    level = edges.sparkSession.createDataFrame([(start, 0)], "node string, depth int")
    seen = level
    for _ in range(depth):
        level = level.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        seen = seen.unionAll(level)
    return seen.groupBy("node").agg(F.min("depth").alias("depth"))
