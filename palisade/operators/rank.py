"""Ranking rules: class-ordered binding and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strength classes from the strongest.
CLASSES = ("EXACT", "DECLARED", "LEARNED", "ANCHORED_STRONG", "UNANCHORED_STRONG", "WEAK")


def bind(candidates: DataFrame, span: str = "span", target: str = "target", strength: str = "class", score: str = "score", gap: float = 0.0) -> DataFrame:
    """One row a span: the target it binds to, or null and why.

    A stronger class always wins; scores compare within a class only. WEAK never
    binds, and two targets of one class within the gap refuse.
    """
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col(strength))
    best = candidates.groupBy(span, target).agg(F.min(F.struct(place.alias("place"), (-F.col(score)).alias("minus"))).alias("top"))
    order = Window.partitionBy(span).orderBy("top.place", "top.minus", target)
    ranked = best.withColumns({"nth": F.row_number().over(order), "next": F.lead("top").over(order)})
    first = ranked.filter("nth = 1")
    tie = (F.col("next.place") == F.col("top.place")) & (F.col("next.minus") - F.col("top.minus") <= gap)
    weak = F.col("top.place") >= len(CLASSES)
    verdict = F.when(weak, "weak").when(tie, "tie").otherwise("bound")
    return first.select(span, F.when(verdict == "bound", F.col(target)).alias("bound"), verdict.alias("verdict"), F.element_at(F.array(*map(F.lit, CLASSES)), F.col("top.place").cast("int")).alias("class"))


def nearest_rank(column: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")
