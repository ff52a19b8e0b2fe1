"""Steps that thin out bodies (body, body_support) and candidates (body, head, support, pca_denominator)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import signature
from .metrics import ratio


def by_support(bodies: DataFrame, min_support: int) -> DataFrame:
    return bodies.where(F.col("body_support") >= min_support)


def redundant(bodies: DataFrame) -> DataFrame:
    """Of bodies of two with equal first relation and support, that with the least second relation. Lossy by design."""
    same = Window.partitionBy(F.get("body", 0), "body_support").orderBy(F.get("body", 1))
    return bodies.withColumn("place", F.row_number().over(same)).where("place = 1").drop("place")


def non_improving(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples with less support than their first two relations have among the scanned pairs, or whose pair is unknown."""
    known = pairs.select(F.col("body").alias("prefix"), F.col("body_support").alias("prefix_support"))
    joined = triples.join(known, F.slice("body", 1, 2) == F.col("prefix"), "left")
    return joined.where(F.col("prefix_support").isNull() | (F.col("body_support") < F.col("prefix_support"))).select(*triples.columns)


def _functional(bodies: DataFrame, functionality: DataFrame, n: int) -> tuple[DataFrame, list[Column]]:
    """bodies with f0..fn-1, and the order by their sum, each of them, and the names."""
    for i in range(n):
        own = functionality.select(F.col("rel").alias(f"rel{i}"), F.col("functionality").alias(f"known{i}"))
        bodies = bodies.join(own, F.get("body", i) == F.col(f"rel{i}"), "left").withColumn(f"f{i}", F.coalesce(f"known{i}", F.lit(0.0))).drop(f"rel{i}", f"known{i}")
    total = F.col("f0")
    for i in range(1, n):
        total = total + F.col(f"f{i}")
    return bodies, [total.desc(), *(F.col(f"f{i}").desc() for i in range(n)), F.col("body").asc()]


def ranked_by_functionality(bodies: DataFrame, functionality: DataFrame, n: int) -> DataFrame:
    """bodies with place, 1 for the most functional; bodies are a summary, so one task orders them."""
    found, order = _functional(bodies, functionality, n)
    return found.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(*bodies.columns, "place")


def beam(bodies: DataFrame, functionality: DataFrame, n: int, width: int | None) -> DataFrame:
    """The width bodies of most support, then functionality; all without a width."""
    if width is None:
        return bodies
    found, order = _functional(bodies, functionality, n)
    return found.orderBy(F.desc("body_support"), *order).limit(width).select(*bodies.columns)


def dedup(candidates: DataFrame) -> DataFrame:
    """One candidate for each signature, that with most support, then least names."""
    same = Window.partitionBy(signature(F.col("body"), F.col("head"))).orderBy(F.desc("support"), "body", "head")
    return candidates.withColumn("place", F.row_number().over(same)).where("place = 1").drop("place")


def confidence_bound(candidates: DataFrame, min_confidence: float, weight: float = 0.0) -> DataFrame:
    """Candidates whose support over an effective denominator reaches min_confidence.

    With a weight, the denominator is blended with what the head's mean ratio of denominator to support would make of
    the support; both roundings are half-even.
    """
    support, denominator = F.greatest(F.col("support"), F.lit(1)), F.greatest(F.col("pca_denominator"), F.lit(1))
    effective = denominator.cast("double")
    if weight > 0:
        mean = F.avg(denominator.cast("double") / support.cast("double")).over(Window.partitionBy("head"))
        expected = F.bround(support * F.greatest(F.lit(1.0), mean))
        blended = F.bround(F.lit(1.0 - weight) * denominator + F.lit(float(weight)) * expected)
        effective = F.greatest(effective, blended, F.lit(1.0))
    bounded = candidates.withColumn("bound", F.col("support").cast("double") / effective)
    return bounded.where(F.col("bound") >= min_confidence).drop("bound")


def head_budget(candidates: DataFrame, budget: int | None) -> DataFrame:
    """For each head the budget candidates of most confidence, then support, smaller denominator and least body."""
    if budget is None:
        return candidates
    best = Window.partitionBy("head").orderBy(ratio(F.col("support"), F.col("pca_denominator")).desc(), F.desc("support"), "pca_denominator", "body")
    return candidates.withColumn("place", F.row_number().over(best)).where(F.col("place") <= budget).drop("place")
