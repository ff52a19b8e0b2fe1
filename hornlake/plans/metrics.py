"""Frequencies, functionality, and the support, denominators and head counts of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graph import factual
from .paths import Walks, one_path


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def relation_frequency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "rel")


def head_counts(edges: DataFrame, factual_only: bool = True) -> DataFrame:
    """(rel, head_count): edges, parallel ones each."""
    return factual(edges, factual_only).groupBy("rel").agg(F.count("*").alias("head_count"))


def functionality(edges: DataFrame, factual_only: bool = True) -> DataFrame:
    """(rel, functionality): distinct sources by edge."""
    return factual(edges, factual_only).groupBy("rel").agg(ratio(F.count_distinct("src"), F.count("*")).alias("functionality"))


def supports(walks: Walks) -> DataFrame:
    """(code, head, support), head by number: distinct ends of a body that a head relation joins as well."""
    heads = walks.graph.links.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("rel").alias("head"))
    return walks.df.join(heads, ["x", "y"]).groupBy("code", "head").agg(F.count("*").alias("support"))


def _with_denominators(found: DataFrame, walks: Walks) -> DataFrame:
    """found (code, head) with pca_denominator: ends of the body whose x has some edge of the head; all heads in one plan."""
    wanted = found.select("code", "head")
    starts = walks.graph.links.select(F.col("src").alias("x"), F.col("rel").alias("head")).join(wanted.select("head").distinct(), "head", "left_semi").distinct()
    fans = walks.df.join(wanted.select("code").distinct(), "code", "left_semi").groupBy("code", "x").agg(F.count("*").alias("fan"))
    counted = fans.join(starts, "x").join(wanted, ["code", "head"], "left_semi").groupBy("code", "head").agg(F.sum("fan").alias("pca_denominator"))
    return found.join(counted, ["code", "head"], "left").withColumn("pca_denominator", F.coalesce("pca_denominator", F.lit(0).cast("long")))


def _named(found: DataFrame, walks: Walks) -> DataFrame:
    """(body, head, support, pca_denominator)."""
    return walks.named(found).select("body", walks.codes.name(F.col("head")).alias("head"), "support", "pca_denominator")


def candidates(walks: Walks, *, limit: int | None = None, heads_per_body: int | None = None) -> DataFrame:
    """(body, head, support, pca_denominator) of the best limit closings, each body with its best heads_per_body."""
    tally = walks.tally
    found = supports(walks) if tally is None else tally.closings
    if heads_per_body is not None:
        best = Window.partitionBy("code").orderBy(F.desc("support"), "head")
        found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= heads_per_body).drop("place")
    if limit is not None:
        found = found.orderBy(F.desc("support"), "code", "head").limit(limit)
    return _named(found if tally is not None else _with_denominators(walks.graph.hold(found), walks), walks)


def rule_metrics(edges: DataFrame, body: Sequence[str], head: str, factual_only: bool = True) -> DataFrame:
    """One row: support, pca_denominator, head_count of one rule."""
    kept = factual(edges, factual_only)
    walks = one_path(kept, body)
    heads = kept.where(F.col("rel") == head).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    support = walks.join(heads.distinct(), ["x", "y"], "left_semi").agg(F.count("*").alias("support"))
    denominator = walks.join(heads.select("x").distinct(), "x", "left_semi").agg(F.count("*").alias("pca_denominator"))
    return support.crossJoin(denominator).crossJoin(heads.agg(F.count("*").alias("head_count")))  # single rows


def score_rules(rules: DataFrame, walks: Walks) -> DataFrame:
    """rules (body, head) with support, pca_denominator and head_count, all in one plan; walks must cover the bodies."""
    codes = walks.codes
    asked = rules.select("body", "head").distinct()
    wanted = asked.select(codes.code(F.col("body"), walks.n).alias("code"), codes.number(F.col("head")).alias("head")).where("code IS NOT NULL AND head IS NOT NULL")
    known = supports(walks.only(wanted.select("code").distinct()))
    found = wanted.join(known, ["code", "head"], "left").withColumn("support", F.coalesce("support", F.lit(0).cast("long")))
    scored = asked.join(_named(_with_denominators(found, walks), walks), ["body", "head"], "left")
    counts = walks.graph.head_counts().withColumnRenamed("rel", "head")
    joined = scored.join(counts, "head", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("support", "pca_denominator", "head_count")})
