"""Incremental mining: fold the unread log, refresh known rules, mine bodies that were touched, merge."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import rule_text
from ..plans.metrics import ratio, score_rules
from ..plans.mine import first_by_id, mine
from ..plans.paths import Graph, paths
from ..schema import STAT_DDL, MiningConfig
from ..sources.store import materialise
from .changelog import delta, pending
from .rules import by_relations, upsert


@dataclass
class IncrementalRun:
    """mined: refreshed and discovered rules. rules: the table afterwards. cursor: last entry read."""

    mined: DataFrame
    rules: DataFrame
    stats: DataFrame
    processed: int
    cursor: int
    affected: list[str]


def refreshed(edges: DataFrame | Graph, rules: DataFrame, relations: list[str], n: int, factual_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rules, stats) with metrics of today for the known rules of n body relations that involve one of relations.

    Only walks along the bodies of these rules are made, cut to their prefixes at each hop.
    """
    known = by_relations(rules, relations).where(F.size("body_relations") == n)
    wanted = known.select(F.col("body_relations").alias("body"), F.col("head_relation").alias("head"))
    scored = score_rules(wanted, paths(edges, n, factual_only=factual_only, bodies=wanted.select("body").distinct()))
    joined = known.select("rule_id", F.col("body_relations").alias("body"), F.col("head_relation").alias("head"), "status", "version").join(scored, ["body", "head"])
    fresh = joined.select(
        "rule_id", F.col("body").alias("body_relations"), F.col("head").alias("head_relation"), "support", ratio(F.col("support"), F.col("pca_denominator")).alias("pca_confidence"),
        ratio(F.col("support"), F.col("head_count")).alias("head_coverage"), "status", "version", rule_text(F.col("body"), F.col("head")).alias("rule_text"),
    )
    return fresh, joined.select("rule_id", "support", "pca_denominator", "head_count")


def merge(fresh: DataFrame, discovered: DataFrame) -> DataFrame:
    """Both, a discovered rule before a refreshed one of the same id."""
    both = fresh.withColumn("rank", F.lit(1)).unionByName(discovered.withColumn("rank", F.lit(0)))
    return first_by_id(both, "rank").drop("rank")


def run_incremental(edges: DataFrame, rules: DataFrame, log: DataFrame, cursor: int, config: MiningConfig, *, change_limit: int = 2000, hints: tuple[str, ...] = (), legacy_cursor: bool = False) -> IncrementalRun:
    """One pass over the unread log. hints name relations to use if the log leaves none.

    A window that folds to nothing still moves the cursor, unless legacy_cursor.
    """
    window = materialise(pending(log, cursor, change_limit), "window")
    net = delta(window)
    processed = net.count()
    last = window.agg(F.max("change_seq")).first()[0]
    last = cursor if last is None else last
    affected = sorted(r["rel"] for r in net.where("rel <> ''").select("rel").distinct().collect()) or sorted({h for h in hints if h})
    if not affected:
        empty = rules.limit(0)
        return IncrementalRun(empty, rules, rules.sparkSession.createDataFrame([], STAT_DDL), 0, cursor if legacy_cursor else last, [])
    graph = Graph.of(edges, config.factual_only)
    fresh, stats = refreshed(graph, rules, affected, config.body_length)
    fresh, stats = materialise(fresh, "refreshed"), materialise(stats, "stats")
    discovered = mine(graph, replace(config, changed_relations=tuple(affected)))
    graph.release()
    mined = materialise(merge(fresh, discovered), "merged")
    return IncrementalRun(mined, upsert(rules, mined), stats, processed, last, affected)
