"""Mining: bodies, pruning, closing, scoring."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import plain_relation, rule_id, rule_text
from ..schema import RULE_DDL, MiningConfig
from ..sources.store import materialise
from . import prune
from .metrics import candidates, ratio
from .paths import Graph, Walks, body_supports, paths


def scored(found: DataFrame, counts: DataFrame, config: MiningConfig) -> DataFrame:
    """Candidates as rules: confidence, coverage, thresholds, order and top_k."""
    joined = found.join(counts.withColumnRenamed("rel", "head"), "head", "left")
    rules = joined.select(
        rule_id(F.col("body"), F.col("head")).alias("rule_id"), F.col("body").alias("body_relations"), F.col("head").alias("head_relation"), "support",
        ratio(F.col("support"), F.col("pca_denominator")).alias("pca_confidence"), ratio(F.col("support"), F.coalesce("head_count", F.lit(0))).alias("head_coverage"),
        F.lit("discovered").alias("status"), F.lit(1).cast("long").alias("version"), rule_text(F.col("body"), F.col("head")).alias("rule_text"),
    )
    kept = rules.where((F.col("support") >= config.min_support) & (F.col("pca_confidence") >= config.min_pca_confidence) & (F.col("head_coverage") >= config.min_head_coverage))
    return kept.orderBy(F.desc("pca_confidence"), F.desc("support"), F.desc("head_coverage"), "rule_id").limit(config.top_k)


def _pairs(graph: Graph, config: MiningConfig) -> tuple[Walks, DataFrame, DataFrame]:
    """(walks of two, scanned bodies, surviving bodies)."""
    walks = paths(graph, 2, changed=config.changed_relations).hold()
    scanned = graph.hold(body_supports(walks, config.candidate_limit))
    kept = prune.by_support(scanned, config.min_support)
    return walks, scanned, prune.redundant(kept) if config.prune_redundant else kept


def _triples(graph: Graph, config: MiningConfig) -> tuple[Walks, DataFrame]:
    """(walks of three, surviving bodies)."""
    _, scanned, prefixes = _pairs(graph, config)
    prefixes = graph.hold(prefixes)
    if prefixes.isEmpty() and not config.strict_prefixes:
        prefixes = None  # no prefix left restricts nothing
    walks = paths(graph, 3, changed=config.changed_relations, prefixes=prefixes).hold()
    kept = prune.by_support(body_supports(walks, config.candidate_limit), config.min_support)
    return walks, prune.non_improving(kept, scanned) if config.prune_non_improving else kept


def mine(edges: DataFrame | Graph, config: MiningConfig) -> DataFrame:
    """Rules of the graph (eid, src, rel, dst and optionally is_inferred), best first, as RULE_DDL.

    Bodies of two and three are pruned by support and redundancy or improvement and cut by the beam; bodies of four
    and five keep their best heads only. Then signatures are deduplicated, the confidence bound and the budget of
    heads applied, and the thresholds last. The rules, top_k at most, are written to the shared folder.
    """
    if config.changed_relations is not None:
        changed = tuple(sorted({r for r in map(plain_relation, config.changed_relations) if r}))
        if not changed:
            return (edges.spark if isinstance(edges, Graph) else edges.sparkSession).createDataFrame([], RULE_DDL)
        config = replace(config, changed_relations=changed)
    graph = Graph.of(edges, config.factual_only)
    try:
        return materialise(_mined(graph, config), "mined")
    finally:
        if graph is not edges:
            graph.release()


def _mined(graph: Graph, config: MiningConfig) -> DataFrame:
    n, heads = config.body_length, None
    if n == 2:
        walks, _, bodies = _pairs(graph, config)
    elif n == 3:
        walks, bodies = _triples(graph, config)
    else:
        walks = paths(graph, n, changed=config.changed_relations).hold()
        bodies, heads = body_supports(walks, config.candidate_limit), config.heads_per_body
    if n <= 3:
        bodies = prune.beam(bodies, graph.functionality(), n, config.beam_width)
    found = candidates(walks.only(graph.hold(bodies)), limit=config.candidate_limit, heads_per_body=heads)
    found = prune.confidence_bound(prune.dedup(found), config.min_pca_confidence, config.confidence_ub_weight)
    found = prune.head_budget(found, config.head_budget_per_relation)
    return scored(found, graph.head_counts(), config)


def collisions(rules: DataFrame) -> DataFrame:
    """(rule_id, rules): ids that different rules would share."""
    each = rules.select("rule_id", "body_relations", "head_relation").distinct()
    return each.groupBy("rule_id").agg(F.count("*").alias("rules")).where("rules > 1")


def first_by_id(rules: DataFrame, *order) -> DataFrame:
    """One row a rule_id, the first in the order."""
    return rules.withColumn("place", F.row_number().over(Window.partitionBy("rule_id").orderBy(*order))).where("place = 1").drop("place")
