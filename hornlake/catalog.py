"""The engine's queries over the order tables, and the SQL that each must agree with."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import rule_id, rule_text
from .operators import changelog, conflicts, rules
from .operators.incremental import merge, refreshed
from .operators.infer import infer, new_facts
from .plans import prune
from .plans.metrics import candidates, functionality, head_counts, relation_frequency, rule_metrics
from .plans.mine import mine
from .plans.paths import Graph, body_supports, one_path, paths
from .schema import CASE_DDL, InferenceConfig, MiningConfig
from .sources.graph import CHAINS, KIND_BITS, ORDERS, load_edges, load_nodes, project, table

CHANGED = ("suppNation", "custNation")
RULES = ((("custNation", "inRegion"), "custRegion", 0.9), (("placedBy", "custNation"), "shipsToNation", 0.8), (("shipsToNation", "inRegion"), "shipsToRegion", 0.7))
CONFLICTS = {"shipsToNation": {"notShipped"}}
NOW = datetime(2024, 1, 1)


def _graph(spark: SparkSession, sf_dir: str, which: str = "a", coded: bool = False) -> DataFrame:
    """a: orders, b: chains from customers, c: a with a conflicting relation, f: a with some edges inferred. Nodes are numbers if coded."""
    relations = {"b": CHAINS, "c": (*ORDERS, "notShipped")}.get(which, ORDERS)
    edges = project(spark, sf_dir, relations, coded)
    if which == "f":
        key = F.shiftright("src", KIND_BITS) if coded else F.substring("src", 2, 20).cast("long")
        inferred = (F.col("rel") == "shipsToNation") & (key % 7 == 0)
        edges = edges.withColumn("is_inferred", inferred)
    return edges


def _coded(spark: SparkSession, sf_dir: str, which: str = "a") -> DataFrame:
    """The graph for results that name relations only."""
    return _graph(spark, sf_dir, which, coded=True)


def _spread(df: DataFrame, n: int, *others: str) -> DataFrame:
    return df.select(*[F.get("body", i).alias(f"r{i + 1}") for i in range(n)], *others)


def _bodies(spark, sf_dir, n: int, which: str = "a", **options) -> DataFrame:
    walks = paths(_coded(spark, sf_dir, which), n, **options)
    found = body_supports(walks)
    walks.done()
    return found


def _body(n: int, which: str = "a", **options):
    return lambda spark, sf_dir: _spread(_bodies(spark, sf_dir, n, which, **options), n, "body_support")


def _cands(spark, sf_dir, n: int, which: str = "a") -> DataFrame:
    walks = paths(_coded(spark, sf_dir, which), n).hold()
    found = candidates(walks, heads_per_body=50 if n > 3 else None)
    walks.done()
    return found


def _cand(n: int, which: str = "a"):
    return lambda spark, sf_dir: _spread(_cands(spark, sf_dir, n, which), n, "head", "support", "pca_denominator")


def _rules_out(found: DataFrame) -> DataFrame:
    return found.select("rule_id", F.array_join("body_relations", ",").alias("body"), "head_relation", "support", "pca_confidence", "head_coverage", "rule_text")


LOOSE = {"min_pca_confidence": 0.01}


def _mine(n: int, which: str = "a", **options):
    return lambda spark, sf_dir: _rules_out(mine(_coded(spark, sf_dir, which), MiningConfig(body_length=n, **LOOSE | options)))


def _body3_prefixed(spark, sf_dir):
    graph = Graph.of(_graph(spark, sf_dir))
    prefixes = prune.redundant(prune.by_support(body_supports(paths(graph, 2)), 2000))
    return _spread(body_supports(paths(graph, 3, prefixes=prefixes)), 3, "body_support")


def _nonimproving3(spark, sf_dir):
    graph = Graph.of(_graph(spark, sf_dir))
    return _spread(prune.non_improving(body_supports(paths(graph, 3)), body_supports(paths(graph, 2))), 3, "body_support")


def _beam(n: int, width: int):
    def query(spark, sf_dir):
        edges = _graph(spark, sf_dir)
        return _spread(prune.beam(body_supports(paths(edges, n)), functionality(edges), n, width), n, "body_support")

    return query


def _functionality_rank(spark, sf_dir):
    edges = _graph(spark, sf_dir)
    return _spread(prune.ranked_by_functionality(body_supports(paths(edges, 2)), functionality(edges), 2), 2, "body_support", "place")


def _dedup_signature(spark, sf_dir):
    found = _cands(spark, sf_dir, 2)
    shouted = found.select(F.transform("body", lambda r: F.concat(F.lit(" `"), F.upper(r), F.lit("`"))).alias("body"), "head", (F.col("support") - 1).alias("support"), "pca_denominator")
    return _spread(prune.dedup(found.unionByName(shouted)), 2, "head", "support", "pca_denominator")


def _on_candidates(step):
    return lambda spark, sf_dir: _spread(step(_cands(spark, sf_dir, 2)), 2, "head", "support", "pca_denominator")


def _known_rules(spark: SparkSession, status: str = "adopted") -> DataFrame:
    rows = [(list(b), h, c) for b, h, c in RULES]
    known = spark.createDataFrame(rows, "body_relations array<string>, head_relation string, pca_confidence double")
    return known.select(
        rule_id(F.col("body_relations"), F.col("head_relation")).alias("rule_id"), "body_relations", "head_relation", F.lit(10).cast("long").alias("support"), "pca_confidence", F.lit(0.5).alias("head_coverage"),
        F.lit(status).alias("status"), F.lit(1).cast("long").alias("version"), rule_text(F.col("body_relations"), F.col("head_relation")).alias("rule_text"),
    )


def _apply(body, head, which="a"):
    def query(spark, sf_dir):
        return new_facts(_graph(spark, sf_dir, which), body, head).select(F.col("x").alias("src"), F.lit(head).alias("rel"), F.col("y").alias("dst"))

    return query


def _inferred(spark, sf_dir, fixpoint: bool):
    return infer(_graph(spark, sf_dir, "c"), _known_rules(spark), InferenceConfig(fixpoint=fixpoint), conflicts=CONFLICTS, now=NOW)


def _facts_of(fixpoint: bool):
    return lambda spark, sf_dir: _inferred(spark, sf_dir, fixpoint).created.select("src", "rel", "dst", "source_rule_id", "rule_confidence")


def _summary(spark, sf_dir):
    return _inferred(spark, sf_dir, True).results


def _conflict_cases(spark, sf_dir):
    return _inferred(spark, sf_dir, True).cases.select("rule_id", "inferred_relation", "conflicting_relation", "source_x", "source_y", "detect_count", "first_iteration", "last_iteration")


def _conflict_count(spark, sf_dir):
    edges = _graph(spark, sf_dir, "c")
    return conflicts.meetings(one_path(edges, ("placedBy", "custNation")), edges, "shipsToNation", {"notShipped"}).agg(F.count("*").alias("n"))


def _rule_upsert(spark, sf_dir):
    known = rules.with_status(_known_rules(spark, "discovered"), ["rule__custnation__inregion__to__custregion"], "adopted")
    found = rules.upsert(known, mine(_graph(spark, sf_dir), MiningConfig(**LOOSE)))
    return found.select("rule_id", "support", "pca_confidence", "status", "version")


def _mined(spark, sf_dir) -> DataFrame:
    return mine(_coded(spark, sf_dir), MiningConfig(**LOOSE))


def _transitions(spark, _):
    return rules.outcomes(spark.createDataFrame([(s,) for s in rules.TRANSITIONS], "status string"))


def _log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("change_seq"), F.when(F.col("event_type") == "error", "removed").otherwise("added").alias("event_type"), F.col("user_id").cast("string").alias("src"),
        F.concat(F.lit("r"), (F.get_json_object("props", "$.k").cast("long") % 3).cast("string")).alias("rel"), (F.floor("value") % 2).cast("string").alias("dst"),
    )


def _appended(spark, sf_dir):
    """Every event is sent twice in a batch of its user; numbers go on for both."""
    one = _log(spark, sf_dir).withColumns({"source": F.lit("bench"), "batch_id": F.concat(F.lit("b"), "src"), "idempotency_key": F.lit(None).cast("string"), "metadata": F.lit("{}"), "created_at": F.lit(NOW)})
    sent = one.withColumn("position", F.col("change_seq")).drop("change_seq")
    return changelog.append(one.limit(0).withColumn("dedup_key", F.lit("")), sent.unionByName(sent), 10).select("change_seq", "dedup_key")


def _refresh(spark, sf_dir):
    fresh, _ = refreshed(_graph(spark, sf_dir), _known_rules(spark), list(CHANGED), 2)
    return fresh.select("rule_id", "support", "pca_confidence", "head_coverage", "status")


def _incremental_merge(spark, sf_dir):
    graph = Graph.of(_graph(spark, sf_dir))
    fresh, _ = refreshed(graph, _known_rules(spark), list(CHANGED), 2)
    return merge(fresh, mine(graph, MiningConfig(**LOOSE, changed_relations=CHANGED))).select("rule_id", "support", "pca_confidence", "status")


def _snapshot_diff(spark, sf_dir):
    edges = _graph(spark, sf_dir)
    return changelog.snapshot_diff(edges.where("rel <> 'custRegion'"), edges.where("rel <> 'inRegion'")).select("event_type", "src", "rel", "dst")


def _edge_load(spark, sf_dir):
    edges = _graph(spark, sf_dir)
    nodes = load_nodes(edges.where("rel IN ('custNation', 'suppNation')").select(F.explode(F.array("src", "dst")).alias("id")))
    return load_edges(edges.unionByName(edges), nodes).select("src", "rel", "dst")


def _node_load(spark, sf_dir):
    return load_nodes(_graph(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("id")))


def queries():
    return {
        "rel_frequency": lambda s, d: relation_frequency(_graph(s, d)),
        "head_counts": lambda s, d: head_counts(_graph(s, d, "f")),
        "head_counts_all": lambda s, d: head_counts(_graph(s, d, "f"), factual_only=False),
        "functionality": lambda s, d: functionality(_graph(s, d, "f")),
        "node_load": _node_load,
        "edge_load": _edge_load,
        "body2": _body(2),
        "body3": _body(3),
        "body4": _body(4),
        "body5": _body(5, "b"),
        "body2_factual": _body(2, "f"),
        "body2_touched": _body(2, changed=CHANGED),
        "body3_prefixed": _body3_prefixed,
        "cand2": _cand(2),
        "cand3": _cand(3),
        "cand4": _cand(4),
        "cand5": _cand(5, "b"),
        "metrics_rule_2": lambda s, d: rule_metrics(_graph(s, d), ("placedBy", "custNation"), "shipsToNation"),
        "metrics_rule_3": lambda s, d: rule_metrics(_graph(s, d), ("filledBy", "suppNation", "inRegion"), "shipsToRegion"),
        "support_prune": lambda s, d: _spread(prune.by_support(_bodies(s, d, 2), 2000), 2, "body_support"),
        "redundancy_prune": lambda s, d: _spread(prune.redundant(_bodies(s, d, 2)), 2, "body_support"),
        "functionality_rank": _functionality_rank,
        "beam2": _beam(2, 4),
        "beam3": _beam(3, 3),
        "nonimproving3": _nonimproving3,
        "dedup_signature": _dedup_signature,
        "ub_prune_w0": _on_candidates(lambda c: prune.confidence_bound(c, 0.2)),
        "ub_prune_w1": _on_candidates(lambda c: prune.confidence_bound(c, 0.2, 1.0)),
        "head_budget": _on_candidates(lambda c: prune.head_budget(c, 1)),
        "mine2": _mine(2),
        "mine3": _mine(3),
        "mine4": _mine(4),
        "mine5": _mine(5, "b"),
        "mine2_incremental": _mine(2, changed_relations=CHANGED),
        "mine3_incremental": _mine(3, changed_relations=CHANGED),
        "refresh_rules": _refresh,
        "incremental_merge": _incremental_merge,
        "apply2": _apply(("placedBy", "custNation"), "shipsToNation"),
        "apply3": _apply(("filledBy", "suppNation", "inRegion"), "shipsToRegion"),
        "apply_n": _apply(("places", "contains", "suppliedBy", "suppNation"), "custNation", "b"),
        "infer_once": _facts_of(False),
        "infer_fixpoint": _facts_of(True),
        "fixpoint_summary": _summary,
        "conflict_count": _conflict_count,
        "conflict_cases": _conflict_cases,
        "rule_upsert": _rule_upsert,
        "rule_list": lambda s, d: rules.listed(_mined(s, d), "discovered", 3).select("rule_id", "pca_confidence", "support"),
        "rules_by_relation": lambda s, d: rules.by_relations(_mined(s, d), ["inRegion", "filledBy"]).select("rule_id"),
        "relation_index": lambda s, d: rules.relation_index(_mined(s, d)),
        "rule_text_id": lambda s, d: mine(_coded(s, d), MiningConfig(body_length=3, **LOOSE)).select("rule_id", "rule_text"),
        "transition_matrix": _transitions,
        "changelog_dedup_seq": _appended,
        "changelog_fold": lambda s, d: changelog.folded(_log(s, d)),
        "pending": lambda s, d: changelog.pending(_log(s, d), 100, 250),
        "affected_relations": lambda s, d: changelog.affected_relations(_log(s, d)),
        "snapshot_diff": _snapshot_diff,
    }


def oracle_sql():
    from .oracle import oracle_sql as built

    return built()
