"""Forward chaining: rules in order of confidence, each seeing the facts that those before it made.

A rule's first turn joins whole relations. Later turns are semi-naive: every walk over older facts has been taken, so
one edge at least must have been made since the rule's last turn; if none of its relations has grown, no job runs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.paths import one_path, walk_ends
from ..schema import CASE_DDL, EDGE_DDL, RESULT_DDL, InferenceConfig
from ..sources.store import materialise
from .conflicts import against_pairs, record
from .rules import listed, with_status

#: When facts were inferred, unless the caller says.
EPOCH = datetime(1970, 1, 1)


@dataclass
class Inference:
    """created: the new edges. rules: their table afterwards. results: a row for each rule and round."""

    created: DataFrame
    rules: DataFrame
    cases: DataFrame
    results: DataFrame
    rounds: int
    conflicts: int
    total_created: int


def as_facts(edges: DataFrame) -> DataFrame:
    """edges with all columns of EDGE_DDL."""
    have = set(edges.columns)
    typed = [x.split() for x in EDGE_DDL.split(", ")]
    return edges.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in typed])


#: Tables of made facts that a relation is read from before they are put together.
MOST_TABLES = 8


class Facts:
    """The edges by relation: those of the graph, and the tables made since, in order."""

    def __init__(self, edges: DataFrame):
        self.edges, self.made, self.older = edges, [], {}

    def add(self, rel: str, rows: DataFrame) -> None:
        self.made.append((rel, rows))

    def of(self, rel: str) -> DataFrame:
        """All edges of the relation."""
        start, rows = self.older.get(rel, (0, self.edges.where(F.col("rel") == rel)))
        newer = [df for r, df in self.made[start:] if r == rel]
        for df in newer:
            rows = rows.unionByName(df)
        if len(newer) >= MOST_TABLES:
            rows = materialise(rows, "facts")
            self.older[rel] = (len(self.made), rows)
        return rows

    def since(self, turn: int, rel: str) -> DataFrame | None:
        """Edges of the relation made after the first turn tables; None if there are none."""
        found = None
        for r, df in self.made[turn:]:
            if r == rel:
                found = df if found is None else found.unionByName(df)
        return found


def new_facts(edges: DataFrame, body, head: str) -> DataFrame:
    """(x, y) that the body joins and the head does not."""
    heads = edges.where(F.col("rel") == head).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    return one_path(edges, body).join(heads, ["x", "y"], "left_anti")


def _fresh(facts: Facts, body: list[str], head: str, turn: int | None) -> DataFrame | None:
    """new_facts, from walks with an edge made since the rule's last turn if it had one; None if there can be none."""
    if turn is None:
        ends = walk_ends([facts.of(rel) for rel in body], body)
    else:
        ends, whole = None, {rel: facts.of(rel) for rel in body}
        for i, rel in enumerate(body):
            newer = facts.since(turn, rel)
            if newer is not None:
                found = walk_ends([newer if j == i else whole[r] for j, r in enumerate(body)], body)
                ends = found if ends is None else ends.unionByName(found).distinct()
        if ends is None:
            return None
    return ends.join(facts.of(head).select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"], "left_anti")


def _made(pairs: DataFrame, rule, now) -> DataFrame:
    """pairs as edges. Ids depend on their content, as in with_ids, so no id has to be handed out."""
    head = F.lit(rule["head_relation"])
    return pairs.select(
        F.xxhash64(head, "x", "y").alias("eid"), F.col("x").alias("src"), head.alias("rel"), F.col("y").alias("dst"),
        F.lit(True).alias("is_inferred"), F.lit(rule["rule_id"]).alias("source_rule_id"), F.lit(float(rule["pca_confidence"])).alias("rule_confidence"), F.lit(now).cast("timestamp").alias("inferred_at"),
    )


def infer(
    edges: DataFrame, rules: DataFrame, config: InferenceConfig = InferenceConfig(), *, conflicts: Mapping[str, set[str]] | None = None, cases: DataFrame | None = None, now: datetime = EPOCH
) -> Inference:
    """Apply the adopted rules once, or until a round makes nothing or max_iterations have run.

    Rules go by confidence, then support; a rule's facts are written before the next rule reads them. Conflicts are
    counted and recorded but never stop a fact. Rules that made a fact become applied and rise a version.
    """
    spark: SparkSession = edges.sparkSession
    conflicts = conflicts or {}
    facts = Facts(as_facts(edges))
    cases = spark.createDataFrame([], CASE_DDL) if cases is None else cases
    todo = listed(rules, "adopted", config.limit_rules).collect()  # at most limit_rules
    created_all, results, applied, rounds, total_conflicts, total = spark.createDataFrame([], EDGE_DDL), [], [], 0, 0, 0
    turns: dict[str, int] = {}  # how many tables had been made at a rule's last turn
    for iteration in range(1, (config.max_iterations if config.fixpoint else 1) + 1):
        if not todo:
            break
        rounds, made_in_round = iteration, 0
        for rule in todo:
            body, head, own = list(rule["body_relations"]), rule["head_relation"], rule["rule_id"]
            fresh = _fresh(facts, body, head, turns.get(own))
            turns[own] = len(facts.made)
            count = met_count = 0
            if fresh is not None:
                created = materialise(_made(fresh, rule, now))
                count = created.count()
            against = conflicts.get(head, set())
            if count and against and (config.check_conflicts or not config.legacy_case_lengths or len(body) <= 3):
                # What a rule is about to make is what its body joins and its head does not: one walk serves both.
                pairs = created.select(F.col("src").alias("x"), F.col("dst").alias("y"))
                met = materialise(pairs.join(against_pairs([(r, facts.of(r)) for r in sorted(against)]), ["x", "y"]), "conflicts")
                if config.check_conflicts:
                    met_count = met.select("x", "y").distinct().count()
                if not config.legacy_case_lengths or len(body) <= 3:
                    cases = materialise(record(cases, met, own, head, iteration, now), "cases")
            if count:
                facts.add(head, created)
                created_all = created_all.unionByName(created)
                applied.append(own)
            made_in_round += count
            total_conflicts += met_count
            results.append((own, count, met_count, iteration))
        total += made_in_round
        if not made_in_round:
            break
    if applied:
        rules = with_status(rules, sorted(set(applied)), "applied", bump=True)
    return Inference(created_all, rules, cases, spark.createDataFrame(results, RESULT_DDL), rounds, total_conflicts, total)
