"""The rule table: upserts, look-ups and life cycle. Every function maps snapshots to a new snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may follow a status.
TRANSITIONS = {"discovered": ("adopted", "rejected"), "adopted": ("rejected", "applied"), "applied": (), "rejected": ()}
#: Statuses whose rules get a new version when they are mined again.
VERSIONED = ("adopted", "applied", "rejected")


class InvalidStatusTransition(ValueError):
    def __init__(self, rule_id: str, current: str, target: str):
        super().__init__(f"{rule_id}: {current} cannot become {target}")
        self.rule_id, self.current, self.target = rule_id, current, target


def upsert(rules: DataFrame, mined: DataFrame) -> DataFrame:
    """rules with the metrics of mined: known ones keep their status, and rise a version once decided on."""
    old = rules.select("rule_id", F.col("status").alias("old_status"), F.col("version").alias("old_version"))
    version = F.when(F.col("old_version").isNull(), F.lit(1)).when(F.col("old_status").isin(*VERSIONED), F.col("old_version") + 1).otherwise(F.col("old_version"))
    fresh = mined.join(old, "rule_id", "left").withColumns({"status": F.coalesce("old_status", "status"), "version": version.cast("long")})
    return rules.join(mined.select("rule_id"), "rule_id", "left_anti").unionByName(fresh.select(*rules.columns))


def listed(rules: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    found = rules if status is None else rules.where(F.col("status") == status)
    return found.orderBy(F.desc("pca_confidence"), F.desc("support"), "rule_id").limit(limit)


def by_relations(rules: DataFrame, relations: Sequence[str]) -> DataFrame:
    """Rules whose body or head holds one of the relations."""
    wanted = F.array(*[F.lit(r) for r in relations]) if relations else F.array().cast("array<string>")
    return rules.where(F.arrays_overlap("body_relations", wanted) | F.array_contains(wanted, F.col("head_relation")))


def by_ids(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids.select("rule_id"), "rule_id", "left_semi")


def relation_index(rules: DataFrame) -> DataFrame:
    """(relation, rule_id) of all relations that a rule involves."""
    return rules.select("rule_id", F.explode(F.array_union("body_relations", F.array("head_relation"))).alias("relation")).select("relation", "rule_id")


def status_of(rules: DataFrame, rule_id: str) -> str | None:
    row = rules.where(F.col("rule_id") == rule_id).select("status").first()
    return row and row["status"]


def with_status(rules: DataFrame, ids: Sequence[str], status: str, bump: bool = False) -> DataFrame:
    """The rules of ids with the status, whatever they had."""
    own = F.col("rule_id").isin(*ids)
    return rules.withColumns({"status": F.when(own, F.lit(status)).otherwise(F.col("status")), "version": F.when(own & F.lit(bump), F.col("version") + 1).otherwise(F.col("version"))})


def transition(rules: DataFrame, rule_id: str, target: str) -> DataFrame:
    """One rule moved to target. KeyError if it is unknown, InvalidStatusTransition if its status forbids it."""
    current = status_of(rules, rule_id)
    if current is None:
        raise KeyError(rule_id)
    if target not in TRANSITIONS[current]:
        raise InvalidStatusTransition(rule_id, current, target)
    return with_status(rules, [rule_id], target)


def outcomes(statuses: DataFrame) -> DataFrame:
    """(status, target, allowed) for each status row and each target."""
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]).cast("array<string>"))])
    targets = F.explode(F.array(F.lit("adopted"), F.lit("rejected"), F.lit("applied"))).alias("target")
    return statuses.select("status", targets).withColumn("allowed", F.array_contains(allowed[F.col("status")], F.col("target")))
