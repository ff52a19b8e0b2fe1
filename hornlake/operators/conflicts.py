"""Conflicting relations, and the cases in which inference meets them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import plain_relation
from ..schema import CONFLICT_RULE_DDL


def pair_table(spark: SparkSession, pairs: Mapping[str, set[str]], now) -> DataFrame:
    """conflict_rules of {head: relations}; names are cleaned, blank ones left out."""
    clean = {(plain_relation(h), plain_relation(r)) for h, rels in pairs.items() for r in rels}
    return spark.createDataFrame([(h, r, now, now) for h, r in sorted(clean) if h and r], CONFLICT_RULE_DDL)


def upsert_pair(table: DataFrame, head: str, relation: str, now) -> DataFrame:
    """table with the pair; a known one keeps its time of creation."""
    fresh = pair_table(table.sparkSession, {head: {relation}}, now)
    old = table.select("head_relation", "conflict_relation", F.col("created_at").alias("since"))
    kept = fresh.join(old, ["head_relation", "conflict_relation"], "left").withColumn("created_at", F.coalesce("since", "created_at")).drop("since")
    return table.join(fresh, ["head_relation", "conflict_relation"], "left_anti").unionByName(kept)


def delete_pair(table: DataFrame, head: str, relation: str) -> DataFrame:
    """table without the pair; KeyError if it is not there."""
    own = (F.col("head_relation") == plain_relation(head)) & (F.col("conflict_relation") == plain_relation(relation))
    if table.where(own).isEmpty():
        raise KeyError((head, relation))
    return table.where(~own)


def pairs(table: DataFrame) -> DataFrame:
    """(head_relation, conflict_relations sorted)."""
    return table.groupBy("head_relation").agg(F.sort_array(F.collect_set("conflict_relation")).alias("conflict_relations")).orderBy("head_relation")


def as_mapping(table: DataFrame) -> dict[str, set[str]]:
    return {row["head_relation"]: set(row["conflict_relations"]) for row in pairs(table).collect()}


def meetings(walks: DataFrame, facts: DataFrame, head: str, relations) -> DataFrame:
    """(x, y, conflicting_relation): ends of a body that the head does not join yet and a conflicting relation does."""
    heads = facts.where(F.col("rel") == head).select(F.col("src").alias("x"), F.col("dst").alias("y")).distinct()
    against = facts.where(F.col("rel").isin(*sorted(relations))).select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("rel").alias("conflicting_relation")).distinct()
    return walks.join(heads, ["x", "y"], "left_anti").join(against, ["x", "y"])


def against_pairs(relations: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(x, y, conflicting_relation): distinct ends of each relation's edges."""
    found = None
    for rel, edges in relations:
        own = edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(rel).alias("conflicting_relation")).distinct()
        found = own if found is None else found.unionByName(own)
    return found


def record(cases: DataFrame, met: DataFrame, rule_id: str, head: str, iteration: int, now) -> DataFrame:
    """cases with those met; a known case counts again only in another iteration than its last."""
    key = ["rule_id", "inferred_relation", "conflicting_relation", "source_x", "source_y"]
    fresh = met.select(F.lit(rule_id).alias("rule_id"), F.lit(head).alias("inferred_relation"), "conflicting_relation", F.col("x").alias("source_x"), F.col("y").alias("source_y")).withColumn("met", F.lit(True))
    joined = cases.join(fresh, key, "full_outer")
    met_now, at = F.col("met").isNotNull(), F.lit(now).cast("timestamp")
    again = met_now & (F.col("last_iteration") != iteration)
    return joined.select(
        *key,
        F.when(F.col("detect_count").isNull(), F.lit(1)).when(again, F.col("detect_count") + 1).otherwise(F.col("detect_count")).cast("long").alias("detect_count"),
        F.coalesce("first_iteration", F.lit(iteration).cast("long")).alias("first_iteration"),
        F.when(met_now, F.lit(iteration)).otherwise(F.col("last_iteration")).cast("long").alias("last_iteration"),
        F.coalesce("created_at", at).alias("created_at"), F.when(met_now, at).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def latest(cases: DataFrame, limit: int = 100, rule_id: str | None = None) -> DataFrame:
    """The limit cases met last, of one rule or of all."""
    return (cases if rule_id is None else cases.where(F.col("rule_id") == rule_id)).orderBy(F.desc("updated_at"), F.desc("detect_count"), "rule_id", "source_x", "source_y").limit(limit)
