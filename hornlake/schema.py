"""Schemas of the tables and validated settings of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

EDGE_DDL = "eid long, src string, rel string, dst string, is_inferred boolean, source_rule_id string, rule_confidence double, inferred_at timestamp"
RULE_DDL = "rule_id string, body_relations array<string>, head_relation string, support long, pca_confidence double, head_coverage double, status string, version long, rule_text string"
STAT_DDL = "rule_id string, support long, pca_denominator long, head_count long"
CONFLICT_RULE_DDL = "head_relation string, conflict_relation string, created_at timestamp, updated_at timestamp"
CASE_DDL = "rule_id string, inferred_relation string, conflicting_relation string, source_x string, source_y string, detect_count long, first_iteration long, last_iteration long, created_at timestamp, updated_at timestamp"
CHANGE_DDL = "change_seq long, event_type string, src string, rel string, dst string, source string, batch_id string, idempotency_key string, metadata string, dedup_key string, created_at timestamp"
RESULT_DDL = "rule_id string, created_triples long, conflict_triples long, iteration long"


def _within(name: str, value, low, high) -> None:
    if value is not None and not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}, not {value}")


@dataclass(frozen=True)
class MiningConfig:
    """What to mine. changed_relations restricts bodies to those that hold one of them; None mines all."""

    body_length: int = 2
    min_support: int = 5
    min_pca_confidence: float = 0.1
    min_head_coverage: float = 0.0
    top_k: int = 100
    candidate_limit: int = 2000
    factual_only: bool = True
    beam_width: int | None = None
    head_budget_per_relation: int | None = None
    confidence_ub_weight: float = 0.0
    changed_relations: tuple[str, ...] | None = None
    prune_redundant: bool = True
    prune_non_improving: bool = True
    strict_prefixes: bool = False
    heads_per_body: int = 50

    def __post_init__(self) -> None:
        _within("body_length", self.body_length, 2, 5)
        _within("min_support", self.min_support, 0, 1 << 62)
        _within("top_k", self.top_k, 1, 10_000)
        for name in ("min_pca_confidence", "min_head_coverage", "confidence_ub_weight"):
            _within(name, getattr(self, name), 0.0, 1.0)
        for name in ("candidate_limit", "beam_width", "head_budget_per_relation"):
            _within(name, getattr(self, name), 1, 50_000)


@dataclass(frozen=True)
class InferenceConfig:
    limit_rules: int = 100
    max_iterations: int = 5
    fixpoint: bool = False
    check_conflicts: bool = True
    legacy_case_lengths: bool = False

    def __post_init__(self) -> None:
        _within("limit_rules", self.limit_rules, 1, 10_000)
        _within("max_iterations", self.max_iterations, 1, 100)


@dataclass(frozen=True)
class Settings:
    """Defaults that the environment may override."""

    min_support: int = 5
    min_confidence: float = 0.1
    conflict_pairs: dict[str, set[str]] = field(default_factory=dict)

    @classmethod
    def from_environment(cls, env=None) -> Settings:
        from .functions.names import parse_conflict_pairs

        env = os.environ if env is None else env
        return cls(int(env.get("MIN_SUPPORT", 5)), float(env.get("MIN_CONFIDENCE", 0.1)), parse_conflict_pairs(env.get("CONFLICT_RELATION_PAIRS", "")))
