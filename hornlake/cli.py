"""Command line over an engine folder: health, load, mine, consume, infer, rules, append, capture, conflicts, cases."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from .functions.names import parse_conflict_pairs, parse_context, parse_edges
from .operators.rules import TRANSITIONS, InvalidStatusTransition
from .schema import InferenceConfig, MiningConfig


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hornlake")
    top.add_argument("--root", required=True, help="folder of the engine's tables")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("health")
    load = sub.add_parser("load")
    load.add_argument("edges", help="Parquet table with eid, src, rel, dst")
    for name in ("mine", "consume"):
        cmd = sub.add_parser(name)
        cmd.add_argument("--body-length", type=int, default=2)
        cmd.add_argument("--min-support", type=int, default=5)
        cmd.add_argument("--min-confidence", type=float, default=0.1)
        cmd.add_argument("--min-coverage", type=float, default=0.0)
        cmd.add_argument("--limit", type=int, default=100)
        cmd.add_argument("--candidate-limit", type=int)
        cmd.add_argument("--beam-width", type=int)
        cmd.add_argument("--head-budget", type=int)
        cmd.add_argument("--confidence-ub-weight", type=float, default=0.0)
        cmd.add_argument("--all-facts", action="store_true", help="mine inferred edges too")
        cmd.add_argument("--changed", action="append", default=[])
        if name == "consume":
            cmd.add_argument("--change-limit", type=int, default=2000)
    run = sub.add_parser("infer")
    run.add_argument("--fixpoint", action="store_true")
    run.add_argument("--max-iterations", type=int, default=5)
    run.add_argument("--limit-rules", type=int, default=100)
    run.add_argument("--no-conflicts", action="store_true")
    run.add_argument("--conflicts", default="", help="a:b,c:d")
    rules = sub.add_parser("rules")
    rules.add_argument("action", choices=("list", "adopt", "reject", "stats"))
    rules.add_argument("rule_id", nargs="?")
    rules.add_argument("--status", choices=sorted(TRANSITIONS))
    rules.add_argument("--limit", type=int, default=100)
    changes = sub.add_parser("append")
    changes.add_argument("--add", action="append", default=[], help="src,rel,dst")
    changes.add_argument("--remove", action="append", default=[], help="src,rel,dst")
    changes.add_argument("--source", default="cli")
    changes.add_argument("--batch-id")
    changes.add_argument("--idempotency-key")
    changes.add_argument("--context", action="append", default=[], help="key=value")
    capture = sub.add_parser("capture", help="log how two edge tables differ")
    capture.add_argument("old", help="Parquet table with eid, src, rel, dst")
    capture.add_argument("new", help="Parquet table with eid, src, rel, dst")
    pairs = sub.add_parser("conflicts")
    pairs.add_argument("action", choices=("list", "add", "delete", "replace"))
    pairs.add_argument("pairs", nargs="?", default="", help="a:b,c:d")
    cases = sub.add_parser("cases")
    cases.add_argument("--limit", type=int, default=100)
    return top


def _mining(args) -> MiningConfig:
    return MiningConfig(
        body_length=args.body_length, min_support=args.min_support, min_pca_confidence=args.min_confidence, min_head_coverage=args.min_coverage, top_k=args.limit,
        candidate_limit=args.candidate_limit or max(20 * args.limit, 100), beam_width=args.beam_width, head_budget_per_relation=args.head_budget,
        confidence_ub_weight=args.confidence_ub_weight, factual_only=not args.all_facts,
    )


def _rows(df) -> list:
    return [json.loads(x) for x in df.toJSON().collect()]


def _consumed(run) -> dict:
    return {"processed_changes": run.processed, "cursor": run.cursor, "affected_relations": run.affected, "rules": _rows(run.mined)}


def _inferred(done) -> dict:
    return {"iterations_run": done.rounds, "total_created": done.total_created, "total_conflicts": done.conflicts, "results": _rows(done.results)}


def call(args) -> Callable:
    """What args ask of an engine, as a function of it; ValueError if they make no sense."""
    command = args.command
    if command == "health":
        return lambda engine: engine.health()
    if command == "load":
        return lambda engine: (engine.load(engine.spark.read.parquet(args.edges)), engine.health())[1]
    if command == "mine":
        mining = _mining(args)
        if args.changed:
            mining = MiningConfig(**vars(mining) | {"changed_relations": tuple(args.changed)})
        return lambda engine: _rows(engine.mine(mining))
    if command == "consume":
        mining = _mining(args)
        return lambda engine: _consumed(engine.consume_changelog(mining, change_limit=args.change_limit, hints=tuple(args.changed)))
    if command == "infer":
        config = InferenceConfig(fixpoint=args.fixpoint, max_iterations=args.max_iterations, limit_rules=args.limit_rules, check_conflicts=not args.no_conflicts)
        pairs = parse_conflict_pairs(args.conflicts)
        return lambda engine: _inferred(engine.infer(config, pairs))
    if command == "rules":
        if args.action == "list":
            return lambda engine: _rows(engine.rules(args.status, args.limit))
        if not args.rule_id:
            raise ValueError("a rule id is needed")
        if args.action == "stats":
            return lambda engine: engine.rule_stat(args.rule_id)
        return lambda engine: ((engine.adopt if args.action == "adopt" else engine.reject)(args.rule_id), {"rule_id": args.rule_id, "action": args.action})[1]
    if command == "capture":
        return lambda engine: {"last_sequence": engine.capture_diff(engine.spark.read.parquet(args.old), engine.spark.read.parquet(args.new))}
    if command == "cases":
        return lambda engine: _rows(engine.conflict_cases(args.limit))
    if command == "conflicts":
        return _conflicts(args.action, parse_conflict_pairs(args.pairs))
    added, removed, context = parse_edges(args.add), parse_edges(args.remove), parse_context(args.context)
    options = {"source": args.source, "batch_id": args.batch_id, "idempotency_key": args.idempotency_key, "metadata": context}
    return lambda engine: {"last_sequence": engine.append_changes(added, removed, **options)}


def _conflicts(action: str, pairs: dict[str, set[str]]) -> Callable:
    each = [(head, relation) for head in sorted(pairs) for relation in sorted(pairs[head])]
    if action in ("add", "delete") and not each:
        raise ValueError("pairs are needed")

    def run(engine):
        if action == "replace":
            engine.replace_conflicts(pairs)
        for head, relation in each if action in ("add", "delete") else ():
            (engine.add_conflict if action == "add" else engine.delete_conflict)(head, relation)
        return _rows(engine.conflicts())

    return run


def main(argv=None, engine=None) -> int:
    """0, 1 if the call failed, 2 if the arguments are wrong; wrong ones are refused before a session starts."""
    args = parser().parse_args(argv)
    try:
        asked = call(args)
        if engine is None:
            from pyspark.sql import SparkSession

            from .engine import Engine

            engine = Engine(SparkSession.builder.appName("hornlake").getOrCreate(), args.root)
        print(json.dumps(asked(engine), ensure_ascii=False, sort_keys=True, default=str))
    except (KeyError, InvalidStatusTransition) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
