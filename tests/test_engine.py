"""The engine against brute force, golden rules of a small graph, and the contracts of its state tables."""

import itertools
import json
import os
import random
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hornlake import cli
from hornlake.engine import Engine
from hornlake.functions import names
from hornlake.operators import changelog, conflicts, rules
from hornlake.operators.infer import infer
from hornlake.plans import paths as paths_module
from hornlake.plans import prune
from hornlake.plans.metrics import candidates, rule_metrics
from hornlake.plans.mine import collisions, mine
from hornlake.plans.paths import Codes, allowed, body_supports, joinable, one_path, paths, repeating
from hornlake.schema import CASE_DDL, CHANGE_DDL, RULE_DDL, InferenceConfig, MiningConfig, Settings
from hornlake.sources.graph import ORDERS, load_edges, load_nodes, project, synthetic
from hornlake.sources.store import Store
from hornlake.streaming.changes import change_stream, on_changes, relation_activity

EDGES = "eid long, src string, rel string, dst string"
NOW = datetime(2024, 5, 1)
SAMPLE = [
    (1, "alice", "bornIn", "beijing"), (2, "bob", "bornIn", "shanghai"), (3, "beijing", "locatedIn", "china"), (4, "shanghai", "locatedIn", "china"),
    (5, "china", "partOf", "asia"), (6, "alice", "nationality", "china"), (7, "alice", "region", "asia"), (8, "bob", "noNationality", "china"),
]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(SAMPLE, EDGES).persist()


def _rules(spark, *rows, status="adopted"):
    full = [(f"id{i}", list(b), h, s, c, 0.5, status, 1, "") for i, (b, h, s, c) in enumerate(rows)]
    df = spark.createDataFrame(full, RULE_DDL)
    return df.withColumn("rule_id", names.rule_id(F.col("body_relations"), F.col("head_relation")))


def _walks(edges, n):
    """{(body, x, y)} of walks over n different edges."""
    by_src = defaultdict(list)
    for e in edges:
        by_src[e[1]].append(e)
    found = set()

    def go(used, x, at):
        if len(used) == n:
            found.add((tuple(e[2] for e in used), x, at))
            return
        for e in by_src[at]:
            if all(e[0] != u[0] for u in used):
                go([*used, e], x, e[3])

    for e in edges:
        go([e], e[1], e[3])
    return found


def _random_graph(seed, nodes=6, rels=3, edges=16):
    rng = random.Random(seed)
    return [(i, f"v{rng.randrange(nodes)}", f"r{rng.randrange(rels)}", f"v{rng.randrange(nodes)}") for i in range(edges)]


@pytest.mark.parametrize("n,seed,nodes,rels,size", [(2, 1, 5, 2, 14), (2, 2, 3, 1, 8), (3, 3, 5, 3, 14), (3, 4, 4, 2, 10), (4, 5, 5, 3, 10), (5, 6, 5, 5, 9)])
def test_paths_and_scores_on_multigraphs(spark, n, seed, nodes, rels, size):
    edges = _random_graph(seed, nodes, rels, size)
    df = spark.createDataFrame(edges, EDGES)
    want = _walks(edges, n)
    walks = paths(df, n).hold()
    got = [(tuple(r.body), r.x, r.y) for r in walks.ends().collect()]
    assert set(got) == want and len(got) == len(want)
    support, denominator = Counter(), Counter()
    heads, starts = {(s, r, d) for _, s, r, d in edges}, {(s, r) for _, s, r, _ in edges}
    for body, x, y in want:
        for r in {e[2] for e in edges}:
            support[body, r] += (x, r, y) in heads
            denominator[body, r] += (x, r) in starts
    scored = {(tuple(r.body), r["head"]): (r.support, r.pca_denominator) for r in candidates(walks).collect()}
    assert scored == {k: (s, denominator[k]) for k, s in support.items() if s}
    body, head = next(iter(scored))
    row = rule_metrics(df, body, head).first()
    assert (row.support, row.pca_denominator, row.head_count) == (*scored[body, head], sum(e[2] == head for e in edges))
    assert {(r.x, r.y) for r in one_path(df, body).collect()} == {(x, y) for b, x, y in want if b == body}


@pytest.mark.parametrize("n,slice_rows,most_ends", [(2, 1 << 25, 1 << 22), (2, 13, 1 << 22), (3, 13, 1 << 22), (3, 13, 2)])
def test_tallies_of_layered_graphs(spark, monkeypatch, n, slice_rows, most_ends):
    """Counts come from arrays beside their sources, in slices, and equal those of the walks one by one."""
    monkeypatch.setattr(paths_module, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(paths_module, "MOST_ENDS", most_ends)
    rng = random.Random(n)
    steps = [(0, 1), (0, 1), (1, 2), (1, 2), (2, 3), (0, 2), (0, 3), (1, 3), (0, 2)]
    edges = [(i, f"l{a}v{rng.randrange(5)}", f"r{k}", f"l{b}v{rng.randrange(7)}") for i, (k, (a, b)) in enumerate(rng.choices(list(enumerate(steps)), k=70))]
    edges.append((70, "l0v0", "r0", "l1v0"))
    edges.append((71, "l0v0", "r0", "l1v0"))  # parallel
    walks = paths(spark.createDataFrame(edges, EDGES), n)
    assert (walks.tally is None) == (most_ends == 2)
    want = _walks(edges, n)
    assert {tuple(r.body): r.body_support for r in body_supports(walks).collect()} == Counter(body for body, _, _ in want)
    heads, starts = {(s, r, d) for _, s, r, d in edges}, {(s, r) for _, s, r, _ in edges}
    support = Counter((body, r) for body, x, y in want for r in {e[2] for e in edges} if (x, r, y) in heads)
    expected = {(body, r): (c, sum(b == body and (x, r) in starts for b, x, _ in want)) for (body, r), c in support.items()}
    assert {(tuple(r.body), r["head"]): (r.support, r.pca_denominator) for r in candidates(walks).collect()} == expected and expected
    some = walks.only(body_supports(walks).orderBy("body").limit(1))
    assert {tuple(r.body) for r in body_supports(some).collect()} == {min(body for body, _, _ in want)}
    walks.graph.release()


@pytest.mark.parametrize("name", ["dedup_signature", "rule_list", "mine3", "relation_index", "rules_by_relation", "rule_text_id", "head_budget", "ub_prune_w0", "ub_prune_w1"])
def test_queries_without_a_row_for_each_pair_of_ends(spark, monkeypatch, name):
    import __spark_entry__ as entry

    def refuse(*_):
        raise AssertionError("walks as rows")

    monkeypatch.setattr(paths_module, "_simple", refuse)
    monkeypatch.setattr(paths_module, "_repeated", refuse)
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("name", ["head_budget", "mine3", "relation_index", "rule_list", "rule_text_id", "rules_by_relation", "ub_prune_w0", "ub_prune_w1"])
def test_queries_count_numbered_nodes_in_one_aggregate(spark, monkeypatch, name):
    import __spark_entry__ as entry

    def refuse(*_):
        raise AssertionError("nodes as text, or heads joined to sets")

    monkeypatch.setattr(paths_module, "_numbers", refuse)
    monkeypatch.setattr(paths_module, "_counts", refuse)
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("n,columns", [(2, 100), (3, 100), (3, 0)])
def test_numbered_nodes_give_the_counts_of_text(spark, monkeypatch, n, columns):
    found = []
    for coded in (False, True):
        monkeypatch.setattr(paths_module, "MOST_COLUMNS", columns if coded else 100)
        walks = paths(project(spark, "/root/testdata/sf0.001", ORDERS, coded), n)
        found.append((sorted(map(str, body_supports(walks).drop("code").collect())), sorted(map(str, candidates(walks).collect()))))
        walks.graph.release()
    assert found[0] == found[1] and all(found[0])


def test_repeating_relations():
    assert repeating({"a": {"b"}, "b": {"c"}}, 5) == set()
    assert repeating({"a": {"a"}}, 2) == {"a"}
    assert repeating({"a": {"b"}, "b": {"a", "c"}, "d": {"a"}}, 3) == {"a", "b", "c", "d"}
    assert repeating({"a": {"b"}, "b": {"a"}}, 2) == set()


def test_golden_rules(graph):
    assert joinable(graph)["bornIn"] == {"locatedIn"}
    found = {r.rule_id: r for r in mine(graph, MiningConfig(min_support=1)).collect()}
    assert {k: (r.support, r.pca_confidence, r.head_coverage) for k, r in found.items()} == {
        "rule__bornin__locatedin__to__nationality": (1, 1.0, 1.0),
        "rule__bornin__locatedin__to__nonationality": (1, 1.0, 1.0),
        "rule__nationality__partof__to__region": (1, 1.0, 1.0),
    }
    assert found["rule__nationality__partof__to__region"].rule_text == "nationality(X,Z) ∧ partOf(Z,Y) -> region(X,Y)"
    assert mine(graph, MiningConfig(body_length=3, min_support=1)).count() == 0
    longer = mine(graph, MiningConfig(body_length=3, min_support=1, prune_non_improving=False)).collect()
    assert [(r.rule_id, r.support) for r in longer] == [("rule__bornin__locatedin__partof__to__region", 1)]
    assert longer[0].rule_text == "bornIn(X,Z1) ∧ locatedIn(Z1,Z2) ∧ partOf(Z2,Y) -> region(X,Y)"
    only = mine(graph, MiningConfig(min_support=1, changed_relations=(" `partOf` ",))).collect()
    assert [r.rule_id for r in only] == ["rule__nationality__partof__to__region"]
    assert mine(graph, MiningConfig(changed_relations=(" ",))).count() == 0


def test_no_prefix_left_restricts_nothing(graph):
    loose = MiningConfig(body_length=3, min_support=3, prune_non_improving=False)
    assert mine(graph, loose).count() == 0
    pairs = prune.by_support(body_supports(paths(graph, 2)), 3)
    assert pairs.isEmpty()
    assert paths(graph, 3, prefixes=pairs).df.isEmpty() and not paths(graph, 3).df.isEmpty()


def test_factual_only(spark, graph):
    marked = graph.withColumn("is_inferred", F.when(F.col("eid") == 6, True))
    assert mine(marked, MiningConfig(min_support=1)).where("head_relation = 'nationality'").count() == 0
    assert mine(marked, MiningConfig(min_support=1, factual_only=False)).where("head_relation = 'nationality'").count() == 1


def _bodies(spark, *rows):
    return spark.createDataFrame([(list(b), s) for b, s in rows], "body array<string>, body_support long")


def _cands(spark, *rows):
    return spark.createDataFrame([(list(b), h, s, d) for b, h, s, d in rows], "body array<string>, head string, support long, pca_denominator long")


def _set(df):
    return {tuple(r.body) for r in df.collect()}


def test_prunes(spark):
    pairs = _bodies(spark, (("bornIn", "locatedIn"), 3), (("bornIn", "locatedInX"), 3), (("low", "support"), 1))
    assert _set(prune.by_support(pairs, 2)) == {("bornIn", "locatedIn"), ("bornIn", "locatedInX")}
    assert _set(prune.redundant(pairs)) == {("bornIn", "locatedIn"), ("low", "support")}
    triples = _bodies(spark, (("bornIn", "locatedIn", "a"), 3), (("bornIn", "locatedIn", "b"), 2), (("new", "pair", "c"), 9))
    assert _set(prune.non_improving(triples, pairs)) == {("bornIn", "locatedIn", "b"), ("new", "pair", "c")}
    functional = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "rel string, functionality double")
    some = _bodies(spark, (("a", "b"), 5), (("b", "b"), 5), (("a", "c"), 4), (("c", "c"), 3))
    assert _set(prune.beam(some, functional, 2, 2)) == {("a", "b"), ("b", "b")} and prune.beam(some, functional, 2, None) is some
    assert [tuple(r.body) for r in prune.ranked_by_functionality(some, functional, 2).orderBy("place").collect()] == [("a", "b"), ("a", "c"), ("b", "b"), ("c", "c")]


def test_candidate_prunes(spark):
    budget = _cands(spark, (("a", "b"), "h1", 3, 3), (("a", "c"), "h1", 2, 2), (("d", "e"), "h2", 1, 1))
    assert _set(prune.head_budget(budget, 1)) == {("a", "b"), ("d", "e")}
    bound = _cands(spark, (("a", "b"), "h", 10, 10), (("c", "d"), "h", 2, 20))
    assert prune.confidence_bound(bound, 0.2).count() == 1 and prune.confidence_bound(bound, 0.2, 1.0).count() == 0
    twins = _cands(spark, (("A ", "`b`"), "h", 1, 2), (("a", "b"), "H", 3, 4))
    assert [r.support for r in prune.dedup(twins).collect()] == [3]


def test_names(spark):
    row = spark.createDataFrame([(["Has Part", "été", "_x_"], "Head-Of")], "b array<string>, h string").select(names.rule_id(F.col("b"), F.col("h"))).first()
    assert row[0] == "rule__has_part__t__x__to__head_of"
    assert names.parse_conflict_pairs("a:b, `c`:d,bad,:x,a:e") == {"a": {"b", "e"}, "c": {"d"}}
    assert names.parse_edges(["a, r ,b", " "]) == [("a", "r", "b")] and names.parse_context(["k=v=w"]) == {"k": "v=w"}
    for bad in (lambda: names.parse_edges(["a,b"]), lambda: names.parse_context(["k"])):
        with pytest.raises(ValueError):
            bad()
    assert names.metadata_json({"b": 1, "a": "é"}) == '{"a": "\\u00e9", "b": 1}'
    assert Settings.from_environment({"MIN_SUPPORT": "7", "CONFLICT_RELATION_PAIRS": "a:b"}) == Settings(7, 0.1, {"a": {"b"}})


@pytest.mark.parametrize("bad", [{"body_length": 6}, {"top_k": 0}, {"min_pca_confidence": 1.5}, {"beam_width": 0}, {"candidate_limit": 50_001}])
def test_config_ranges(bad):
    with pytest.raises(ValueError):
        MiningConfig(**bad)


def test_life_cycle(spark):
    allowed = {(r.status, r.target): r.allowed for r in rules.outcomes(spark.createDataFrame([(s,) for s in rules.TRANSITIONS], "status string")).collect()}
    for status, target in itertools.product(rules.TRANSITIONS, ("adopted", "rejected", "applied")):
        table = _rules(spark, (("a", "b"), "h", 1, 1.0), status=status)
        rule_id = table.first().rule_id
        if allowed[status, target]:
            assert rules.status_of(rules.transition(table, rule_id, target), rule_id) == target
        else:
            with pytest.raises(rules.InvalidStatusTransition):
                rules.transition(table, rule_id, target)
    with pytest.raises(KeyError):
        rules.transition(table, "none", "adopted")


def test_upsert_and_lookups(spark):
    known = _rules(spark, (("a", "b"), "h", 1, 0.1), (("c", "d"), "k", 1, 0.2))
    known = known.withColumn("status", F.when(F.col("head_relation") == "k", "discovered").otherwise("rejected"))
    mined = _rules(spark, (("a", "b"), "h", 5, 0.9), (("c", "d"), "k", 6, 0.8), (("e", "f"), "m", 7, 0.7), status="discovered")
    got = {r.head_relation: (r.status, r.version, r.support) for r in rules.upsert(known, mined).collect()}
    assert got == {"h": ("rejected", 2, 5), "k": ("discovered", 1, 6), "m": ("discovered", 1, 7)}
    assert {r.head_relation for r in rules.by_relations(mined, ["b", "m"]).collect()} == {"h", "m"} and rules.by_relations(mined, []).count() == 0
    assert [r.head_relation for r in rules.listed(mined, "discovered", 2).collect()] == ["h", "k"]
    assert rules.relation_index(mined).count() == 9 and rules.by_ids(mined, known).count() == 2
    clash = _rules(spark, (("has-part", "b"), "h", 1, 1.0), (("has_part", "b"), "h", 1, 1.0))
    assert collisions(clash).count() == 1


RULES = ((("bornIn", "locatedIn"), "nationality", 2, 0.9), (("nationality", "partOf"), "region", 1, 0.8))


def test_inference_on_the_sample(spark, graph):
    table = _rules(spark, *RULES)
    once = infer(graph, table, conflicts={"nationality": {"noNationality"}}, now=NOW)
    assert {(r.src, r.rel, r.dst) for r in once.created.collect()} == {("bob", "nationality", "china"), ("bob", "region", "asia")}
    assert all(r.is_inferred and r.inferred_at == NOW and r.rule_confidence in (0.9, 0.8) for r in once.created.collect())
    assert (once.rounds, once.conflicts) == (1, 1) and {r.status for r in once.rules.collect()} == {"applied"} and {r.version for r in once.rules.collect()} == {2}
    case = once.cases.first()
    assert (case.source_x, case.source_y, case.detect_count, case.last_iteration) == ("bob", "china", 1, 1)
    full = infer(graph, table, InferenceConfig(fixpoint=True))
    assert full.rounds == 2 and [(r.created_triples, r.iteration) for r in full.results.orderBy("iteration", F.desc("created_triples")).collect()] == [(1, 1), (1, 1), (0, 2), (0, 2)]
    backwards = _rules(spark, RULES[0][:3] + (0.7,), RULES[1])
    assert infer(graph, backwards, InferenceConfig(fixpoint=True)).rounds == 3
    silent = infer(graph, table, InferenceConfig(check_conflicts=False), conflicts={"nationality": {"noNationality"}})
    assert silent.conflicts == 0 and silent.cases.count() == 1
    assert infer(graph, table.limit(0)).rounds == 0


@pytest.mark.parametrize("seed", [11, 12])
def test_fixpoint_is_the_closure(spark, seed):
    edges = _random_graph(seed, 5, 3, 8)
    todo = [(("r0", "r1"), "r2", 3, 0.9), (("r2", "r2"), "r0", 2, 0.8), (("r1", "r0", "r2"), "r1", 1, 0.7)]
    got = infer(spark.createDataFrame(edges, EDGES), _rules(spark, *todo), InferenceConfig(fixpoint=True, max_iterations=30))
    facts, counts, rounds = list(edges), [], 0
    while True:
        rounds += 1
        made_here = 0
        for body, head, *_ in todo:
            have = {(s, d) for _, s, r, d in facts if r == head}
            new = sorted({(x, y) for b, x, y in _walks(facts, len(body)) if b == body} - have)
            facts += [(len(facts) + 100 + i, x, head, y) for i, (x, y) in enumerate(new)]
            counts.append((head, rounds, len(new)))
            made_here += len(new)
        if not made_here:
            break
    assert {(r.src, r.rel, r.dst) for r in got.created.collect()} == {e[1:] for e in facts[len(edges) :]}
    heads = {r.rule_id: r.head_relation for r in _rules(spark, *todo).collect()}
    assert sorted((heads[r.rule_id], r.iteration, r.created_triples) for r in got.results.collect()) == sorted(counts) and got.rounds == rounds


def test_conflict_tables(spark):
    table = conflicts.pair_table(spark, {"a": {"`b`", " "}, "c": {"d"}}, NOW)
    assert conflicts.as_mapping(table) == {"a": {"b"}, "c": {"d"}}
    later = datetime(2024, 6, 1)
    table = conflicts.upsert_pair(conflicts.upsert_pair(table, "a", "b", later), "a", "x", later)
    assert {(r.conflict_relation, r.created_at, r.updated_at) for r in table.where("head_relation = 'a'").collect()} == {("b", NOW, later), ("x", later, later)}
    assert conflicts.as_mapping(conflicts.delete_pair(table, "a", "b")) == {"a": {"x"}, "c": {"d"}}
    with pytest.raises(KeyError):
        conflicts.delete_pair(table, "a", "none")
    cases, met = spark.createDataFrame([], CASE_DDL), spark.createDataFrame([("x", "y", "n")], "x string, y string, conflicting_relation string")
    seen = []
    for iteration in (1, 1, 2, 1):
        cases = conflicts.record(cases, met, "id", "h", iteration, NOW)
        row = cases.first()
        seen.append((row.detect_count, row.first_iteration, row.last_iteration))
    assert seen == [(1, 1, 1), (1, 1, 1), (2, 1, 2), (3, 1, 1)] and conflicts.latest(cases).count() == 1


def _fold(ops):
    state = None
    for op in ops:
        if state == "added" and op == "removed":
            state = None
        else:
            state = op
    return state or "cancelled"


def test_fold_of_all_short_histories(spark):
    rows, want = [], {}
    for n in range(1, 8):
        for ops in itertools.product(("added", "removed"), repeat=n):
            key = "".join(o[0] for o in ops)
            want[key] = _fold(ops)
            rows += [(key, "r", "d", op, i) for i, op in enumerate(ops)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "src string, rel string, dst string, event_type string, change_seq long")
    assert {r.src: r.state for r in changelog.folded(df).collect()} == want
    assert {r.op for r in changelog.delta(df).collect()} == {"added", "removed"}


def _changes(spark, *rows, batch="b"):
    full = [(*r, "api", batch, None, i, "{}", NOW) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "event_type string, src string, rel string, dst string, source string, batch_id string, idempotency_key string, position long, metadata string, created_at timestamp")


def test_append_dedups_and_keeps_gaps(spark):
    log = spark.createDataFrame([], CHANGE_DDL)
    log = log.unionByName(changelog.append(log, _changes(spark, ("added", "a", "r", "b"), ("removed", "a", "r", "c"))))
    again = changelog.append(log, _changes(spark, ("added", "a", "r", "b"), ("added", "n", "r", "m")), 2)
    assert [(r.change_seq, r.src) for r in again.collect()] == [(4, "n")]
    assert log.orderBy("change_seq").first().dedup_key == "api|b||added|a|r|b|0"
    late = log.unionByName(again.withColumns({"change_seq": F.lit(None).cast("long"), "dedup_key": F.lit("t")}))
    assert sorted(r.change_seq for r in changelog.sequenced(late).collect()) == [1, 2, 3]
    assert [r.change_seq for r in changelog.pending(log, 1, 5).collect()] == [2]


def test_engine_end_to_end(spark, graph, tmp_path):
    engine = Engine(spark, str(tmp_path / "engine"), Settings(1, 0.1, {"nationality": {"noNationality"}}), clock=lambda: NOW)
    engine.bootstrap()
    engine.load(graph)
    assert engine.mine().count() == 3 and set(engine.health()) >= {"edges", "rules"}
    engine.adopt("rule__bornin__locatedin__to__nationality")
    with pytest.raises(rules.InvalidStatusTransition):
        engine.adopt("rule__bornin__locatedin__to__nationality")
    with pytest.raises(KeyError):
        engine.reject("none")
    done = engine.infer()
    assert done.conflicts == 1 and engine.conflict_cases().count() == 1 and engine.table("edges").count() == 9
    assert engine.rules("applied").count() == 1
    engine.replace_conflicts({"nationality": {"other"}})
    engine.add_conflict("nationality", "third")
    engine.delete_conflict("nationality", "other")
    assert [(r.head_relation, r.conflict_relations) for r in engine.conflicts().collect()] == [("nationality", ["third"])]
    run = engine.consume_changelog()
    assert (run.processed, run.affected, run.cursor) == (0, [], 0)
    assert engine.append_changes([("alice", "bornIn", "beijing")], [("x", "locatedIn", "y")], batch_id="one", metadata={"who": "me"}) == 2
    assert engine.append_changes([("alice", "bornIn", "beijing")], [("x", "locatedIn", "y")], batch_id="one") == 4
    assert engine.pending().count() == 2
    run = engine.consume_changelog(MiningConfig(min_support=1))
    assert (run.processed, run.affected, run.cursor) == (2, ["bornIn", "locatedIn"], 2)
    assert "rule__bornin__locatedin__to__nationality" in {r.rule_id for r in run.mined.collect()} and engine.table("rule_stats").count() >= 1
    again = engine.consume_changelog()
    assert (again.processed, again.affected) == (0, [])
    assert engine.capture_diff(graph, graph.where("eid <> 1")) == 5 and engine.pending().first().event_type == "removed"
    assert engine.capture_diff(graph, graph.where("eid <> 1")) == 5 and engine.pending().count() == 1
    engine.append_changes([("bob", "lives", "x")])
    assert engine.pending().count() == 2
    assert engine.mine_incremental(2, ["partOf"]).count() == 1
    stat = engine.rule_stat("rule__bornin__locatedin__to__nationality")
    assert (stat["support"], stat["pca_denominator"], stat["updated_at"]) == (1, 1, NOW)
    with pytest.raises(KeyError):
        engine.rule_stat("none")


def test_store_commits_all_or_nothing(spark, tmp_path):
    store, one = Store(spark, str(tmp_path / "s"), {"b": "k"}), spark.createDataFrame([("x", 1)], "k string, v long")
    assert store.read("a", "k string, v long").isEmpty() and store.current() == (0, {})
    assert store.commit({"a": one, "b": one}) == 1
    early = store.read("a", "k string, v long")
    for _ in range(5):
        store.commit({"a": one.limit(0)}, {"b": one})
    assert store.read("b", "k string, v long").count() == 6 and store.read("a", "k string, v long").isEmpty() and store.version("b") == 6
    assert early.count() == 1  # older versions stay readable
    assert store.vacuum() == [] and len(store.vacuum(0)) == 5 and store.read("b", "k string, v long").count() == 6
    store.MOST_PARTS = 3
    store.commit(appended={"b": one})
    assert len(store.current()[1]["b"]["parts"]) == 1 and store.read("b", "k string, v long").count() == 7
    late = Store(spark, store.root)
    late.current = lambda now=late.current(): now
    store.commit({"a": one})
    with pytest.raises(RuntimeError):
        late.commit({"a": one})


def test_facts_get_ids_by_content(spark):
    top = (1 << 63) - 5
    edges = spark.createDataFrame([(top + i, f"a{i}", "r", "b") for i in range(4)] + [(7, "b", "s", "c")], EDGES).repartition(4)
    created = infer(edges, _rules(spark, (("r", "s"), "t", 4, 0.9))).created
    assert created.count() == 4 and created.select("eid").distinct().count() == 4
    again = infer(edges, _rules(spark, (("r", "s"), "t", 4, 0.9))).created
    assert created.select("eid", "src").exceptAll(again.select("eid", "src")).isEmpty()


def test_numbers_without_gaps(spark):
    rows = spark.range(1000).select(F.lit(NOW).alias("created_at"), F.format_string("k%04d", "id").alias("dedup_key"), F.lit(None).cast("long").alias("change_seq"))
    got = changelog.numbered(rows.repartition(7), 10, "created_at", "dedup_key").orderBy("dedup_key").collect()
    assert [r.change_seq for r in got] == list(range(11, 1011))
    assert changelog.numbered(rows.limit(0), 10, "created_at", "dedup_key").isEmpty()


def test_wide_vocabularies_and_pushed_filters(spark, graph):
    codes = Codes(tuple(f"r{i:05}" for i in range(9000)), 5)
    assert not codes.packed and Codes(codes.names, 4).packed
    row = spark.createDataFrame([(["r00003", "r08999"],)], "b array<string>")
    for longest in (4, 5):
        held = Codes(codes.names, longest)
        assert row.select(held.body(held.code(F.col("b"), 2), 2)).first()[0] == ["r00003", "r08999"]
        assert row.select(held.code(F.array(F.lit("r00003"), F.lit("none")), 2)).first()[0] is None
    follows = {0: {1, 2}, 1: {3}}
    assert allowed({0, 1, 2, 3}, follows, 2) == [({0, 1}, {0, 1}), ({1, 2, 3}, {1, 2, 3})]
    assert allowed({0, 1, 2, 3}, follows, 2, {3}) == [({0, 1}, {1}), ({1, 2, 3}, set())]
    assert allowed({0, 1, 2, 3}, follows, 3, {2}) == [({0}, set()), ({1}, set()), ({3}, set())]


def test_without_the_operators_folder(tmp_path):
    """The entry point and the engine's queries stand alone."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "hornlake", tmp_path / "hornlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'mine2' in q and set(o) <= set(q); assert not any(k.startswith('op') or k == 'pipeline' for k in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_loads_and_synthetic_graph(spark):
    nodes = load_nodes(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "id string"))
    got = load_edges(spark.createDataFrame([("a", "r", "b")] * 2 + [("a", "r", "z"), (None, "r", "b")], "src string, rel string, dst string"), nodes)
    assert [(r.src, r.dst) for r in got.collect()] == [("a", "b")]
    edges = synthetic(spark, persons=300, cities=20, countries=5, regions=2, companies=10, universities=4)
    counts = {r.rel: r["count"] for r in edges.groupBy("rel").count().collect()}
    assert len(counts) == 9 and counts["bornIn"] == counts["nationality"] == 300 and 0 < counts["noNationality"] < 30
    ids = {r.rule_id for r in mine(edges, MiningConfig(min_support=5, prune_redundant=False)).collect()}
    assert "rule__bornin__locatedin__to__nationality" in ids


def test_stream(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    log = spark.createDataFrame([], CHANGE_DDL)
    for batch, rows in (("one", [("added", "a", "r", "b"), ("added", "c", "s", "d")]), ("two", [("removed", "a", "q", "b")]), ("one", [("added", "a", "r", "b"), ("added", "c", "s", "d")])):
        changelog.append(log, _changes(spark, *rows, batch=batch)).coalesce(1).write.mode("append").parquet(path)
        on_changes(change_stream(spark, path), str(tmp_path / "cp"), lambda net, rels: seen.append((net.count(), rels))).awaitTermination()
    assert seen == [(2, ["r", "s"]), (1, ["q"])]  # the replay leaves nothing
    assert "window" in relation_activity(change_stream(spark, path)).columns


class _Fake:
    def __init__(self):
        self.calls = []

    def health(self):
        return {"rules": 1}

    def adopt(self, rule_id):
        raise KeyError(rule_id)

    def append_changes(self, added, removed, **options):
        self.calls.append((added, removed, options))
        return 3


def test_cli(capsys):
    fake = _Fake()
    assert cli.main(["--root", "x", "health"], fake) == 0 and json.loads(capsys.readouterr().out) == {"rules": 1}
    assert cli.main(["--root", "x", "append", "--add", "a,r,b", "--context", "k=v", "--batch-id", "z"], fake) == 0
    assert fake.calls == [([("a", "r", "b")], [], {"source": "cli", "batch_id": "z", "idempotency_key": None, "metadata": {"k": "v"}})]
    assert cli.main(["--root", "x", "rules", "adopt", "none"], fake) == 1
    assert cli.main(["--root", "x", "append", "--add", "a,b"], fake) == 2
    assert cli.main(["--root", "x", "mine", "--body-length", "9"], fake) == 2
    assert cli.main(["--root", "x", "consume", "--confidence-ub-weight", "2"], fake) == 2 and cli.main(["--root", "x", "conflicts", "add"], fake) == 2
    with pytest.raises(SystemExit) as stop:
        cli.main(["--root", "x", "nothing"], fake)
    assert stop.value.code == 2


def test_catalogue_matches_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("functionality", "body3", "cand4", "mine2", "mine3", "mine5", "body3_prefixed", "infer_fixpoint", "conflict_cases", "changelog_fold", "ub_prune_w1"):
        got = queries[name](spark, folder)
        columns = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql[name]})").fetchall()
        assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want)), name
    assert entry.entry(spark).count() == 6
