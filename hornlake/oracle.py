"""SQL for each query of the catalogue, built from named common table expressions."""

from __future__ import annotations

import re

from .catalog import CHANGED, RULES

_EDGES = {
    "contains": "SELECT DISTINCT 'o' || l_orderkey AS src, 'contains' AS rel, 'p' || l_partkey AS dst FROM lineitem",
    "filledBy": "SELECT DISTINCT 'o' || l_orderkey, 'filledBy', 's' || l_suppkey FROM lineitem WHERE l_returnflag <> 'R'",
    "suppliedBy": "SELECT DISTINCT 'p' || l_partkey, 'suppliedBy', 's' || l_suppkey FROM lineitem WHERE l_linenumber <= 2",
    "placedBy": "SELECT 'o' || o_orderkey, 'placedBy', 'c' || o_custkey FROM orders",
    "places": "SELECT 'c' || o_custkey, 'places', 'o' || o_orderkey FROM orders",
    "custNation": "SELECT 'c' || c_custkey, 'custNation', 'n' || c_nationkey FROM customer",
    "suppNation": "SELECT 's' || s_suppkey, 'suppNation', 'n' || s_nationkey FROM supplier",
    "inRegion": "SELECT 'n' || n_nationkey, 'inRegion', 'r' || n_regionkey FROM nation",
    "shipsToNation": "SELECT 'o' || o_orderkey, 'shipsToNation', 'n' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'",
    "shipsToRegion": "SELECT 'o' || o_orderkey, 'shipsToRegion', 'r' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'",
    "custRegion": "SELECT 'c' || c_custkey, 'custRegion', 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0",
    "notShipped": "SELECT 'o' || o_orderkey, 'notShipped', 'n' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'",
}
_A = ("contains", "filledBy", "suppliedBy", "placedBy", "custNation", "suppNation", "inRegion", "shipsToNation", "shipsToRegion", "custRegion")
_B = ("contains", "places", "suppliedBy", "suppNation", "inRegion", "custNation", "custRegion")


def _edges(names) -> str:
    return "e(src, rel, dst) AS MATERIALIZED (" + " UNION ALL ".join(_EDGES[n] for n in names) + ")"


A, B, C = _edges(_A), _edges(_B), _edges((*_A, "notShipped"))
#: Edges with the inferred ones marked, and the facts among them.
F = A + ", m AS (SELECT *, rel = 'shipsToNation' AND substr(src, 2)::BIGINT % 7 = 0 AS inferred FROM e), facts AS (SELECT src, rel, dst FROM m WHERE NOT inferred)"


def _r(n: int, alias: str = "") -> str:
    return ", ".join(f"{alias}r{i}" for i in range(1, n + 1))


def _walks(n: int, edges: str = "e", only: str = "TRUE", prefix: str = "TRUE") -> str:
    """CTEs p1..pn of distinct (r1..rk, x, y); no relation comes twice in these graphs."""
    found = [f"p1 AS (SELECT DISTINCT rel AS r1, src AS x, dst AS y FROM {edges})"]
    for k in range(2, n + 1):
        here = ["TRUE"] + [only] * (k == n) + [prefix] * (k == 2 < n)
        rows = f"SELECT DISTINCT {_r(k - 1, 'p.')}, e2.rel AS r{k}, p.x, e2.dst AS y FROM p{k - 1} p JOIN {edges} e2 ON p.y = e2.src"
        found.append(f"p{k} AS MATERIALIZED (SELECT * FROM ({rows}) WHERE {' AND '.join(here)})")
    return ", ".join(found)


def _bodies(n: int) -> str:
    return f"b{n} AS (SELECT {_r(n)}, count(*)::BIGINT AS body_support FROM p{n} GROUP BY ALL)"


def _closed(n: int, bodies: str | None = None) -> str:
    """CTE c(r1..rn, head, support, pca_denominator) of the bodies in the named CTE, or all."""
    rs = _r(n)
    kept = f"(SELECT * FROM p{n} SEMI JOIN {bodies} USING ({rs}))" if bodies else f"p{n}"
    return (
        f"s AS (SELECT {rs}, h.rel AS head, count(*)::BIGINT AS support FROM {kept} p JOIN (SELECT DISTINCT src, rel, dst FROM e) h ON p.x = h.src AND p.y = h.dst GROUP BY ALL), "
        f"d AS (SELECT {rs}, h.rel AS head, count(*)::BIGINT AS pca_denominator FROM {kept} p JOIN (SELECT DISTINCT src, rel FROM e) h ON p.x = h.src GROUP BY ALL), "
        f"c AS (SELECT {rs}, head, support, pca_denominator FROM s JOIN d USING ({rs}, head))"
    )


FUN = "fun AS (SELECT rel, count(DISTINCT src)::DOUBLE / count(*)::DOUBLE AS f FROM e GROUP BY rel)"


def _functional(n: int, bodies: str) -> str:
    joins = " ".join(f"JOIN fun f{i} ON b.r{i} = f{i}.rel" for i in range(1, n + 1))
    total = " + ".join(f"f{i}.f" for i in range(1, n + 1))
    order = f"{total} DESC, " + ", ".join(f"f{i}.f DESC" for i in range(1, n + 1)) + f", {_r(n, 'b.')}"
    return f"FROM {bodies} b {joins} ORDER BY %s{order}"


def _id(rs: list[str], head: str) -> str:
    part = lambda c: f"regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return "'rule__' || " + " || '__' || ".join(part(r) for r in rs) + f" || '__to__' || {part(head)}"


def _text(n: int, head: str) -> str:
    middle = ["Z"] if n == 2 else [f"Z{i}" for i in range(1, n)]
    names = ["X", *middle, "Y"]
    return " || ' ∧ ' || ".join(f"r{i + 1} || '({names[i]},{names[i + 1]})'" for i in range(n)) + f" || ' -> ' || {head} || '(X,Y)'"


def _mined(n: int, edges: str = A, only: str = "TRUE") -> str:
    """The CTEs up to `mined`, all columns of a rule."""
    rs = [f"r{i}" for i in range(1, n + 1)]
    kept2 = "k2 AS (SELECT * FROM b2 WHERE body_support >= 5 QUALIFY row_number() OVER (PARTITION BY r1, body_support ORDER BY r2) = 1)"
    if n == 2:
        parts = [_walks(2, only=only), _bodies(2), kept2, _closed(2, "k2")]
    elif n == 3:
        touched2 = only.replace("r3", "r2")
        pairs = f"q2 AS (SELECT DISTINCT p.rel AS r1, t.rel AS r2, p.src AS x, t.dst AS y FROM e p JOIN e t ON p.dst = t.src), b2 AS (SELECT r1, r2, count(*)::BIGINT AS body_support FROM q2 WHERE {touched2} GROUP BY ALL)"
        kept3 = "k3 AS (SELECT b3.* FROM b3 JOIN b2 USING (r1, r2) WHERE b3.body_support >= 5 AND b3.body_support < b2.body_support)"
        parts = [pairs, kept2, _walks(3, only=only, prefix="(r1, r2) IN (SELECT r1, r2 FROM k2)"), _bodies(3), kept3, _closed(3, "k3")]
    else:
        parts = [_walks(n), _closed(n)]
    conf = "support::DOUBLE / pca_denominator"
    mined = f"""mined AS (SELECT {_id(rs, 'head')} AS rule_id, {" || ',' || ".join(rs)} AS body, head AS head_relation, support, {conf} AS pca_confidence,
      support::DOUBLE / head_count AS head_coverage, {_text(n, 'head')} AS rule_text
      FROM c JOIN (SELECT rel AS head, count(*) AS head_count FROM e GROUP BY rel) h USING (head) WHERE support >= 5 AND {conf} >= 0.01)"""
    return f"WITH {edges}, " + ", ".join([*parts, mined])


def _touched(n: int) -> str:
    names = ", ".join(f"'{r}'" for r in CHANGED)
    return "(" + " OR ".join(f"r{i} IN ({names})" for i in range(1, n + 1)) + ")"


def _new(body, head: str, facts: str) -> str:
    """(x, y) that the body joins in facts and the head does not."""
    joins = "".join(f" JOIN {facts} e{i} ON e{i - 1}.dst = e{i}.src AND e{i}.rel = '{r}'" for i, r in enumerate(body) if i)
    return f"SELECT DISTINCT e0.src AS x, e{len(body) - 1}.dst AS y FROM {facts} e0{joins} WHERE e0.rel = '{body[0]}' AND NOT EXISTS (SELECT 1 FROM {facts} h WHERE h.rel = '{head}' AND h.src = e0.src AND h.dst = e{len(body) - 1}.dst)"


def _chained(rounds: int) -> tuple[str, list[tuple[int, int, str, str]]]:
    """CTEs of rounds * rules steps; [(round, rule, facts before, made)]."""
    ctes, facts, steps = [C], "e", []
    for k in range(1, rounds + 1):
        for i, (body, head, _) in enumerate(RULES):
            made = f"n{k}_{i}"
            ctes.append(f"{made} AS MATERIALIZED ({_new(body, head, facts)})")
            steps.append((k, i, facts, made))
            ctes.append(f"g{k}_{i} AS MATERIALIZED (SELECT src, rel, dst FROM {facts} UNION ALL SELECT x, '{head}', y FROM {made})")
            facts = f"g{k}_{i}"
    return "WITH " + ", ".join(ctes), steps


def _rule_id(i: int) -> str:
    body, head, _ = RULES[i]
    clean = lambda r: re.sub("[^a-z0-9_]+", "_", r.strip().lower()).strip("_")
    return "rule__" + "__".join(map(clean, body)) + "__to__" + clean(head)


def _facts(rounds: int) -> str:
    ctes, steps = _chained(rounds)
    rows = [f"SELECT x AS src, '{RULES[i][1]}' AS rel, y AS dst, '{_rule_id(i)}' AS source_rule_id, {RULES[i][2]}::DOUBLE AS rule_confidence FROM {made}" for _, i, _, made in steps]
    return f"{ctes} {' UNION ALL '.join(rows)}"


def _against(i: int, facts: str, made: str) -> str:
    """Conflicting pairs that a step meets: what it is about to make and a conflicting relation holds."""
    if RULES[i][1] != "shipsToNation":
        return "SELECT NULL AS x, NULL AS y WHERE FALSE"
    return f"SELECT x, y FROM {made} WHERE EXISTS (SELECT 1 FROM {facts} h WHERE h.rel = 'notShipped' AND h.src = x AND h.dst = y)"


def _summary() -> str:
    """Two rounds: the second makes nothing."""
    ctes, steps = _chained(2)
    rows = [f"SELECT '{_rule_id(i)}' AS rule_id, (SELECT count(*) FROM {made})::BIGINT AS created_triples, (SELECT count(*) FROM ({_against(i, facts, made)}))::BIGINT AS conflict_triples, {k}::BIGINT AS iteration" for k, i, facts, made in steps]
    return f"{ctes} {' UNION ALL '.join(rows)}"


def _cases() -> str:
    ctes, steps = _chained(1)
    _, i, facts, made = next(s for s in steps if RULES[s[1]][1] == "shipsToNation")
    return f"{ctes} SELECT '{_rule_id(i)}' AS rule_id, 'shipsToNation' AS inferred_relation, 'notShipped' AS conflicting_relation, x AS source_x, y AS source_y, 1::BIGINT AS detect_count, 1::BIGINT AS first_iteration, 1::BIGINT AS last_iteration FROM ({_against(i, facts, made)})"


def _metrics(body, head: str) -> str:
    rs = " AND ".join(f"r{i + 1} = '{r}'" for i, r in enumerate(body))
    n = len(body)
    return f"""WITH {A}, {_walks(n, only=rs)}
      SELECT (SELECT count(*) FROM p{n} WHERE EXISTS (SELECT 1 FROM e WHERE rel = '{head}' AND src = x AND dst = y))::BIGINT AS support,
             (SELECT count(*) FROM p{n} WHERE EXISTS (SELECT 1 FROM e WHERE rel = '{head}' AND src = x))::BIGINT AS pca_denominator,
             (SELECT count(*) FROM e WHERE rel = '{head}')::BIGINT AS head_count"""


def _refreshed() -> str:
    """The known rules with a changed relation, scored on the graph."""
    known = [i for i, (body, head, _) in enumerate(RULES) if {*body, head} & {*CHANGED}]
    rows = []
    for i in known:
        body, head, _ = RULES[i]
        own = f"(SELECT * FROM p2 WHERE r1 = '{body[0]}' AND r2 = '{body[1]}')"
        rows.append(
            f"SELECT '{_rule_id(i)}' AS rule_id, (SELECT count(*) FROM {own} WHERE EXISTS (SELECT 1 FROM e WHERE rel = '{head}' AND src = x AND dst = y))::BIGINT AS support, "
            f"(SELECT count(*) FROM {own} WHERE EXISTS (SELECT 1 FROM e WHERE rel = '{head}' AND src = x))::BIGINT AS den, (SELECT count(*) FROM e WHERE rel = '{head}')::BIGINT AS hc"
        )
    return f"known AS ({' UNION ALL '.join(rows)}), refreshed AS (SELECT rule_id, support, support::DOUBLE / den AS pca_confidence, support::DOUBLE / hc AS head_coverage, 'adopted' AS status FROM known)"


LOG = """l AS (SELECT event_id AS change_seq, CASE WHEN event_type = 'error' THEN 'removed' ELSE 'added' END AS event_type, user_id::VARCHAR AS src,
  'r' || (json_extract_string(props, '$.k')::BIGINT % 3) AS rel, (floor(value)::BIGINT % 2)::VARCHAR AS dst FROM events)"""
FOLD = """la AS (SELECT *, max(CASE WHEN event_type = 'added' THEN change_seq END) OVER (PARTITION BY src, rel, dst) AS last_add FROM l),
  folded AS (SELECT src, rel, dst, CASE WHEN max(last_add) IS NULL THEN 'removed' WHEN count(*) FILTER (event_type = 'removed' AND change_seq > last_add) = 0 THEN 'added'
  WHEN count(*) FILTER (event_type = 'removed' AND change_seq > last_add) = 1 THEN 'cancelled' ELSE 'removed' END AS state FROM la GROUP BY src, rel, dst)"""
RULE_COLUMNS = "rule_id, body, head_relation, support, pca_confidence, head_coverage, rule_text"
ROUND_TRIPS = "('discovered', 'adopted', TRUE), ('discovered', 'rejected', TRUE), ('adopted', 'adopted', FALSE), ('adopted', 'rejected', TRUE), ('applied', 'adopted', FALSE), ('applied', 'rejected', FALSE), ('rejected', 'adopted', FALSE), ('rejected', 'rejected', FALSE), ('discovered', 'applied', FALSE), ('adopted', 'applied', TRUE), ('applied', 'applied', FALSE), ('rejected', 'applied', FALSE)"


def oracle_sql() -> dict[str, str]:
    w2, w3 = _walks(2), _walks(3)
    cand2 = f"WITH {A}, {w2}, {_closed(2)}"
    ends = "SELECT src AS id FROM e UNION SELECT dst FROM e"
    mined2 = _mined(2)
    top50 = "QUALIFY row_number() OVER (PARTITION BY {rs} ORDER BY support DESC, head) <= 50"
    return {
        "rel_frequency": f"WITH {A} SELECT rel, count(*)::BIGINT AS freq FROM e GROUP BY rel",
        "head_counts": f"WITH {F} SELECT rel, count(*)::BIGINT AS head_count FROM facts GROUP BY rel",
        "head_counts_all": f"WITH {F} SELECT rel, count(*)::BIGINT AS head_count FROM m GROUP BY rel",
        "functionality": f"WITH {F} SELECT rel, count(DISTINCT src)::DOUBLE / count(*)::DOUBLE AS functionality FROM facts GROUP BY rel",
        "node_load": f"WITH {A} {ends}",
        "edge_load": f"WITH {A}, n AS (SELECT src AS id FROM e WHERE rel IN ('custNation', 'suppNation') UNION SELECT dst FROM e WHERE rel IN ('custNation', 'suppNation')) SELECT DISTINCT src, rel, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)",
        "body2": f"WITH {A}, {w2}, {_bodies(2)} SELECT * FROM b2",
        "body3": f"WITH {A}, {w3}, {_bodies(3)} SELECT * FROM b3",
        "body4": f"WITH {A}, {_walks(4)}, {_bodies(4)} SELECT * FROM b4",
        "body5": f"WITH {B}, {_walks(5)}, {_bodies(5)} SELECT * FROM b5",
        "body2_factual": f"WITH {F}, {_walks(2, 'facts')}, {_bodies(2)} SELECT * FROM b2",
        "body2_touched": f"WITH {A}, {_walks(2, only=_touched(2))}, {_bodies(2)} SELECT * FROM b2",
        "body3_prefixed": f"WITH {A}, q AS (SELECT DISTINCT a.rel AS r1, b.rel AS r2, a.src AS x, b.dst AS y FROM e a JOIN e b ON a.dst = b.src), cnt AS (SELECT r1, r2, count(*) AS n FROM q GROUP BY ALL), pre AS (SELECT r1, r2 FROM cnt WHERE n >= 2000 QUALIFY row_number() OVER (PARTITION BY r1, n ORDER BY r2) = 1), {_walks(3, prefix='(r1, r2) IN (SELECT r1, r2 FROM pre)')}, {_bodies(3)} SELECT * FROM b3",
        "cand2": f"{cand2} SELECT * FROM c",
        "cand3": f"WITH {A}, {w3}, {_closed(3)} SELECT * FROM c",
        "cand4": f"WITH {A}, {_walks(4)}, {_closed(4)} SELECT * FROM c {top50.format(rs=_r(4))}",
        "cand5": f"WITH {B}, {_walks(5)}, {_closed(5)} SELECT * FROM c {top50.format(rs=_r(5))}",
        "metrics_rule_2": _metrics(("placedBy", "custNation"), "shipsToNation"),
        "metrics_rule_3": _metrics(("filledBy", "suppNation", "inRegion"), "shipsToRegion"),
        "support_prune": f"WITH {A}, {w2}, {_bodies(2)} SELECT * FROM b2 WHERE body_support >= 2000",
        "redundancy_prune": f"WITH {A}, {w2}, {_bodies(2)} SELECT * FROM b2 QUALIFY row_number() OVER (PARTITION BY r1, body_support ORDER BY r2) = 1",
        "functionality_rank": f"WITH {A}, {w2}, {_bodies(2)}, {FUN} SELECT r1, r2, body_support, (row_number() OVER ())::INT AS place FROM (SELECT b.* {_functional(2, 'b2') % ''})",
        "beam2": f"WITH {A}, {w2}, {_bodies(2)}, {FUN} SELECT b.* {_functional(2, 'b2') % 'b.body_support DESC, '} LIMIT 4",
        "beam3": f"WITH {A}, {w3}, {_bodies(3)}, {FUN} SELECT b.* {_functional(3, 'b3') % 'b.body_support DESC, '} LIMIT 3",
        "nonimproving3": f"WITH {A}, {w3}, {_bodies(3)}, {_bodies(2)} SELECT b3.* FROM b3 JOIN b2 USING (r1, r2) WHERE b3.body_support < b2.body_support",
        "dedup_signature": f"{cand2} SELECT * FROM c",
        "ub_prune_w0": f"{cand2} SELECT * FROM c WHERE support::DOUBLE / greatest(pca_denominator, 1) >= 0.2",
        "ub_prune_w1": f"{cand2}, u AS (SELECT *, round_even(support * greatest(1.0, avg(pca_denominator::DOUBLE / support) OVER (PARTITION BY head)), 0)::BIGINT AS expected FROM c) SELECT {_r(2)}, head, support, pca_denominator FROM u WHERE support::DOUBLE / greatest(pca_denominator, expected, 1) >= 0.2",
        "head_budget": f"{cand2} SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY head ORDER BY support::DOUBLE / pca_denominator DESC, support DESC, pca_denominator, r1, r2) = 1",
        "mine2": f"{mined2} SELECT {RULE_COLUMNS} FROM mined",
        "mine3": f"{_mined(3)} SELECT {RULE_COLUMNS} FROM mined",
        "mine4": f"{_mined(4)} SELECT {RULE_COLUMNS} FROM mined",
        "mine5": f"{_mined(5, B)} SELECT {RULE_COLUMNS} FROM mined",
        "mine2_incremental": f"{_mined(2, only=_touched(2))} SELECT {RULE_COLUMNS} FROM mined",
        "mine3_incremental": f"{_mined(3, only=_touched(3))} SELECT {RULE_COLUMNS} FROM mined",
        "refresh_rules": f"WITH {A}, {w2}, {_refreshed()} SELECT * FROM refreshed",
        "incremental_merge": f"{_mined(2, only=_touched(2))}, {_refreshed()} SELECT rule_id, support, pca_confidence, 'discovered' AS status FROM mined UNION ALL SELECT rule_id, support, pca_confidence, status FROM refreshed WHERE rule_id NOT IN (SELECT rule_id FROM mined)",
        "apply2": f"WITH {A} SELECT x AS src, 'shipsToNation' AS rel, y AS dst FROM ({_new(('placedBy', 'custNation'), 'shipsToNation', 'e')})",
        "apply3": f"WITH {A} SELECT x AS src, 'shipsToRegion' AS rel, y AS dst FROM ({_new(('filledBy', 'suppNation', 'inRegion'), 'shipsToRegion', 'e')})",
        "apply_n": f"WITH {B} SELECT x AS src, 'custNation' AS rel, y AS dst FROM ({_new(('places', 'contains', 'suppliedBy', 'suppNation'), 'custNation', 'e')})",
        "infer_once": _facts(1),
        "infer_fixpoint": _facts(2),
        "fixpoint_summary": _summary(),
        "conflict_count": f"WITH {C} SELECT count(*)::BIGINT AS n FROM ({_new(('placedBy', 'custNation'), 'shipsToNation', 'e')}) WHERE EXISTS (SELECT 1 FROM e h WHERE h.rel = 'notShipped' AND h.src = x AND h.dst = y)",
        "conflict_cases": _cases(),
        "rule_upsert": f"{mined2}, known(rule_id, support, pca_confidence, status) AS (VALUES {', '.join(f"('{_rule_id(i)}', 10::BIGINT, {RULES[i][2]}::DOUBLE, '{'adopted' if i == 0 else 'discovered'}')" for i in range(len(RULES)))}) SELECT rule_id, m.support, m.pca_confidence, coalesce(k.status, 'discovered') AS status, (CASE WHEN k.status = 'adopted' THEN 2 ELSE 1 END)::BIGINT AS version FROM mined m LEFT JOIN known k USING (rule_id) UNION ALL SELECT rule_id, support, pca_confidence, status, 1 FROM known WHERE rule_id NOT IN (SELECT rule_id FROM mined)",
        "rule_list": f"{mined2} SELECT rule_id, pca_confidence, support FROM mined ORDER BY pca_confidence DESC, support DESC, rule_id LIMIT 3",
        "rules_by_relation": f"{mined2} SELECT rule_id FROM mined WHERE list_has_any(list_append(string_split(body, ','), head_relation), ['inRegion', 'filledBy'])",
        "relation_index": f"{mined2} SELECT DISTINCT unnest(list_append(string_split(body, ','), head_relation)) AS relation, rule_id FROM mined",
        "rule_text_id": f"{_mined(3)} SELECT rule_id, rule_text FROM mined",
        "transition_matrix": f"SELECT * FROM (VALUES {ROUND_TRIPS}) AS t(status, target, allowed)",
        "changelog_dedup_seq": f"WITH {LOG} SELECT 11 + change_seq AS change_seq, concat_ws('|', 'bench', 'b' || src, '', event_type, src, rel, dst, change_seq::VARCHAR) AS dedup_key FROM l",
        "changelog_fold": f"WITH {LOG}, {FOLD} SELECT * FROM folded",
        "pending": f"WITH {LOG} SELECT * FROM l WHERE change_seq > 100 ORDER BY change_seq LIMIT 250",
        "affected_relations": f"WITH {LOG}, {FOLD} SELECT DISTINCT rel FROM folded WHERE state <> 'cancelled'",
        "snapshot_diff": f"WITH {A} SELECT CASE rel WHEN 'custRegion' THEN 'added' ELSE 'removed' END AS event_type, src, rel, dst FROM e WHERE rel IN ('custRegion', 'inRegion')",
    }
