"""Names and texts of relations and rules, as columns and as plain values."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_relation(rel: Column) -> Column:
    """Without backticks and outer blanks."""
    return F.replace(F.trim(rel), F.lit("`"), F.lit(""))


def plain_relation(rel: str) -> str:
    return rel.strip().replace("`", "")


def _id_part(rel: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(rel)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def rule_id(body: Column, head: Column) -> Column:
    """rule__r1__r2__to__head, each name reduced to a-z, 0-9 and underscores."""
    return F.concat(F.lit("rule__"), F.array_join(F.transform(body, _id_part), "__"), F.lit("__to__"), _id_part(head))


def signature(body: Column, head: Column) -> Column:
    """Equal for rules that differ in case, blanks and backticks only."""
    lowered = lambda r: F.lower(clean_relation(r))
    return F.struct(F.transform(body, lowered).alias("body"), lowered(head).alias("head"))


def rule_text(body: Column, head: Column) -> Column:
    """r1(X,Z) ∧ r2(Z,Y) -> head(X,Y); longer bodies number the variables between."""
    n = F.size(body)
    between = lambda i: F.when(n == 2, F.lit("Z")).otherwise(F.concat(F.lit("Z"), i.cast("string")))
    atom = lambda r, i: F.concat(
        r, F.lit("("), F.when(i == 0, F.lit("X")).otherwise(between(i)), F.lit(","), F.when(i == n - 1, F.lit("Y")).otherwise(between(i + 1)), F.lit(")")
    )
    return F.concat(F.array_join(F.transform(body, atom), " ∧ "), F.lit(" -> "), head, F.lit("(X,Y)"))


def parse_conflict_pairs(text: str) -> dict[str, set[str]]:
    """a:b,c:d as {a: {b}, c: {d}}; parts without both names are left out."""
    found: dict[str, set[str]] = {}
    for part in text.split(","):
        head, colon, other = (plain_relation(x) for x in part.partition(":"))
        if colon and head and other:
            found.setdefault(head, set()).add(other)
    return found


def parse_edges(lines) -> list[tuple[str, str, str]]:
    """(src, rel, dst) of each line src,rel,dst; blank lines are left out, others must have three parts."""
    found = []
    for line in lines:
        if line.strip():
            parts = tuple(x.strip() for x in line.split(","))
            if len(parts) != 3 or not all(parts):
                raise ValueError(f"not src,rel,dst: {line!r}")
            found.append(parts)
    return found


def parse_context(pairs) -> dict[str, str]:
    """{key: value} of key=value texts."""
    found = {}
    for pair in pairs:
        key, sign, value = pair.partition("=")
        if not sign or not key.strip():
            raise ValueError(f"not key=value: {pair!r}")
        found[key.strip()] = value.strip()
    return found


def metadata_json(metadata: dict | None) -> str:
    return json.dumps(metadata or {}, sort_keys=True, ensure_ascii=True)
