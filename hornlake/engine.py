"""The engine: a graph and its state tables in one folder, and the calls that move them on."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions.names import metadata_json
from .operators import changelog, conflicts, rules
from .operators.incremental import IncrementalRun, run_incremental
from .operators.infer import Inference, as_facts, infer
from .plans.mine import collisions, mine
from .schema import InferenceConfig, MiningConfig, Settings
from .sources.store import Store, materialise

TABLES = {
    "edges": schema.EDGE_DDL, "rules": schema.RULE_DDL, "rule_stats": schema.STAT_DDL + ", updated_at timestamp", "conflict_rules": schema.CONFLICT_RULE_DDL,
    "conflict_cases": schema.CASE_DDL, "changelog": schema.CHANGE_DDL, "state": "name string, value long",
}


class Engine:
    """One writer at a time; every call that changes tables is one commit of all it touches."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, clock=lambda: datetime.now(UTC).replace(tzinfo=None)):
        # Edges are stored by relation, so a typed scan reads its own files only.
        self.spark, self.store, self.clock = spark, Store(spark, root, {"edges": "rel"}), clock
        self.settings = settings or Settings.from_environment()

    def table(self, name: str) -> DataFrame:
        found = self.store.read(name, TABLES[name])
        return found.select(*[c.split()[0] for c in TABLES[name].split(", ")]) if name == "edges" else found

    def health(self) -> dict[str, int]:
        """The version of each table, 0 if it has none."""
        held = self.store.current()[1]
        return {name: held.get(name, {"version": 0})["version"] for name in TABLES}

    def bootstrap(self) -> None:
        """An empty version of each table that has none."""
        missing = [name for name, version in self.health().items() if not version]
        if missing:
            self.store.commit({name: self.spark.createDataFrame([], TABLES[name]) for name in missing})

    def load(self, edges: DataFrame, append: bool = False) -> None:
        """Replace the graph, or add edges to it."""
        rows = {"edges": as_facts(edges)}
        self.store.commit(appended=rows) if append else self.store.commit(rows)

    # Mining -----------------------------------------------------------------------------------------------------

    def mine(self, config: MiningConfig | None = None) -> DataFrame:
        """Mine the graph and keep the rules; raises ValueError if two rules would share an id."""
        config = config or MiningConfig(min_support=self.settings.min_support, min_pca_confidence=self.settings.min_confidence)
        found = mine(self.table("edges"), config)
        self.store.commit({"rules": self._with_rules(found)})
        return found

    def _with_rules(self, found: DataFrame) -> DataFrame:
        known = self.table("rules")
        clash = collisions(known.select("rule_id", "body_relations", "head_relation").unionByName(found.select("rule_id", "body_relations", "head_relation"))).first()
        if clash:
            raise ValueError(f"different rules share the id {clash['rule_id']}")
        return rules.upsert(known, found)

    def mine_incremental(self, body_length: int, changed: Sequence[str], **options) -> DataFrame:
        """Mine only bodies that hold a changed relation; all thresholds are 0 unless given."""
        config = MiningConfig(**{"min_support": 0, "min_pca_confidence": 0.0} | options, body_length=body_length, changed_relations=tuple(changed))
        return self.mine(config)

    def consume_changelog(self, config: MiningConfig | None = None, *, change_limit: int = 2000, hints: tuple[str, ...] = ()) -> IncrementalRun:
        """Refresh and mine what the unread log touches, and move the cursor with it."""
        config = config or MiningConfig(min_support=self.settings.min_support, min_pca_confidence=self.settings.min_confidence)
        run = run_incremental(self.table("edges"), self.table("rules"), self.changes(), self.cursor(), config, change_limit=change_limit, hints=hints)
        changed = {"state": self._state(cursor=run.cursor)}
        if run.affected:
            stats, fresh = self.table("rule_stats"), run.stats.withColumn("updated_at", F.lit(self.clock()).cast("timestamp"))
            changed |= {"rules": self._with_rules(run.mined), "rule_stats": stats.join(fresh, "rule_id", "left_anti").unionByName(fresh)}
        self.store.commit(changed)
        return run

    # Rules ------------------------------------------------------------------------------------------------------

    def rules(self, status: str | None = None, limit: int = 100) -> DataFrame:
        return rules.listed(self.table("rules"), status, limit)

    def adopt(self, rule_id: str) -> None:
        self.store.commit({"rules": rules.transition(self.table("rules"), rule_id, "adopted")})

    def reject(self, rule_id: str) -> None:
        self.store.commit({"rules": rules.transition(self.table("rules"), rule_id, "rejected")})

    def rule_stat(self, rule_id: str) -> dict:
        """support, pca_denominator, head_count and updated_at of the rule's last refresh; KeyError if it had none."""
        row = self.table("rule_stats").where(F.col("rule_id") == rule_id).first()
        if row is None:
            raise KeyError(rule_id)
        return row.asDict()

    # Inference --------------------------------------------------------------------------------------------------

    def infer(self, config: InferenceConfig | None = None, pairs: Mapping[str, set[str]] | None = None) -> Inference:
        """Apply the adopted rules. Conflict pairs: those given, else those stored, else those of the settings."""
        against = pairs or conflicts.as_mapping(self.table("conflict_rules")) or self.settings.conflict_pairs
        done = infer(self.table("edges"), self.table("rules"), config or InferenceConfig(), conflicts=against, cases=self.table("conflict_cases"), now=self.clock())
        self.store.commit({"rules": done.rules, "conflict_cases": done.cases}, {"edges": done.created} if done.total_created else None)
        return done

    # Conflicts --------------------------------------------------------------------------------------------------

    def conflicts(self) -> DataFrame:
        return conflicts.pairs(self.table("conflict_rules"))

    def replace_conflicts(self, pairs: Mapping[str, set[str]]) -> None:
        self.store.commit({"conflict_rules": conflicts.pair_table(self.spark, pairs, self.clock())})

    def add_conflict(self, head: str, relation: str) -> None:
        self.store.commit({"conflict_rules": conflicts.upsert_pair(self.table("conflict_rules"), head, relation, self.clock())})

    def delete_conflict(self, head: str, relation: str) -> None:
        self.store.commit({"conflict_rules": conflicts.delete_pair(self.table("conflict_rules"), head, relation)})

    def conflict_cases(self, limit: int = 100, rule_id: str | None = None) -> DataFrame:
        return conflicts.latest(self.table("conflict_cases"), limit, rule_id)

    # Change log -------------------------------------------------------------------------------------------------

    def append_changes(self, added: Sequence[tuple] = (), removed: Sequence[tuple] = (), *, source: str = "api", batch_id: str | None = None, idempotency_key: str | None = None, metadata: Mapping | None = None) -> int:
        """Log edges (src, rel, dst) as added and removed; the last number given out. Replays of a batch add nothing."""
        batch = (batch_id or "").strip() or str(uuid.uuid4())
        events = [("added", *e) for e in added] + [("removed", *e) for e in removed]
        rows = [(*e, source, batch, idempotency_key, i, metadata_json(dict(metadata or {})), self.clock()) for i, e in enumerate(events)]
        ddl = "event_type string, src string, rel string, dst string, source string, batch_id string, idempotency_key string, position long, metadata string, created_at timestamp"
        last = self._value("sequence")
        return self._log(changelog.append(self.table("changelog"), self.spark.createDataFrame(rows, ddl), last), last + len(rows))

    def capture_diff(self, old: DataFrame, new: DataFrame) -> int:
        """Log the difference of two edge tables; taken twice it adds nothing."""
        diff = changelog.snapshot_diff(old, new)
        rows = diff.withColumns({"source": F.lit("trigger"), "batch_id": F.lit("trigger"), "position": F.lit(0), "metadata": F.lit("{}"), "created_at": F.lit(self.clock())})
        fresh, last = changelog.append(self.table("changelog"), rows), self._value("sequence")
        numbered = materialise(changelog.numbered(fresh.drop("change_seq"), last, "created_at", "dedup_key").select(*fresh.columns), "numbered")
        return self._log(numbered, last + numbered.count())

    def _log(self, entries: DataFrame, last: int) -> int:
        """Append entries; the last number given out."""
        self.store.commit({"state": self._state(sequence=last)}, {"changelog": entries})
        return last

    def changes(self) -> DataFrame:
        return self.table("changelog")

    def pending(self, limit: int = 1000) -> DataFrame:
        return changelog.pending(self.changes(), self.cursor(), limit)

    def cursor(self) -> int:
        return self._value("cursor")

    def _value(self, name: str) -> int:
        row = self.table("state").where(F.col("name") == name).first()
        return row["value"] if row else 0

    def _state(self, **values: int) -> DataFrame:
        """The state with some values set."""
        kept = {r["name"]: r["value"] for r in self.table("state").collect()}  # a row a name
        return self.spark.createDataFrame(sorted((kept | values).items()), TABLES["state"])
