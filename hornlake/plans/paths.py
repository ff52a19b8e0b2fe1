"""Distinct end points of typed walks whose edges are pairwise different.

A `Graph` is made once for a snapshot: edges are written, relations become numbers, and one aggregate by node tells which relations can follow which. Walks are planned over these relations first: a hop reads only relations
that some walk of the wanted length (with a wanted relation) can take there. Bodies are packed into one number.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.graph import KIND_BITS, factual
from ..sources.store import remove, scratch

#: Relations that a graph may have. They are kept on the driver, and a table of them is broadcast.
MOST_RELATIONS = 1 << 18
#: Vocabularies up to here are held as bits of a long; up to that many relations are picked by name.
MOST_BITS = 62
SKIPPED = 100
#: Walks are tallied for so many edges' sources at a time: shuffle files of one slice go before the next.
SLICE_ROWS = 1 << 24
#: Bodies, heads and closings that one aggregate may have columns for.
MOST_COLUMNS = 100
#: Nodes that are numbers are counted in so many buckets.
BUCKETS = 1 << 13
#: Ends that one node's walks over a body may have to be held as an array; if some node may have more, walks stay rows.
MOST_ENDS = 1 << 22


def touches(body: Column, relations: Sequence[str]) -> Column:
    return F.arrays_overlap(body, F.array(*[F.lit(r) for r in relations]))


@dataclass(frozen=True)
class Codes:
    """Bodies of up to `longest` relations as one value: bits of a long, first relation highest, or an array of ints."""

    names: tuple[str, ...]
    longest: int

    @cached_property
    def bits(self) -> int:
        return max(1, (len(self.names) - 1).bit_length())

    @property
    def packed(self) -> bool:
        return self.bits * self.longest <= 62

    def first(self, rel: Column) -> Column:
        return rel.cast("long") if self.packed else F.array(rel)

    def then(self, body: Column, rel: Column) -> Column:
        return F.shiftleft(body, self.bits).bitwiseOR(rel.cast("long")) if self.packed else F.concat(body, F.array(rel))

    def each(self, body: Column, n: int) -> list[Column]:
        """The numbers of a body of n relations."""
        if not self.packed:
            return [F.get(body, i) for i in range(n)]
        return [F.shiftright(body, self.bits * (n - 1 - i)).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int") for i in range(n)]

    def name(self, rel: Column) -> Column:
        return F.get(F.lit(list(self.names)) if self.names else F.array().cast("array<string>"), rel)

    def body(self, code: Column, n: int) -> Column:
        return F.array(*[self.name(r) for r in self.each(code, n)])

    def number(self, name: Column) -> Column:
        """The number of a name, null for one that no edge has."""
        if not self.names:
            return F.lit(None).cast("int")
        return F.try_element_at(F.map_from_arrays(F.lit(list(self.names)), F.lit(list(range(len(self.names)))).cast("array<int>")), name)

    def code(self, body: Column, n: int) -> Column:
        """The code of an array of n names, null if no edge has one of them."""
        numbers = [self.number(F.get(body, i)) for i in range(n)]
        known = reduce(lambda a, b: a & b, [x.isNotNull() for x in numbers])
        return F.when(known, reduce(self.then, numbers[1:], self.first(numbers[0])))


@dataclass
class Graph:
    """rows (rel by name, src, dst), an edge each, in the shared folder until release(); numbered edges with their ids.

    Nodes are text or numbers (long).
    """

    edges: DataFrame
    names: tuple[str, ...]
    rows: DataFrame
    folder: str
    known: dict[str, dict]
    held: list[DataFrame] = field(default_factory=list)

    @classmethod
    def of(cls, edges: DataFrame | Graph, factual_only: bool = True) -> Graph:
        """The graph of the edges that count; one that is a graph already stays as it is."""
        if isinstance(edges, Graph):
            return edges
        spark = edges.sparkSession
        kept = factual(edges, factual_only).select("eid", "src", "rel", "dst").where(F.col("rel").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
        folder = scratch(spark, "graph")
        flat = kept.select("rel", "src", "dst")
        flat.write.option("compression", "zstd").parquet(f"{folder}/rows")
        rows = spark.read.schema(flat.schema).parquet(f"{folder}/rows")
        known = [F.count("*").alias("n")]
        if dict(rows.dtypes)["src"] == "bigint":
            place = lambda c: F.col(c).bitwiseAND(F.lit((1 << KIND_BITS) - 1)).cast("int")
            known += [F.bit_or(F.call_function("shiftleft", F.lit(1), place(c))).alias(f"{c}_kinds") for c in ("src", "dst")]
            known += [F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high")]
        relations = {r["rel"]: r.asDict() for r in rows.groupBy("rel").agg(*known).limit(MOST_RELATIONS + 1).collect()}
        names = tuple(sorted(relations))
        if len(names) > MOST_RELATIONS:
            raise ValueError(f"more than {MOST_RELATIONS} relations")
        graph = cls(kept, names, rows, folder, relations)
        graph.edges = graph.numbered(kept)
        graph.tidy()
        return graph

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def numbered(self, rows: DataFrame) -> DataFrame:
        """rows with rel by number."""
        table = F.broadcast(self.spark.createDataFrame(list(zip(self.names, range(len(self.names)), strict=True)), "rel string, number int"))
        return rows.join(table, "rel").select(*[c for c in rows.columns if c != "rel"], F.col("number").alias("rel"))

    @cached_property
    def links(self) -> DataFrame:
        """rel as number, src, dst, n parallel edges, each once."""
        return self.hold(self.numbered(self.rows).groupBy("rel", "src", "dst").agg(F.count("*").alias("n")))

    def taking(self, relations: set) -> DataFrame:
        """Numbered rows of these relations. Few are picked by name, which lets files of others be skipped."""
        if len(relations) > SKIPPED:
            return self.numbered(self.rows).where(_in(F.col("rel"), relations))
        return self.numbered(self.rows.where(_in(F.col("rel"), {self.names[r] for r in relations})))

    def hold(self, df: DataFrame) -> DataFrame:
        """df, persisted until release()."""
        self.held.append(df.persist())
        return df

    def release(self) -> None:
        """Nothing that reads the graph may run any more."""
        while self.held:
            self.held.pop().unpersist()
        remove(self.spark, self.folder)

    @property
    def size(self) -> int:
        """Edges."""
        return sum(x["n"] for x in self.known.values())

    def slices(self, relations: set) -> int:
        """In how many the sources of these relations are taken."""
        return -(-sum(self.known[self.names[r]]["n"] for r in relations) // SLICE_ROWS) or 1

    @cached_property
    def coded(self) -> str | None:
        """The type that holds the nodes if they are numbers."""
        if dict(self.rows.dtypes)["src"] != "bigint":
            return None
        return "int" if all(x["low"] >= -(1 << 31) and x["high"] < 1 << 31 for x in self.known.values()) else "long"

    def tidy(self) -> None:
        """Let go of the shuffle files of past jobs, which stay until the driver happens to collect its garbage."""
        if self.size > SLICE_ROWS // 8:
            gc.collect()
            self.spark.range(1).count()  # until another job runs, the last one is held
            for _ in range(2):  # some are let go of only by what the first lets go of
                self.spark._jvm.System.gc()
                time.sleep(0.5)

    def name(self, rel: Column) -> Column:
        return Codes(self.names, 1).name(rel)

    def head_counts(self) -> DataFrame:
        """(rel by name, head_count): edges, parallel ones each."""
        return self.spark.createDataFrame([(rel, self.known[rel]["n"]) for rel in self.names], "rel string, head_count long")

    def functionality(self) -> DataFrame:
        """(rel by name, functionality): distinct sources by edge."""
        by_source = self.rows.groupBy("rel", "src").agg(F.count("*").alias("n"))
        return by_source.groupBy("rel").agg((F.count("*").cast("double") / F.sum("n").cast("double")).alias("functionality"))

    @cached_property
    def kinds(self) -> Kinds | None:
        """None for a vocabulary that bits of a long can't hold."""
        every = range(len(self.names))
        if not 0 < len(self.names) <= MOST_BITS:
            return None
        if self.coded and (known := self._kinds_of_numbers()):
            return known
        bits = F.broadcast(self.spark.createDataFrame([(name, 1 << i) for i, name in enumerate(self.names)], "rel string, bit long"))
        rows, none = self.rows.join(bits, "rel"), F.lit(0).cast("long")
        out = rows.select(F.col("src").alias("at"), F.col("bit").alias("starts"), none.alias("ends"), F.lit(1).cast("long").alias("out"))
        into = rows.select(F.col("dst").alias("at"), none.alias("starts"), F.col("bit").alias("ends"), none.alias("out"))
        nodes = out.unionByName(into).groupBy("at").agg(F.bit_or("starts").alias("starts"), F.bit_or("ends").alias("ends"), F.sum("out").alias("out"))
        kinds = nodes.groupBy("starts", "ends").agg(F.max("out").alias("out"))
        has = lambda c, i: F.col(c).bitwiseAND(F.lit(1 << i)) != 0
        each = [(f"{name}{i}", given, wanted, i) for name, given, wanted in (("f", "ends", "starts"), ("s", "starts", "starts"), ("e", "ends", "ends")) for i in every]
        row = kinds.agg(F.max("out").alias("out"), *[F.bit_or(F.when(has(given, i), F.col(wanted)).otherwise(none)).alias(c) for c, given, wanted, i in each]).first()
        self.tidy()
        sets = lambda name: {i: found for i in every if (found := {j for j in every if (row[f"{name}{i}"] or 0) >> j & 1})}
        return Kinds(sets("f"), sets("s"), sets("e"), row["out"] or 0)

    def _kinds_of_numbers(self) -> Kinds | None:
        """Kinds as far as the kinds of nodes tell, which may be too many; None if a relation might then come again."""
        meet = lambda a, b: {i: {j for j, y in enumerate(self.names) if self.known[x][a] & self.known[y][b]} for i, x in enumerate(self.names)}
        follows = {i: found for i, found in meet("dst_kinds", "src_kinds").items() if found}
        return None if repeating(follows, len(self.names) + 1) else Kinds(follows, meet("src_kinds", "src_kinds"), meet("dst_kinds", "dst_kinds"), None)

    def most_out(self, relations: set) -> int:
        """At least the most edges of these relations out of a node."""
        if self.kinds.most_out is not None:
            return self.kinds.most_out
        return self.taking(relations).groupBy(F.pmod(F.xxhash64("src"), F.lit(BUCKETS)).alias("bucket")).count().agg(F.max("count")).first()[0] or 0

    @cached_property
    def follows(self) -> dict[int, set[int]]:
        """Which relations start where a relation ends: one aggregate by node, whose sets few nodes differ in."""
        if self.kinds is not None:
            return self.kinds.follows
        out = self.links.select(F.col("src").alias("at"), F.col("rel").alias("starts"), F.lit(None).cast("int").alias("ends"))
        into = self.links.select(F.col("dst").alias("at"), F.lit(None).cast("int").alias("starts"), F.col("rel").alias("ends"))
        sets = out.unionByName(into).groupBy("at").agg(F.sort_array(F.collect_set("ends")).alias("ends"), F.sort_array(F.collect_set("starts")).alias("starts"))
        kinds = sets.where((F.size("ends") > 0) & (F.size("starts") > 0)).select("ends", "starts").distinct()
        pairs = kinds.select(F.explode("ends").alias("first"), "starts").select("first", F.explode("starts").alias("second")).distinct()
        found: dict[int, set[int]] = {}
        for row in pairs.groupBy("first").agg(F.collect_set("second").alias("seconds")).toLocalIterator():
            found[row["first"]] = set(row["seconds"])
        return found


@dataclass(frozen=True)
class Kinds:
    """By relation: which start where it ends, start where it starts, end where it ends. The most edges out of a node, if counted."""

    follows: dict[int, set[int]]
    beside: dict[int, set[int]]
    beyond: dict[int, set[int]]
    most_out: int | None


def joinable(edges: DataFrame) -> dict[str, set[str]]:
    """Which relations start where a relation ends, by name."""
    graph = Graph.of(edges, factual_only=False)
    found = {graph.names[a]: {graph.names[b] for b in bs} for a, bs in graph.follows.items()}
    graph.release()
    return found


def repeating(follows: dict, n: int) -> set:
    """Relations of walks of n steps over follows that hold some relation twice."""
    found: set = set()
    reach = {r: {r: 0} for r in follows}  # least steps from r to others, by breadth
    for r, seen in reach.items():
        border, steps = {r}, 0
        while border and steps < n - 1:
            steps += 1
            border = {b for a in border for b in follows.get(a, ())} - (set(seen) - {r})
            if r in border:
                found.add(r)  # r comes again after steps
                border.discard(r)
            for b in border:
                seen.setdefault(b, steps)
    if not found:
        return set()
    # A walk with a repeat visits, before, between or after, only relations within n steps of the repeated one.
    back: dict = {}
    for a, bs in follows.items():
        for b in bs:
            back.setdefault(b, set()).add(a)
    near = set(found)
    for graph in (follows, back):
        border = set(found)
        for _ in range(n):
            border = {b for a in border for b in graph.get(a, ())} - near
            near |= border
    return near


def allowed(relations: set, follows: dict, n: int, changed: set | None = None) -> list[tuple[set, set]]:
    """For each hop (relations to take, those among them that an untouched walk may end in) of walks of n hops.

    A walk must be able to go on to n hops; with changed, one of these must come, before or after.
    """
    forward = [set(relations)]
    for _ in range(n - 1):
        forward.append({b for a in forward[-1] for b in follows.get(a, ())})
    take: list[set] = [forward[-1]]
    for k in range(n - 2, -1, -1):
        take.insert(0, {a for a in forward[k] if follows.get(a, set()) & take[0]})
    if changed is None:
        return [(rels, rels) for rels in take]
    plans: list[tuple[set, set]] = [(take[-1], set())]
    hope = take[-1] & changed  # relations at the hop behind from which a changed one comes, itself included
    for k in range(n - 2, -1, -1):
        still = {a for a in take[k] if follows.get(a, set()) & hope}
        plans.insert(0, (take[k], still))
        hope = still | (take[k] & changed)
    return plans


@dataclass(frozen=True)
class Tally:
    """bodies (code, body_support) and closings (code, head, support, pca_denominator), heads by number."""

    bodies: DataFrame
    closings: DataFrame


@dataclass
class Walks:
    """(code, x, y): distinct ends of the walks of n edges of a graph, by the code of their relations; and their tally."""

    graph: Graph
    codes: Codes
    n: int
    made: Callable[[], DataFrame]
    counted: Callable[[], Tally | None]
    held: bool = False

    @cached_property
    def df(self) -> DataFrame:
        df = self.made()
        return self.graph.hold(df) if self.held else df

    @cached_property
    def tally(self) -> Tally | None:
        """Counted without a row for each pair of ends; None if the graph doesn't allow it, and rows must be counted."""
        return self.counted()

    def hold(self) -> Walks:
        self.held = True
        return self

    def done(self) -> None:
        """Release the graph if counts no longer need it."""
        if self.tally is not None:
            self.graph.release()

    def named(self, df: DataFrame) -> DataFrame:
        """df with body for its code."""
        return df.select(self.codes.body(F.col("code"), self.n).alias("body"), *[c for c in df.columns if c != "code"])

    def ends(self) -> DataFrame:
        """(body, x, y)."""
        return self.named(self.df)

    def only(self, bodies: DataFrame) -> Walks:
        """Those of the bodies (code)."""
        own = lambda df: df.join(bodies.select("code"), "code", "left_semi")
        counted = lambda: self.tally and Tally(own(self.tally.bodies), own(self.tally.closings))
        return Walks(self.graph, self.codes, self.n, lambda: own(self.df), counted)


def _in(rel: Column, relations: set) -> Column:
    return rel.isin(*sorted(relations)) if relations else F.lit(False)


def _limits(codes: Codes, n: int, prefixes: DataFrame | None, bodies: DataFrame | None) -> dict[int, DataFrame]:
    """By hop, the codes (code) that a walk may have there."""
    found = {}
    if prefixes is not None:
        found[2] = prefixes.select(codes.code(F.col("body"), 2).alias("code")).where("code IS NOT NULL").distinct()
    if bodies is not None:
        for k in range(1, n + 1):
            found[k] = bodies.where(codes.code(F.col("body"), n).isNotNull()).select(codes.code(F.slice("body", 1, k), k).alias("code")).distinct()
    return found


def _simple(graph: Graph, codes: Codes, n: int, plans: list[tuple[set, set]], changed: set | None, limits: dict[int, DataFrame]) -> DataFrame:
    """Walks over n different relations. No edge can come twice, so end points are made distinct after each hop."""
    walk = None
    for hop, (take, still) in enumerate(plans, 1):
        step = graph.links.where(_in(F.col("rel"), take)).select(F.col("rel").alias("next"), F.col("src").alias("at"), F.col("dst").alias("to"))
        if walk is None:
            walk = step.select(codes.first(F.col("next")).alias("code"), F.col("at").alias("x"), F.col("to").alias("y"))
        else:
            again = reduce(lambda a, b: a | b, [r == F.col("next") for r in codes.each(F.col("code"), hop - 1)])
            joined = walk.join(step, (F.col("y") == F.col("at")) & ~again)
            walk = joined.select(codes.then(F.col("code"), F.col("next")).alias("code"), "x", F.col("to").alias("y"))
        if changed is not None:
            taken = codes.each(F.col("code"), hop)
            walk = walk.where(reduce(lambda a, b: a | b, [_in(r, changed) for r in taken]) | _in(taken[-1], still))
        if hop > 1:
            walk = walk.distinct()
        if hop in limits:
            walk = walk.join(limits[hop], "code", "left_semi")
    return walk


def _repeated(graph: Graph, codes: Codes, n: int, near: set, limits: dict[int, DataFrame]) -> DataFrame:
    """Walks in which a relation comes twice; the edges taken ride along and must differ."""
    take = lambda rel, eid: F.struct(rel.alias("rel"), eid.alias("eid"))
    edges = graph.edges.where(_in(F.col("rel"), near))
    walk = edges.select(codes.first(F.col("rel")).alias("code"), F.array(take(F.col("rel"), F.col("eid"))).alias("taken"), F.col("src").alias("x"), F.col("dst").alias("y"))
    step = edges.select(F.col("eid").alias("by"), F.col("rel").alias("next"), F.col("src").alias("at"), F.col("dst").alias("to"))
    for hop in range(2, n + 1):
        fresh = ~F.exists("taken", lambda t: (t["rel"] == F.col("next")) & (t["eid"] == F.col("by")))
        joined = walk.join(step, (F.col("y") == F.col("at")) & fresh)
        walk = joined.select(codes.then(F.col("code"), F.col("next")).alias("code"), F.concat("taken", F.array(take(F.col("next"), F.col("by")))).alias("taken"), "x", F.col("to").alias("y"))
        if hop in limits:
            walk = walk.join(limits[hop], "code", "left_semi")
    return walk.where(F.size(F.array_distinct(F.transform("taken", lambda t: t["rel"]))) < n).select("code", "x", "y").distinct()


def _numbers(graph: Graph, relations: set) -> DataFrame:
    """(dst, number) of the nodes in which these relations end, numbered without gaps."""
    path = f"{graph.folder}/numbers-{uuid.uuid4().hex[:12]}"
    nodes = graph.taking(relations).select("dst").distinct()
    nodes.withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    held = graph.spark.read.schema("dst string, id long").parquet(path)
    task, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for row in held.groupBy(task.alias("task")).count().collect():  # a row for each task that wrote
        offsets.append((row["task"], before))
        before += row["count"]
    starts = F.broadcast(graph.spark.createDataFrame(offsets, "task long, before long"))
    kind = "int" if before < 1 << 31 else "long"
    return held.join(starts, task == F.col("task")).select("dst", (F.col("before") + place).cast(kind).alias("number"))


def _sets(rows: DataFrame) -> DataFrame:
    """(x, code, ys) with the ys of each x and code put together, distinct."""
    return rows.repartition("x").groupBy("x", "code").agg(F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys"))


def _numbered_ends(graph: Graph, rows: DataFrame, numbers: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows with the number of dst: of nodes that are numbers themselves, else that in numbers."""
    return rows.withColumn("number", F.col("dst").cast(graph.coded)) if numbers is None else rows.join(numbers, "dst", how)


def _planned(codes: Codes, follows: dict[int, set[int]], plans: list[tuple[set, set]]) -> list[tuple[int, ...]] | None:
    """The bodies over different relations that the plans allow; None if they are more than bits of a long."""
    found: list[tuple[int, ...]] = [(r,) for r in sorted(plans[0][0])]
    for take, _ in plans[1:]:
        found = [(*body, r) for body in found for r in sorted(follows.get(body[-1], set()) & take) if r not in body]
        if len(found) > MOST_BITS**2:
            return None
    return found


def _own(rows: DataFrame, i: int, slices: int) -> DataFrame:
    return rows if slices == 1 else rows.where(F.pmod(F.xxhash64("src"), F.lit(slices)) == i)


def _tallied(graph: Graph, codes: Codes, n: int, plans: list[tuple[set, set]], changed: set | None, prefixes: DataFrame | None) -> Tally | None:
    """The tally of walks over n different relations, made from their last edge to their first.

    What a walk's rest can reach from a node is one array, so that a hop ships an array an edge and not a row a pair of
    ends, and everything that is counted is counted beside its x. Sources are taken slice by slice.
    """
    spark, takes = graph.spark, [take for take, _ in plans]
    bodies = _planned(codes, graph.follows, plans)
    if bodies is not None:
        before = None if prefixes is None else {r["code"] for r in prefixes.select("code").collect()}  # of pairs of at most MOST_BITS relations
        pair = lambda body: body[0] << codes.bits | body[1]
        bodies = [b for b in bodies if (changed is None or changed & set(b)) and (before is None or pair(b) in before)]
        takes = [{b[hop] for b in bodies} for hop in range(n)]
    if not all(takes):
        empty = lambda *columns: spark.createDataFrame([], ", ".join(f"{c} long" for c in columns))
        return Tally(empty("code", "body_support"), empty("code", "head", "support", "pca_denominator").withColumn("head", F.col("head").cast("int")))
    closings = [(b, h) for b in bodies or () for h in sorted(graph.kinds.beside.get(b[0], set()) & graph.kinds.beyond.get(b[-1], set()))]
    beside = bodies is not None and n > 1 and len(bodies) + len({h for _, h in closings}) + len(closings) <= MOST_COLUMNS
    numbers = None if graph.coded else _numbers(graph, takes[-1])
    ends = None
    for hop in range(n - 1, -1, -1):
        if hop == 0 and beside:
            return _summed(graph, codes, n, bodies, closings, ends, numbers)
        kept, slices = scratch(spark, "tally") if hop == 0 else f"{graph.folder}/ends-{uuid.uuid4().hex[:12]}", graph.slices(takes[hop])
        for i in range(slices):
            schema = _hop(graph, codes, n, hop, i, slices, takes, ends, numbers, changed, prefixes, kept)
            graph.tidy()
        own_ends = spark.read.schema(schema).parquet(kept)
        if hop:
            ends = own_ends.withColumnRenamed("x", "m")
            longest = own_ends.agg(F.max(F.size("ys"))).first()[0] or 0
            if longest * max(1, graph.most_out(takes[hop - 1])) > MOST_ENDS:
                return None
    counts = own_ends.groupBy("code", "head").agg(F.sum("support").alias("support"), F.sum("reached").alias("reached"))
    found = counts.where("head < 0").select("code", F.col("reached").alias("body_support"))
    return Tally(found, counts.where("head >= 0 AND support > 0").select("code", "head", "support", F.col("reached").alias("pca_denominator")))


def _hop(graph: Graph, codes: Codes, n: int, hop: int, i: int, slices: int, takes: list[set], ends: DataFrame | None, numbers: DataFrame | None, changed: set | None, prefixes: DataFrame | None, kept: str):
    """Write one slice of a hop's sets, or of the counts if it is the first, to kept; its schema. What it read is let go of on return."""
    rest, rows = n - 1 - hop, _own(graph.taking(takes[hop]), i, slices)
    if ends is None:
        found = _numbered_ends(graph, rows, numbers).select(F.col("src").alias("x"), codes.first(F.col("rel")).alias("code"), F.array("number").alias("ys"))
    else:
        found = _joined(codes, rows, ends, rest).select("x", "code", "ys")
    if hop == 0 and changed is not None:
        found = found.where(reduce(lambda a, b: a | b, [_in(r, changed) for r in codes.each(F.col("code"), n)]))
    if hop == 0 and prefixes is not None:
        found = found.withColumn("prefix", F.shiftright("code", codes.bits * (n - 2))).join(prefixes.select(F.col("code").alias("prefix")), "prefix", "left_semi").drop("prefix")
    found = _sets(found)
    if hop == 0:
        found = _counts(graph, codes, found, takes, numbers, lambda rows: _own(rows, i, slices))
    found.write.mode("append").option("compression", "zstd").parquet(kept)
    return found.schema


def _joined(codes: Codes, rows: DataFrame, ends: DataFrame, rest: int) -> DataFrame:
    """(x, code, ys): the edges before the walks of `rest` edges whose ends are given, without repeated relations."""
    again = reduce(lambda a, b: a | b, [r == F.col("rel") for r in codes.each(F.col("code"), rest)])
    joined = rows.join(ends, (F.col("dst") == F.col("m")) & ~again)
    return joined.select(F.col("src").alias("x"), F.shiftleft(F.col("rel").cast("long"), codes.bits * rest).bitwiseOR(F.col("code")).alias("code"), "ys")


def _summed(graph: Graph, codes: Codes, n: int, bodies: list[tuple[int, ...]], closings: list[tuple[tuple[int, ...], int]], ends: DataFrame, numbers: DataFrame | None) -> Tally:
    """The tally by the ends (m, code, ys) of all edges but the first: one aggregate by x has an array for each body and head."""
    firsts, heads = {b[0] for b in bodies}, {h for _, h in closings}
    slices = graph.slices(firsts | heads)
    sums: dict[str, int] = {}
    for i in range(slices):
        row = _sums(graph, codes, n, bodies, closings, ends, numbers, lambda rows, i=i: _own(rows, i, slices))
        sums = {c: sums.get(c, 0) + (x or 0) for c, x in row.items()}
        graph.tidy()
    code = {b: reduce(lambda a, r: a << codes.bits | r, b) for b in bodies}
    found = [(code[b], x) for k, b in enumerate(bodies) if (x := sums[f"fan{k}"])]
    closed = [(code[b], h, x, sums[f"den{k}"]) for k, (b, h) in enumerate(closings) if (x := sums[f"sup{k}"])]
    return Tally(graph.spark.createDataFrame(found, "code long, body_support long"), graph.spark.createDataFrame(closed, "code long, head int, support long, pca_denominator long"))


def _sums(graph: Graph, codes: Codes, n: int, bodies: list[tuple[int, ...]], closings: list[tuple[tuple[int, ...], int]], ends: DataFrame, numbers: DataFrame | None, own: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """fan by body, sup and den by closing, of some sources."""
    heads = sorted({h for _, h in closings})
    place = {b: k for k, b in enumerate(bodies)}
    is_body = lambda b: F.col("code") == F.lit(reduce(lambda a, r: a << codes.bits | r, b)).cast("long")
    body = reduce(lambda when, b: when.when(is_body(b), F.lit(place[b])), bodies[1:], F.when(is_body(bodies[0]), F.lit(0)))
    rows = _joined(codes, own(graph.taking({b[0] for b in bodies})), ends, n - 1).select("x", "ys", body.alias("body"), F.lit(None).cast("int").alias("head")).where("body IS NOT NULL")
    if closings:
        closing = _numbered_ends(graph, own(graph.taking(set(heads))), numbers, "left")
        rows = rows.unionByName(closing.select(F.col("src").alias("x"), F.array("number").alias("ys"), F.lit(None).cast("int").alias("body"), F.col("rel").cast("int").alias("head")))
    lists = [F.collect_list(F.when(F.col("body") == k, F.col("ys"))).alias(f"b{k}") for k in range(len(bodies))]
    lists += [F.collect_list(F.when(F.col("head") == h, F.col("ys"))).alias(f"h{h}") for h in heads]
    sets = rows.repartition("x").groupBy("x").agg(*lists).select(*[F.array_distinct(F.flatten(f"b{k}")).alias(f"b{k}") for k in range(len(bodies))], *[F.flatten(f"h{h}").alias(f"h{h}") for h in heads])
    size, none = lambda c: F.size(c).cast("long"), F.lit(0).cast("long")
    each = [size(f"b{k}").alias(f"fan{k}") for k in range(len(bodies))]
    for k, (b, h) in enumerate(closings):
        own_b, own_h = f"b{place[b]}", f"h{h}"
        met = F.size(own_h) > 0
        each += [F.when(met & (F.size(own_b) > 0), size(F.array_intersect(own_b, own_h))).otherwise(none).alias(f"sup{k}"), F.when(met, size(own_b)).otherwise(none).alias(f"den{k}")]
    counted = sets.select(*each)
    return counted.agg(*[F.sum(c).alias(c) for c in counted.columns]).first().asDict()


def _counts(graph: Graph, codes: Codes, sets: DataFrame, takes: list[set], numbers: DataFrame | None, own: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(code, head, support, reached) of sets (x, code, ys): for each head beside its x, and for -1 as a body.

    Ends of a head that no walk ends in have no number; they count for the denominator only.
    """
    kinds = graph.kinds
    meets = {(last, head) for last in takes[-1] for head in kinds.beyond.get(last, ())}
    heads = {head for first in takes[0] for head in kinds.beside.get(first, ())} & {head for _, head in meets}
    closing = _numbered_ends(graph, own(graph.taking(heads)), numbers, "left").select(F.col("src").alias("x"), F.col("rel").alias("head"), "number")
    closing = closing.repartition("x").groupBy("x", "head").agg(F.collect_list("number").alias("ys"))
    closing = closing.groupBy("x").agg(F.collect_list(F.struct("head", "ys")).alias("heads"))
    last = F.col("code").bitwiseAND(F.lit((1 << codes.bits) - 1))
    met = lambda h: (last * MOST_BITS + h["head"]).isin(*sorted(a * MOST_BITS + b for a, b in meets)) if meets else F.lit(False)
    reached = F.size("ys").cast("long")
    count = lambda head, support: F.struct(head.cast("int").alias("head"), support.cast("long").alias("support"), reached.alias("reached"))
    closed = F.transform(F.filter("heads", met), lambda h: count(h["head"], F.size(F.array_intersect("ys", h["ys"]))))
    none = F.array(count(F.lit(-1), F.lit(0)))
    each = sets.join(closing, "x", "left").select("code", F.explode(F.concat(none, F.coalesce(closed, F.filter(none, lambda _: F.lit(False))))).alias("c"))
    return each.groupBy("code", "c.head").agg(F.sum("c.support").alias("support"), F.sum("c.reached").alias("reached"))


def paths(edges: DataFrame | Graph, n: int, *, factual_only: bool = True, changed: Sequence[str] | None = None, prefixes: DataFrame | None = None, bodies: DataFrame | None = None) -> Walks:
    """Distinct ends of the walks of n edges by their relations.

    changed keeps bodies with one of these relations. prefixes (body of two) restricts the first two hops, bodies (body
    of n) every hop, each before the next is joined.
    """
    graph = Graph.of(edges, factual_only)
    codes = Codes(graph.names, n)
    touched = None if not changed else {i for i, name in enumerate(graph.names) if name in set(changed)}
    plans = allowed(set(range(len(graph.names))), graph.follows, n, touched)
    limits = _limits(codes, n, prefixes, bodies)
    near = repeating(graph.follows, n)
    repeats = bool(near) and (touched is None or bool(near & touched))

    def made() -> DataFrame:
        found = _simple(graph, codes, n, plans, touched, limits)
        if not repeats:
            return found
        again = _repeated(graph, codes, n, near, limits)
        if touched is not None:
            again = again.where(reduce(lambda a, b: a | b, [_in(r, touched) for r in codes.each(F.col("code"), n)]))
        return found.unionByName(again)

    def counted() -> Tally | None:
        if repeats or bodies is not None or not codes.packed or graph.kinds is None:
            return None
        return _tallied(graph, codes, n, plans, touched, limits.get(2))

    return Walks(graph, codes, n, made, counted)


def body_supports(walks: Walks, limit: int | None = None) -> DataFrame:
    """(body, code, body_support), the most frequent first if there is a limit."""
    counted = walks.tally.bodies if walks.tally is not None else walks.df.groupBy("code").agg(F.count("*").alias("body_support"))
    if limit is not None:
        counted = counted.orderBy(F.desc("body_support"), "code").limit(limit)  # codes order as names do
    return walks.named(counted.withColumn("own", F.col("code"))).withColumnRenamed("own", "code")


def one_path(edges: DataFrame, body: Sequence[str]) -> DataFrame:
    """(x, y): distinct ends of the walks over exactly this body; inferred edges count."""
    return walk_ends([edges.where(F.col("rel") == rel) for rel in body], body)


def walk_ends(hops: Sequence[DataFrame], body: Sequence[str]) -> DataFrame:
    """(x, y): distinct ends of the walks whose i-th edge is a row of hops[i], all of relation body[i]."""
    n = len(body)
    walk = None
    for i, (rel, own) in enumerate(zip(body, hops, strict=True)):
        hop = own.select(F.col("eid").alias(f"e{i}"), F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"))
        if walk is None:
            walk = hop
            continue
        walk = walk.join(hop, f"n{i}")
        for j in range(i):
            if body[j] == rel:
                walk = walk.where(F.col(f"e{j}") != F.col(f"e{i}"))
        later = [f"e{j}" for j in range(i + 1) if body[j] in body[i + 1 :]]  # ids still needed
        walk = walk.select("n0", f"n{i + 1}", *later).distinct()
    return walk.select(F.col("n0").alias("x"), F.col(f"n{n}").alias("y")).distinct()
