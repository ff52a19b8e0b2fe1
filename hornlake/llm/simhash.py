"""Near duplicates by SimHash with the generalised pigeonhole principle.

Fingerprints of 64 bits over word shingles link at `radius` differing bits or fewer. The bits are grouped into m
partitions, correlated bits together. Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 are allocated by dynamic
programming on candidate counts estimated from a sample: two fingerprints within the radius then agree within t_i in
some partition i. Each fingerprint is filed under its partition values and probes the values within t_i of its own;
candidates are verified on all bits inside their bucket, which emits only the edges of a spanning forest. A bucket
over `BLOCK` rows is dealt to several tasks, block against block.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as completion
from .common import as_bytes, drop_written, slices, written
from .components import Forest, components
from .shingles import SEED, shingle_hashes

WORDS = 3
#: Where no contract says otherwise: words of a shingle and similarity of documents.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
BITS = 64
RADIUS = 3
#: Fingerprints that the partitioning and the estimates are fitted on; the search itself covers all.
SAMPLE = 20_000
#: Rows of a bucket that one task compares with each other.
BLOCK = 2048
#: Candidate pairs verified in the time that a filed or probing row takes to be shuffled.
PAIRS_PER_ROW = 50
#: Shingles whose bits are summed at once.
SLICE = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash over the XXH64 of each shingle of ASCII-lower-cased words; 0 without words."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 without hashes."""
    ones = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), SLICE):
        part = np.ascontiguousarray(hashes[low : low + SLICE], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(x, words) for x in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values)], ["doc_id", "fp"])

    return run


@dataclass(frozen=True)
class Plan:
    """Partitions as lists of bit numbers, and their thresholds; -1 leaves a partition out."""

    parts: tuple[tuple[int, ...], ...]
    limits: tuple[int, ...]

    def probes(self) -> list[tuple[int, int, list[int]]]:
        """(partition, its mask, the flips to probe) of the partitions in use."""
        found = []
        for i, (bits, limit) in enumerate(zip(self.parts, self.limits, strict=True)):
            if limit >= 0:
                flips = [sum(1 << b for b in chosen) for k in range(1, limit + 1) for chosen in itertools.combinations(bits, k)]
                found.append((i, sum(1 << b for b in bits), flips))
        return found


def _grouped_bits(bits: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """Bits in m partitions of about equal width: each grows by the bit that correlates most with those it has."""
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0))
    corr = np.abs(centred.T @ centred) / np.maximum(np.outer(scale, scale), 1e-9)
    left, parts = set(range(BITS)), []
    for i in range(m):
        width = (BITS + i) // m
        order = sorted(left)
        own = [max(order, key=lambda b: (corr[b, order].sum(), -b))]
        left.discard(own[0])
        while len(own) < width:
            best = max(sorted(left), key=lambda b: (corr[b, own].mean(), -b))
            own.append(best)
            left.discard(best)
        parts.append(tuple(sorted(own)))
    return tuple(parts)


def _near_pairs(values: np.ndarray, bits: tuple[int, ...], limit: int) -> float:
    """Ordered pairs of the sample whose values differ in at most limit of the bits."""
    counts = Counter(values.tolist())
    total = sum(c * (c - 1) for c in counts.values())
    for k in range(1, limit + 1):
        for chosen in itertools.combinations(bits, k):
            flip = sum(1 << b for b in chosen)
            total += sum(c * counts.get(v ^ flip, 0) for v, c in counts.items())
    return float(total)


def choose_plan(sample: np.ndarray, total: int, radius: int = RADIUS, most_probes: int = 64) -> Plan:
    """The partitioning and allocation of least estimated cost for total fingerprints, from a sample of them."""
    sample = sample.astype(np.uint64)
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) if len(sample) else np.zeros((1, BITS))
    grow = (total / max(1, len(sample))) ** 2
    best: tuple[float, Plan] | None = None
    for m in range(2, radius + 3):
        parts = _grouped_bits(bits, m)
        cost = {}
        for i, own in enumerate(parts):
            values = sample & np.uint64(sum(1 << b for b in own))
            for limit in range(radius + 1):
                probes = sum(math.comb(len(own), k) for k in range(limit + 1))
                if probes <= most_probes:
                    cost[i, limit] = total * (probes + (limit > 0)) + grow * _near_pairs(values, own, limit) / PAIRS_PER_ROW
        # least[spent]: cost and limits of the partitions so far whose (limit + 1) sum to spent
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for i in range(m):
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for spent, (paid, limits) in least.items():
                for limit in range(-1, radius - spent + 1):
                    more = 0.0 if limit < 0 else cost.get((i, limit))
                    if more is not None:
                        step = (paid + more, (*limits, limit))
                        after[spent + limit + 1] = min(step, after.get(spent + limit + 1, (math.inf, ())))
            least = after
        if radius + 1 in least and (best is None or least[radius + 1][0] < best[0]):
            best = (least[radius + 1][0], Plan(parts, least[radius + 1][1]))
    assert best is not None  # radius + 1 partitions with thresholds 0 always fit
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probes(part: int, own, flips: list[int]):
    """Rows that probe the values around own."""
    return F.transform(F.lit([_signed(x) for x in flips]).cast("array<bigint>"), lambda flip: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(flip).alias("key"), F.lit(False).alias("filed")))


def _signatures(prints: DataFrame, plan: Plan) -> DataFrame:
    """(part, key, fp, filed): a filed row for each partition in use, and a row for each probe around it."""
    rows = []
    for i, mask, flips in plan.probes():
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        rows.append(F.array(F.struct(F.lit(i).alias("part"), own.alias("key"), F.lit(True).alias("filed"))))
        if flips:
            rows.append(_probes(i, own, flips))
    return prints.select("fp", F.explode(F.concat(*rows)).alias("s")).select("s.part", "s.key", "s.filed", "fp")


def _spread(signatures: DataFrame, block: int) -> DataFrame:
    """(part, key, block, asks, fp) of buckets with a pair to verify.

    A filed row belongs to one block of its bucket and asks the blocks before; probing rows ask all blocks.
    """
    sizes = signatures.groupBy("part", "key").agg(F.count_if("filed").alias("filed_here"), F.count("*").alias("here"))
    sizes = sizes.where((F.col("filed_here") > 0) & (F.col("here") > 1)).select("part", "key", F.ceil(F.col("filed_here") / block).cast("int").alias("blocks"))
    placed = signatures.join(sizes, ["part", "key"]).withColumn("home", F.when(F.col("filed"), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).otherwise(F.col("blocks")))
    upto = F.when(F.col("filed"), F.col("home")).otherwise(F.col("blocks") - 1)
    goes = placed.withColumn("block", F.explode(F.sequence(F.lit(0), upto)))
    return goes.select("part", "key", "block", (F.col("block") != F.col("home")).alias("asks"), "fp")


class _Bucket:
    """The filed fingerprints of a block, and the forest of those found linked."""

    def __init__(self, radius: int):
        self.radius, self.parts, self.members, self.forest = radius, [], None, None

    def add(self, fps: np.ndarray) -> None:
        self.parts.append(fps)

    def close(self) -> list[tuple[int, int]]:
        """Edges of a spanning forest of the members."""
        self.members = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        n = len(self.members)
        self.forest = Forest(n)
        edges = []
        if n <= 6:  # most buckets: plain integers are faster than arrays
            plain = self.members.tolist()
            pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if (plain[a] ^ plain[b]).bit_count() <= self.radius]
            return [(plain[a], plain[b]) for a, b in pairs if self.forest.union(a, b)]
        for low in range(0, n, 256):
            rows = self.members[low : low + 256]
            near = np.bitwise_count(rows[:, None] ^ self.members[None, low:]) <= self.radius
            for a, b in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                if a < b and self.forest.union(low + a, low + b):
                    edges.append((int(self.members[low + a]), int(self.members[low + b])))
        return edges

    def ask(self, fps: np.ndarray) -> list[tuple[int, int]]:
        """Edges that link the fps to the members' trees and join these trees."""
        edges = []
        if not len(self.members):
            return edges
        for low in range(0, len(fps), 256):
            part = fps[low : low + 256]
            near = np.bitwise_count(part[:, None] ^ self.members[None, :]) <= self.radius
            first = -1
            for a, b in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                if a != first:
                    first, hub = a, b
                    edges.append((int(part[a]), int(self.members[b])))
                elif self.forest.union(hub, b):
                    edges.append((int(part[a]), int(self.members[b])))
        return edges


def _verify(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, bucket = None, _Bucket(radius)
        for batch in batches:
            part, key, block = (batch[c].to_numpy(zero_copy_only=False) for c in ("part", "key", "block"))
            asks = batch["asks"].to_numpy(zero_copy_only=False)
            fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            edges: list[tuple[int, int]] = []
            if len(fps):
                new = (np.diff(part) != 0) | (np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)
                cuts = [0, *(np.nonzero(new)[0] + 1).tolist(), len(fps)]
                for low, high in zip(cuts, cuts[1:]):  # noqa: B905
                    here = (part[low], key[low], block[low])
                    if here != place:
                        if bucket.parts and bucket.members is None:
                            edges += bucket.close()
                        place, bucket = here, _Bucket(radius)
                    if not asks[low]:
                        bucket.add(fps[low:high])
                    else:
                        if bucket.members is None:
                            edges += bucket.close()
                        edges += bucket.ask(fps[low:high])
            if edges:
                yield _edge_batch(edges)
        if bucket.parts and bucket.members is None and (edges := bucket.close()):
            yield _edge_batch(edges)

    return run


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(edges, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["src", "dst"])


def links(prints: DataFrame, *, radius: int = RADIUS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(src, dst): edges that connect the distinct fingerprints (fp) just as all pairs within the radius would."""
    total = prints.count()
    if total < 2:
        return prints.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    picked = prints.orderBy(F.xxhash64("fp")).limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plan = choose_plan(picked, total, radius)
    dealt = _spread(_signatures(prints, plan), block).repartition("part", "key", "block").sortWithinPartitions("part", "key", "block", "asks")
    return dealt.mapInArrow(_verify(radius), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", words=WORDS, radius=RADIUS, block=BLOCK) -> DataFrame:
    """doc_id, fp (signed 64-bit), component_id (smallest id reachable by links) for each row of docs.

    Null and empty texts have fingerprint 0 and link like any other. Rows with equal fingerprints link; rows that share
    an id are rows of their own with that id. Null ids stay null and never name a component, whose id is null only
    if all its ids are. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    prints = written(rows.mapInArrow(_fingerprints(words), "doc_id long, fp long"), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    tree = components(links(distinct.select("fp"), radius=radius, block=block))
    rooted = written(distinct.join(tree, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = written(rooted.join(names, "root").select("fp", "component_id"), "simhash-labels")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", key_col=None, words=SIMILAR_WORDS, similarity=SIMILARITY, radius=RADIUS, block=BLOCK) -> DataFrame:
    """key (key_col, null without one), doc_id, group for each row of docs; rows share a group if links connect them.

    Rows link if the Jaccard similarity of their sets of shingles is at least `similarity`. Fingerprints within the
    radius name candidates, which are verified on the texts. At 0.8 texts differ in about 10 of 64 bits, more than the
    pigeonhole can probe for, so a prefix filter then finds the links between groups that fingerprints miss. Texts of
    fewer words are one shingle; those without a word (null and empty ones too) link with each other only. Null and
    repeated ids: rows of their own. Empty table: no rows. Other columns are not read.
    """
    key = (F.col(key_col) if key_col else F.lit(None)).cast("long").alias("key")
    rows = docs.select(key, F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    filed = completion.filed(rows, words, similarity, majority)
    prints = written(filed.select("fp", "node").distinct(), "simhash-prints")
    heads = written(prints.groupBy("fp").agg(F.min("node").alias("head")), "simhash-heads")
    alike = prints.join(heads, "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = links(heads.select("fp"), radius=radius, block=block)
    side = lambda fp, node: heads.select(F.col("fp").alias(fp), F.col("head").alias(node))
    across = near.join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("a", "b")
    found = completion.grouped(filed, alike.unionByName(across), words, similarity, block)
    for done in (prints, heads):
        drop_written(done)
    return found
