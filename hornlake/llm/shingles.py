"""Shingle sets, and what SimHash's near duplicates by similarity need beside fingerprints: exact verification, and a
prefix filter that finds the pairs that fingerprints miss.

The distinct shingles of a text are ordered by how often a sample holds them, rarest first, then by hash. Two sets of
similarity s or more share a shingle within the first n - ceil(s n) + 1 of each, whatever the order, so filing sets
under these finds every pair. In each bucket neighbours by size are verified first; then only sets that are still in
different components are compared with each other, large buckets tile by tile.

A sketch of a set holds, for each of BITS places (in its wide form as many as the set has shingles, or more), whether an odd number of its shingles fall there. Two sketches differ
in no more bits than the sets differ in shingles, and sets of similarity s differ in at most (1 - s) / (1 + s) of both
sizes. So pairs whose sketches differ in more are ruled out for certain; all others are verified on the texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, slices, written
from .components import components

SEED = 42
#: Texts whose shingles are counted for the order, and the most shingles that the order tells apart by count.
SAMPLE = 20_000
MOST_COUNTED = 1 << 19
#: Bits of the sketches in the rows of open buckets, where more would cost as much a row; wide ones are powers of two from here.
BITS = 512
#: Rows of a bucket that one task compares with each other.
BLOCK = 2048
#: Pairs that a task gives out at once.
PAIRS = 10_000
#: Room for rounding in products with the similarity.
SLACK = 1e-9


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of ASCII-lower-cased words; all words make one if they are fewer, none make none."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = list(itertools.accumulate(len(t) + 1 for t in tokens))
    digest = xxhash.xxh64_intdigest
    own = (digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends[: n - 1]], ends[min(words, len(tokens)) - 1 :], strict=True))
    return np.fromiter(own, np.uint64, n)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, words))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - SLACK


def sketch(own: np.ndarray) -> bytes:
    """The wide sketch: for each place whether an odd number of the distinct hashes fall there."""
    places = max(BITS, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(wide: bytes, width: int = BITS // 8) -> bytes:
    """The sketch of the same set in `width` bytes."""
    found = np.frombuffer(wide, np.uint8)
    while len(found) > width:
        half = len(found) // 2
        found = found[:half] ^ found[half:]
    return found.tobytes()


def _sketches(each: list[bytes]) -> np.ndarray:
    """Sketches of one width, a row each."""
    return np.frombuffer(b"".join(each), np.uint64).reshape(len(each), -1) if each else np.zeros((0, 1), np.uint64)


def possible(a: np.ndarray, size_a, b: np.ndarray, size_b, similarity: float) -> np.ndarray:
    """Whether sketches and sizes leave it open that sets are similar; false is certain."""
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return apart * (1 + similarity) <= (1 - similarity) * (size_a + size_b) + SLACK * (size_a + size_b)


def _counted(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [shingles(x, words) for x in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], ["shingle"])

    return run


def _order(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order of hash, how many texts of the sample hold each) of those that several hold."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text").distinct()
    counts = picked.mapInArrow(_counted(words), "shingle long").groupBy("shingle").count().where("count > 1")
    top = counts.orderBy(F.desc("count"), "shingle").limit(MOST_COUNTED).toArrow()
    hashes = top["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    return hashes[by_hash], top["count"].to_numpy().astype(np.int64)[by_hash]


FILED = "key long, doc_id long, text binary, fp long, node long, size int, wide binary, narrow binary, prefix array<long>"


def _filed(shared, words: int, similarity: float, fingerprint):
    """FILED: node is a digest of the set, prefix holds the shingles that the set is filed under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = shared.value
        for part in slices(batches):
            prints, nodes, sizes, wide, prefixes = [], [], [], [], []
            for text in part["text"].to_pylist():
                each = shingle_hashes(text, words)
                own = np.unique(each)
                n = len(own)
                often = np.zeros(n, np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    often = np.where(hashes[at] == own, counts[at], 0)
                most = n - math.ceil(similarity * n - SLACK) + 1 if n else 0
                prints.append(fingerprint(each))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(n)
                wide.append(sketch(own))
                prefixes.append(own[np.lexsort((own, often))[:most]].view(np.int64))
            digests = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, nodes)]
            arrays = [*digests, pa.array(sizes, pa.int32()), *[pa.array(x, pa.binary()) for x in (wide, [folded(y) for y in wide])], pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part["key"], part["doc_id"], part["text"], *arrays], [x.split()[0] for x in FILED.split(", ")])

    return run


def filed(rows: DataFrame, words: int, similarity: float, fingerprint) -> DataFrame:
    """FILED for rows (key, doc_id, text); fp is the fingerprint of a text's shingles, repeats included."""
    shared = rows.sparkSession.sparkContext.broadcast(_order(rows, words))
    return written(rows.mapInArrow(_filed(shared, words, similarity, fingerprint), FILED), "shingle-sets")


def _neighbours(similarity: float):
    """shingle, node, size and the node before in the bucket, if its size allows a link. Rows come by shingle, size and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, and whether it is out already
        for batch in batches:
            out = []
            for row in zip(*(batch[c].to_pylist() for c in ("shingle", "size", "node")), strict=True):
                if last is not None and row == last[0]:
                    continue
                if last is not None and row[0] == last[0][0]:
                    if not last[1]:
                        out.append((*last[0], None))
                    out.append((*row, last[0][2] if last[0][1] >= similarity * row[1] - SLACK else None))
                    last = (row, True)
                else:
                    last = (row, False)
            if out:
                shingle, size, node, before = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingle, pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(before, pa.int64())], ["shingle", "node", "size", "before"])

    return run


def _across(similarity: float):
    """a, b: possible pairs of a tile in different components. Rows come by shingle, tile (low, high), size and node.

    A tile holds two blocks of a bucket, whose rows are compared across, or one, whose rows are compared with each other.
    """

    def pairs(tile: list[tuple], apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size, node, root, block = (np.array(x, np.int64) for x in zip(*(row[:4] for row in tile), strict=True))
        sketches = _sketches([row[4] for row in tile])
        for i in range(len(tile) - 1):
            end = int(np.searchsorted(size, (size[i] + SLACK) / similarity, side="right"))
            fits = root[i + 1 : end] != root[i]
            if apart:
                fits &= block[i + 1 : end] != block[i]
            at = i + 1 + np.flatnonzero(fits)
            at = at[possible(sketches[at], size[at], sketches[i], size[i], similarity)]
            if len(at):
                yield np.minimum(node[at], node[i]), np.maximum(node[at], node[i])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        place, tile = None, []
        for batch in batches:
            for shingle, low, high, *row in zip(*(batch[c].to_pylist() for c in ("shingle", "low", "high", "size", "node", "root", "block", "narrow")), strict=True):
                if (shingle, low, high) != place:
                    if len(tile) > 1:
                        yield from pairs(tile, place[1] < place[2])
                    place, tile = (shingle, low, high), []
                tile.append(tuple(row))
        if len(tile) > 1:
            yield from pairs(tile, place[1] < place[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["a", "b"])

        held, rows = [], 0
        for found in tiles(batches):
            held.append(found)
            rows += len(found[0])
            if rows >= PAIRS:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    return run


def _possible(similarity: float):
    """a, b: those pairs whose wide sketches, folded to the lesser width, leave it open that they are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ends = [part[f"wide_{x}"].to_pylist() for x in "ab"]
            sizes = [part[f"size_{x}"].to_numpy().astype(np.int64) for x in "ab"]
            widths = np.array([min(map(len, pair)) for pair in zip(*ends, strict=True)])
            keep = np.zeros(len(widths), bool)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                a, b = (_sketches([folded(own[i], width) for i in at]) for own in ends)
                keep[at] = possible(a, sizes[0][at], b, sizes[1][at], similarity)
            kept = part.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept["a"], kept["b"]], ["a", "b"])

    return run


def _verified(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 100):
            known: dict[int, np.ndarray] = {}
            keep = []
            for ends in zip(*(part[c].to_pylist() for c in ("a", "text_a", "b", "text_b")), strict=True):
                for node, text in (ends[:2], ends[2:]):
                    if node not in known:
                        known[node] = shingles(text, words)
                keep.append(similar(known[ends[0]], known[ends[2]], similarity))
            kept = part.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept["a"], kept["b"]], ["src", "dst"])

    return run


def _sided(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of both nodes, as column_a and column_b."""
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
    return pairs


def _links(pairs: DataFrame, filed: DataFrame, words: int, similarity: float) -> DataFrame:
    """(src, dst): those pairs (a, b) whose texts are similar."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = written(filed.select("node", "text").join(ends, "node", "left_semi").dropDuplicates(["node"]), "shingle-texts")
    both = _sided(pairs, texts, ["text"]).select("a", "text_a", "b", "text_b")
    found = written(both.mapInArrow(_verified(words, similarity), "src long, dst long"), "shingle-links")
    drop_written(texts)
    return found


def _tiled(rows: DataFrame, buckets: DataFrame, block: int) -> DataFrame:
    """rows of buckets (shingle, rows) with the tiles they go to: all pairs of a bucket's blocks of about `block` rows."""
    blocks = F.ceil(F.col("rows") / block).cast("int")
    dealt = rows.join(buckets.select("shingle", blocks.alias("blocks")), "shingle").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("shingle", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "size", "node", "root", "block")


def grouped(filed: DataFrame, candidates: DataFrame, words: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """key, doc_id, group for filed: candidates (a, b) by node and neighbours are verified first, then what is left between groups.

    The result is a written table; filed and all tables between are deleted.
    """
    nodes = written(filed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "wide", "narrow")]), "shingle-nodes")
    place = ["shingle", "size", "node"]
    dealt = filed.select(F.explode("prefix").alias("shingle"), "size", "node").repartition("shingle").sortWithinPartitions(*place)
    near = written(dealt.mapInArrow(_neighbours(similarity), "shingle long, node long, size int, before long"), "shingle-near")
    pairs = near.where("before IS NOT NULL").select(F.col("node").alias("a"), F.col("before").alias("b")).unionByName(candidates.where("a <> b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    open_ = lambda found: _sided(found, nodes, ["size", "wide"]).mapInArrow(_possible(similarity), "a long, b long")
    first = written(open_(pairs), "shingle-pairs")
    links = _links(first, filed, words, similarity)
    tree = written(components(links).withColumnRenamed("node", "member"), "shingle-tree")
    rooted = near.join(tree, F.col("node") == F.col("member"), "left").select(*place, F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "shingle-rooted")
    buckets = rooted.groupBy("shingle").agg(F.count("*").alias("rows"), F.min("root").alias("least"), F.max("root").alias("most"))
    tiled = _tiled(rooted, buckets.where("least < most"), block).join(nodes.select("node", "narrow"), "node")
    tiled = tiled.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "size", "node")
    across = tiled.mapInArrow(_across(similarity), "a long, b long").distinct()
    second = written(open_(across.join(first, ["a", "b"], "left_anti")), "shingle-pairs")
    more = _links(second, filed, words, similarity)
    whole = written(components(links.unionByName(more)), "shingle-tree")
    labels = filed.select("key", "doc_id", "node").join(whole, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("group"))
    labels = written(labels, "shingle-groups")
    for done in (filed, nodes, near, first, links, tree, rooted, second, more, whole):
        drop_written(done)
    return labels
