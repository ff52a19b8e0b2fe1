"""Near duplicates of embeddings by an inverted multi-index.

Vectors are scaled to length 1 and cut in halves; a codebook for each half, trained on a bounded sample, makes a grid
of cells. Each vector is filed in the cell of its nearest codewords and asks the cells around it in the order of a
multi-sequence traversal: by the sum of its distance bounds to the half cells, nearest first. At a target recall of 1
it goes on while that bound leaves room for a link, so no link is missed; for a lower target the stop is calibrated
on a fixed number of queries over the cells, each against all vectors, such that every one of them reaches the target. Candidates are verified in double precision inside their cell, which adds up links and emits
the edges of a spanning forest only. Cells over `BLOCK` vectors are dealt to several tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import Forest, components

THRESHOLD = 0.9
TARGET_RECALL = 0.999
#: Vectors that the codebooks are fitted on.
SAMPLE = 8000
#: Vectors whose links with all others calibrate the stop, and how many of them must have links.
QUERIES = 4096
LEAST_LINKED = 100
#: Steps in which bounds are counted, and the least stop, as a share of the greatest.
STEPS = 2000
LEAST_SHARE = 0.01
#: Vectors a cell holds on average, and the most codewords of a half.
PER_CELL = 64
MAX_WORDS = 1024
#: Vectors of a cell that one task verifies.
BLOCK = 2048
#: Room for rounding in bounds, far below what a link can tell apart.
SLACK = 1e-7


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k codewords by Lloyd's method, from evenly spaced points of a fixed order."""
    order = np.lexsort(points.T[::-1])
    words = points[order[np.linspace(0, len(points) - 1, k).astype(int)]].copy()
    for _ in range(rounds):
        nearest = _squared(points, words).argmin(axis=1)
        for j in range(k):
            own = points[nearest == j]
            if len(own):
                words[j] = own.mean(axis=0)
    return np.unique(words, axis=0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)


@dataclass
class Grid:
    """A codebook for each half; limit: the greatest sum of squared bounds at which a cell is asked."""

    halves: tuple[np.ndarray, np.ndarray]
    limit: float

    def __post_init__(self) -> None:
        self.gaps = [np.sqrt(_squared(words, words)) for words in self.halves]

    def bounds(self, rows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(nearest codeword, squared lower bound of the distance to each codeword's cell) by half.

        A point of another cell lies beyond the plane halfway between the codewords, at least
        (d(x, other)^2 - d(x, own)^2) / (2 d(own, other)) away.
        """
        cut, nearest, low = rows.shape[1] // 2, [], []
        for words, gap, part in zip(self.halves, self.gaps, (rows[:, :cut], rows[:, cut:]), strict=True):
            d = _squared(part, words)
            own = d.argmin(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                away = (d - d[np.arange(len(d)), own][:, None]) / (2 * gap[own])
            away[np.arange(len(d)), own] = 0.0
            nearest.append(own)
            low.append(np.maximum(away, 0.0) ** 2)
        return nearest, low

    def asked(self, low: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int]]:
        """Cells in multi-sequence order of one vector's bounds, while their sum is within the limit."""
        order = [np.argsort(x, kind="stable") for x in low]
        sorted_low = [x[o] for x, o in zip(low, order, strict=True)]
        heap, seen = [(float(sorted_low[0][0] + sorted_low[1][0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound > self.limit:
                return
            yield int(order[0][i]), int(order[1][j])
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(order[0]) and b < len(order[1]) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (float(sorted_low[0][a] + sorted_low[1][b]), a, b))


def fit(sample: np.ndarray, total: int, threshold: float = THRESHOLD) -> Grid:
    """Codebooks for about total / PER_CELL cells, with the stop that misses no link."""
    rows = _unit(sample)
    k = int(max(1, min(MAX_WORDS, len(rows), round(math.sqrt(total / PER_CELL)))))
    cut = rows.shape[1] // 2
    return Grid((kmeans(rows[:, :cut], k), kmeans(rows[:, cut:], k)), 2 - 2 * threshold + SLACK)


def _needs(shared, threshold: float):
    """(query, step, n): how many links of the query need a stop of that step, counted over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, nodes, queries = shared.value
        low = grid.bounds(queries)[1]
        counts = np.zeros(len(queries) * (STEPS + 1), np.int32)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rows = _unit(_rows(part["data"]))
                q, x = np.nonzero((queries @ rows.T >= threshold) & (nodes[:, None] != part["node"].to_numpy(zero_copy_only=False)[None, :]))
                cells = grid.bounds(rows)[0]
                bound = low[0][q, cells[0][x]] + low[1][q, cells[1][x]]
                np.add.at(counts, q * (STEPS + 1) + np.minimum(np.ceil(bound / grid.limit * STEPS).astype(int), STEPS), 1)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at // (STEPS + 1)), pa.array(at % (STEPS + 1)), pa.array(counts[at].astype(np.int64))], ["query", "step", "n"])

    return run


def _queries(grid: Grid, rows: np.ndarray) -> np.ndarray:
    """Places of the rows to calibrate on: one of each cell, then a second and so on, so that no dense group crowds out others."""
    first, second = grid.bounds(rows)[0]
    taken: dict[tuple[int, int], int] = {}
    turn = np.zeros(len(rows), np.int64)
    for i, cell in enumerate(zip(first.tolist(), second.tolist(), strict=True)):
        turn[i] = taken[cell] = taken.get(cell, 0) + 1
    return np.argsort(turn, kind="stable")[:QUERIES]


def _calibrated(grid: Grid, distinct: DataFrame, nodes: np.ndarray, sample: np.ndarray, threshold: float, target_recall: float) -> Grid:
    """grid with the least stop at which each query finds target_recall of its own links; as it is if few queries have any."""
    rows = _unit(sample)
    picked = _queries(grid, rows)
    shared = distinct.sparkSession.sparkContext.broadcast((grid, nodes[picked], rows[picked]))
    needs = distinct.select("node", "data").mapInArrow(_needs(shared, threshold), "query long, step long, n long").groupBy("query", "step").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("query").orderBy("step")
    share = needs.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(Window.partitionBy("query")))
    stops = share.where(F.col("upto") >= F.lit(target_recall) * F.col("all")).groupBy("query").agg(F.min("step").alias("step"))
    found = stops.agg(F.count("*").alias("linked"), F.max("step").alias("step")).first()
    if found["linked"] >= LEAST_LINKED:
        grid.limit *= max(LEAST_SHARE, found["step"] / STEPS)
    return grid


def _valid(dims: int):
    """vec_id, data: each vector as little-endian doubles; null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch["embedding"].to_pylist():
                good = x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x) and any(x)
                # A second dimension lets single numbers be halved; + 0.0 leaves no negative zeros.
                out.append((np.array([*x, 0.0] if dims == 1 else x, "<f8") + 0.0).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(out, pa.binary())], ["vec_id", "data"])

    return run


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _placed(shared):
    """For each distinct vector a row in its own cell, which asks, and a row in each further cell that it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: Grid = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                if not part.num_rows:
                    continue
                nearest, low = grid.bounds(_unit(_rows(part["data"])))
                at, first, second, home = [], [], [], []
                for i in range(part.num_rows):
                    own = (int(nearest[0][i]), int(nearest[1][i]))
                    for cell in ((own, *(c for c in grid.asked((low[0][i], low[1][i])) if c != own))):
                        at.append(i)
                        first.append(cell[0])
                        second.append(cell[1])
                        home.append(cell == own)
                took = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(home, pa.bool_()), took["node"], took["copies"], took["data"]],
                    ["c1", "c2", "home", "node", "copies", "data"],
                )

    return run


class _Cell:
    """The filed vectors of a block, and the forest of those found linked."""

    def __init__(self, cell: tuple[int, int], grid: Grid, threshold: float, exact: bool):
        self.cell, self.grid, self.threshold, self.exact = cell, grid, threshold, exact
        self.parts: list[tuple] = []
        self.nodes: np.ndarray | None = None

    def add(self, *columns) -> None:
        self.parts.append(columns)

    def close(self) -> None:
        if self.nodes is None:
            self.nodes, self.copies, self.rows = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.back = np.zeros(len(self.nodes), np.int64)
            self.forest = Forest(len(self.nodes))
            self.low = None if self.exact else self.grid.bounds(self.rows)[1]

    def ask(self, nodes, copies, rows) -> tuple[list, list]:
        """[(asker, its links)], [edge]; links of filed vectors that do not ask back are counted in self.back."""
        self.close()
        links, edges = [], []
        for a in range(0, len(nodes), 256):
            part = slice(a, a + 256)
            near = rows[part] @ self.rows.T >= self.threshold
            near &= nodes[part, None] != self.nodes[None, :]
            counts = near @ self.copies
            links += [(int(x), int(n)) for x, n in zip(nodes[part], counts, strict=True) if n]
            if self.low is not None:
                cells = self.grid.bounds(rows[part])[0]
                deaf = (self.low[0][:, cells[0]] + self.low[1][:, cells[1]]).T > self.grid.limit
                self.back += copies[part] @ (near & deaf)
            asker = hub = -1
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                if i != asker:
                    asker, hub = i, j
                elif not self.forest.union(hub, j):
                    continue
                edges.append((int(nodes[a + i]), int(self.nodes[j])))
        return links, edges

    def rest(self) -> list[tuple[int, int]]:
        return [] if self.nodes is None else [(int(x), int(n)) for x, n in zip(self.nodes, self.back, strict=True) if n]


def _verify(shared, threshold: float, exact: bool):
    """src, dst, n: an edge, or with a null dst n links of src. Rows come by cell and block, the filed ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: Grid = shared.value
        place, cell = None, None

        def batch_of(links: list, edges: list) -> Iterator[pa.RecordBatch]:
            if links or edges:
                src, dst = [*(x for x, _ in links), *(x for x, _ in edges)], [*(None for _ in links), *(y for _, y in edges)]
                n = [*(n for _, n in links), *(None for _ in edges)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (src, dst, n)], ["src", "dst", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("c1", "c2", "block", "asks")])
            nodes, copies = (batch[c].to_numpy(zero_copy_only=False) for c in ("node", "copies"))
            rows = _unit(_rows(batch["data"]))
            cuts = [0, *(np.nonzero((np.diff(keys) != 0).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):  # noqa: B905
                here = tuple(keys[:3, low].tolist())
                if here != place:
                    if cell is not None:
                        yield from batch_of(cell.rest(), [])
                    place, cell = here, _Cell(here[:2], grid, threshold, exact)
                own = (nodes[low:high], copies[low:high], rows[low:high])
                if keys[3, low]:
                    yield from batch_of(*cell.ask(*own))
                else:
                    cell.add(*own)
        if cell is not None:
            yield from batch_of(cell.rest(), [])

    return run


def _dealt(placed: DataFrame, block: int) -> DataFrame:
    """placed with block and asks: filed vectors belong to one block of their cell, and every row asks all blocks."""
    sizes = placed.groupBy("c1", "c2").agg(F.count_if("home").alias("filed"), F.count("*").alias("here")).where("filed > 0 AND here > 1")
    blocks = placed.join(sizes.select("c1", "c2", F.ceil(F.col("filed") / block).cast("int").alias("blocks")), ["c1", "c2"])
    own = F.array(F.struct(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks")))
    all_blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(True).alias("asks")))
    goes = F.explode(F.when(F.col("home"), F.concat(own, all_blocks)).otherwise(all_blocks))
    dealt = blocks.withColumn("to", goes).select("c1", "c2", "to.block", "to.asks", "node", "copies", "data")
    return dealt.repartition("c1", "c2", "block").sortWithinPartitions("c1", "c2", "block", "asks")


def near_duplicates(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", threshold=THRESHOLD, target_recall=TARGET_RECALL, block=BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    Vectors that are null, empty, all zero, hold null or non-finite components or have another length than most link
    with nothing: n_links 0 and a component of their own. Equal vectors link with each other and share all links.
    Rows that share an id are rows of their own with that id; null ids never name a component unless all are null.
    kept: the row's id names its component. Empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    common = rows.groupBy(F.size("embedding").alias("dims")).count().where("dims > 0").orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 0
    checked = written(rows.mapInArrow(_valid(dims), "vec_id long, data binary"), "embed")
    groups = checked.where(F.col("data").isNotNull()).groupBy("data").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    distinct = written(groups.withColumn("node", F.monotonically_increasing_id()), "embed-distinct")
    total = distinct.count()
    if total:
        taken = distinct.orderBy(F.xxhash64("data")).limit(SAMPLE).select("node", "data").toArrow()
        sample = _rows(taken["data"].combine_chunks())
        grid = fit(sample, total, threshold)
        if target_recall < 1:
            grid = _calibrated(grid, distinct, taken["node"].to_numpy(), sample, threshold, target_recall)
        shared = spark.sparkContext.broadcast(grid)
        placed = written(distinct.select("node", "copies", "data").mapInArrow(_placed(shared), "c1 int, c2 int, home boolean, node long, copies long, data binary"), "embed-cells")
        found = _dealt(placed, block).mapInArrow(_verify(shared, threshold, target_recall >= 1), "src long, dst long, n long")
    else:
        found = spark.createDataFrame([], "src long, dst long, n long")
    found = written(found, "embed-links")
    counts = found.where(F.col("dst").isNull()).groupBy("src").agg(F.sum("n").alias("n"))
    tree = components(found.where(F.col("dst").isNotNull()).select("src", "dst"))
    linked = distinct.join(counts, F.col("node") == F.col("src"), "left").drop("src").join(tree.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    rooted = written(linked.select("data", "first", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root")), "embed-rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component"))
    labels = written(rooted.join(names, "root").select("data", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component"), "embed-labels")
    out = checked.join(labels, "data", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
