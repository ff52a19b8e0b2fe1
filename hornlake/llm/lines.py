"""Line dedup over levelled sorted runs of line hashes.

Batches of documents come in ascending id order. A batch's line hashes, one row per hash with the smallest id that
holds it, are merge-anti-joined with the sorted runs of earlier batches; what no run has becomes a new run of level 0.
When a level holds `fanout` runs they are merged to one run of the next level. Each hash lies in at most one run,
which names the owner, so a line of a later document is dropped if its owner is another document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, remove, scratch, slices, written

MIN_CHARS = 10
#: Batches of documents, and runs of a level that are merged to one of the next: of five batches four leave runs,
#: which end as one run of level 2.
BATCHES = 5
FANOUT = 2
SPACE = b" \t\n\x0b\x0c\r"
#: Null ids come after all others.
LAST_ID = (1 << 63) - 1


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Stripped, ASCII-lower-cased line; None if it has fewer than min_chars code points."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, hashes = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = {_digest(key) for key in (line_key(line, min_chars) for line in text.split(b"\n")) if key is not None}
                hashes += own
                ids += [doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64())], ["h", "doc_id"])

    return run


class RunStore:
    """Levels of sorted runs (h, owner) in the shared folder.

    A run is bucketed by h, a sorted file to each bucket, so that joins with it and merges of runs read the files in
    order, without a new shuffle or sort of the run. The session's scans keep that order while the store is open.
    """

    IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.before = spark.conf.get(self.IN_ORDER)
        spark.conf.set(self.IN_ORDER, "true")

    def _write(self, rows: DataFrame, dealt: bool = False) -> str:
        """A run of rows, which are dealt by bucket already if they come from a join of runs."""
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        self.paths[name] = scratch(self.spark, name)
        ordered = rows if dealt else rows.repartition(self.buckets, "h")
        ordered.write.option("path", self.paths[name]).option("compression", "zstd").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def owners(self, firsts: DataFrame) -> DataFrame:
        """firsts (h, doc_id, many) with the owner that an earlier run names, null for unseen hashes."""
        for i, run in enumerate(self.runs()):
            firsts = firsts.join(run.withColumnRenamed("owner", f"owner{i}").hint("merge"), "h", "left")
        named = [F.col(f"owner{i}") for i in range(len(self.runs()))]
        return firsts.select("h", "doc_id", "many", F.coalesce(*named, F.lit(None).cast("long")).alias("owner"))

    def add(self, rows: DataFrame) -> None:
        """A new run of level 0; full levels are compacted."""
        self.levels = self.levels or [[]]
        self.levels[0].append(self._write(rows))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self.merged(old), dealt=True))
            for name in old:
                self._drop(name)
            self.levels[level] = []
            level += 1

    def merged(self, names: list[str]) -> DataFrame:
        """The rows of several runs, no two of which hold the same hash, bucket by bucket."""
        found = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnRenamed("owner", "other")
            found = found.join(more.hint("merge"), "h", "full_outer").select("h", F.coalesce("owner", "other").alias("owner"))
        return found

    def close(self) -> None:
        self.spark.conf.set(self.IN_ORDER, self.before)
        for name in list(self.paths):
            self._drop(name)


def _batch_edges(docs: DataFrame, batches: int) -> list[int]:
    """Ids that part the documents into batches of about equal size, in ascending order."""
    if batches < 2:
        return []
    at = docs.select("doc_id").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02)
    return sorted({int(x) for x in at})


def _dropped(docs: DataFrame, min_chars: int, batches: int, fanout: int) -> list[DataFrame]:
    """For each batch the pairs (doc_id, h) of lines that go."""
    store = RunStore(docs.sparkSession, fanout)
    try:
        return _dropped_with(store, docs, min_chars, batches)
    finally:
        store.close()


def _dropped_with(store: RunStore, docs: DataFrame, min_chars: int, batches: int) -> list[DataFrame]:
    edges, found = _batch_edges(docs, batches), []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        lines = written(part.mapInArrow(_line_hashes(min_chars), "h binary, doc_id long"), "lines")
        firsts = lines.groupBy("h").agg(F.min("doc_id").alias("doc_id"), (F.min("doc_id") < F.max("doc_id")).alias("many"))
        owned = written(store.owners(firsts), "line-owners")
        if high is not None:
            store.add(owned.where(F.col("owner").isNull()).select("h", F.col("doc_id").alias("owner")))
        shared = owned.where(F.col("owner").isNotNull() | F.col("many")).select("h", F.coalesce("owner", "doc_id").alias("owner"))
        found.append(written(lines.join(shared, "h").where(F.col("owner") < F.col("doc_id")).select("doc_id", "h"), "line-drops"))
    return found


def _rewrite(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, dropped, kept = [], [], []
            for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True):
                lines = text.split(b"\n")
                counts.append(len(lines))
                if gone:
                    gone = set(gone)
                    stay = []
                    for line in lines:
                        key = line_key(line, min_chars)
                        if key is None or _digest(key) not in gone:
                            stay.append(line)
                    dropped.append(len(lines) - len(stay))
                    text = b"\n".join(stay)
                else:
                    dropped.append(0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["row", "n_lines", "n_dropped", "kept"]
            )

    return run


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def dedup_lines(docs: DataFrame, *, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, batches=BATCHES, fanout=FANOUT) -> DataFrame:
    """row (struct of docs' columns but text), n_lines, n_dropped, kept (text without the lines that a smaller id holds).

    Null or empty text is one empty line and kept is empty. Lines under min_chars code points stay. Repeats within a
    document stay if it owns the line and go if it does not. Rows that share an id count as one document; null ids
    count as one document after all others. A text of any length is split whole, in the memory of one worker. Empty
    table: no rows. Extra columns ride along in row.
    """
    keyed = docs.select(_order(F.col(id_col)).alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    gone = None
    for part in _dropped(keyed, min_chars, batches, fanout):
        gone = part if gone is None else gone.unionByName(part)
    per_doc = gone.groupBy("doc_id").agg(F.collect_set("h").alias("gone"))  # a document's own lines
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col]).alias("row")
    rows = docs.select(others, _order(F.col(id_col)).alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    joined = rows.join(per_doc, "doc_id", "left").select("row", "text", "gone")
    return joined.mapInArrow(_rewrite(min_chars), f"row {rows.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept binary")


LINES_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM split),
keyed AS (
  SELECT doc_id, place, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owned AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM keyed)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM owned GROUP BY doc_id
"""
