"""Substring dedup by content-defined chunking.

A gear rolling hash over 16 bytes is least, in each window of `WINDOW` places, at a chunk boundary. So boundaries depend
on content near them only, and a repeat of 15 + 2 * WINDOW bytes holds at least one chunk with the bytes that were hashed
for its first boundary, whatever surrounds it. These anchors are deduplicated by a 128-bit digest; those that other
documents hold too are extended, byte by byte, to where the repeat ends. Overlapping ones make up a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, slices, written

#: Places of a window, and bytes hashed at each.
WINDOW, HASHED = 48, 16
#: Least and greatest bytes of a chunk.
LEAST, MOST = 1, WINDOW
#: Bytes of a passage. Repeats of 15 + 2 * WINDOW = 111 bytes are found for certain, shorter ones mostly.
MIN_PASSAGE = 120
#: Null ids come after all others.
LAST_ID = (1 << 63) - 1
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 1) for i in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR[byte k places before] << k over 16 bytes, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of data: after the least hash of each window, the last one among equals."""
    n = len(data)
    if n <= WINDOW:
        return [n] if n else []
    least = gear_hashes(np.frombuffer(data, np.uint8)).astype(np.uint64) << np.uint64(32) | np.arange(n, 0, -1, dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, WINDOW - 32):  # windows of 2, 4, 8, 16, 32 and WINDOW places
        least = np.minimum(least[:-step], least[step:])
    ends = (n - np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64) + 1)[::-1].tolist()
    return ends if ends[-1] == n else [*ends, n]


def _halves(digests: list[bytes]) -> list[pa.Array]:
    """128-bit digests as two columns of longs, which take less room in a shuffle than binary ones."""
    both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64)
    return [pa.array(both[0::2]), pa.array(both[1::2])]


def _anchors(places: bool):
    """Digest of each chunk of a text with the HASHED bytes before it; with places also where that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part in slices(batches):
            sizes, digests, spans = [], [], []
            for text in part["text"].to_pylist():
                ends = boundaries(text)
                begins = [max(0, x - HASHED) for x in (0, *ends[:-1])] if ends else []
                own = [digest(text[a:b]) for a, b in zip(begins, ends, strict=True)]
                if places:
                    spans += [a << 32 | b for a, b in zip(begins, ends, strict=True)]
                else:
                    own = list(set(own))
                digests += own
                sizes.append(len(own))
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [*_halves(digests), part["doc_id"].take(at)]
            if places:
                columns += [part["body"].take(at), pa.array(spans, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["hi", "lo", "doc_id", "body", "span"][: len(columns)])

    return run


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each place with the bytes that follow it or, in reverse, those before it."""
    names = ["hi", "lo", "ahead", "doc_id", "body", "span", "first", "near"]
    for part in slices(batches, 100):
        places = part["places"].flatten()
        own = np.repeat(np.arange(part.num_rows), part["places"].value_lengths().to_numpy(zero_copy_only=False))
        texts, spans = part["text"].to_pylist(), places.field("span").to_numpy(zero_copy_only=False)
        near = [
            texts[i][stop : stop + WINDOW] if ahead else texts[i][max(0, start - WINDOW) : start][::-1]
            for i, start, stop, ahead in zip(own.tolist(), (spans >> 32).tolist(), (spans & 0xFFFFFFFF).tolist(), places.field("ahead").to_pylist(), strict=True)
        ]
        at = pa.array(own)
        columns = [places.field("hi"), places.field("lo"), places.field("ahead"), part["doc_id"].take(at), part["body"].take(at), places.field("span"), places.field("first"), pa.array(near, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names)


def _common(a: bytes, b: bytes) -> int:
    """Bytes that a and b begin with alike."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places as far as another document goes on alike. Rows come by digest, ahead, near and doc_id.

    In this order the nearest rows of other documents, before and after, share most with a row.
    """
    names = ("hi", "lo", "ahead", "doc_id", "near", "body", "span", "first")
    before, run, out = None, [], []  # the last row of the document before, and the rows of the one at hand

    def close(after: tuple | None) -> None:
        for row in run:
            more = max((_common(row[4], x[4]) for x in (before, after) if x is not None and x[:3] == row[:3]), default=0)
            if more:
                start, stop = row[6] >> 32, row[6] & 0xFFFFFFFF
                out.append((row[3], row[5], (start, stop + more) if row[2] else (start - more, stop), row[7]))

    def batch_of() -> pa.RecordBatch:
        docs, bodies, spans, firsts = zip(*out, strict=True)
        columns = (docs, bodies, [a << 32 | b for a, b in spans], firsts)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "body", "span", "first"])

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
            if run and row[:4] != run[-1][:4]:
                close(row)
                before, run = run[-1], []
            run.append(row)
        if out:
            yield batch_of()
    close(None)
    if out:
        yield batch_of()


def _start(span):
    return F.shiftright(span, 32).cast("int")


def _stop(span):
    return span.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, body; the last two tell the texts of one id apart."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    return rows.withColumn("body", F.xxhash64("text"))


def _placed(rows: DataFrame) -> DataFrame:
    """hi, lo, doc_id, body, span, first, run, ahead, back of anchors that other documents hold too.

    run numbers those of a text that overlap or meet; ahead and back: the anchor ends its run.
    """
    digest = ["hi", "lo"]
    held = rows.mapInArrow(_anchors(False), "hi long, lo long, doc_id long").groupBy(*digest)
    shared = held.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(*digest, "first")
    shared = written(shared, "chunk-shared")
    placed = rows.mapInArrow(_anchors(True), "hi long, lo long, doc_id long, body long, span long").join(shared, digest)
    inside = Window.partitionBy("doc_id", "body").orderBy("span")  # the anchors of one text
    back = F.coalesce(_start(F.col("span")) > _stop(F.lag("span").over(inside)), F.lit(True))
    ahead = F.coalesce(_start(F.lead("span").over(inside)) > _stop(F.col("span")), F.lit(True))
    marked = placed.withColumns({"back": back, "ahead": ahead})
    return written(marked.withColumn("run", F.sum(F.col("back").cast("int")).over(inside)), "chunk-placed")


def _runs(placed: DataFrame) -> DataFrame:
    """doc_id, body, span, first of each run; a text's anchors lie together in placed, so little of them is shuffled."""
    runs = placed.groupBy("doc_id", "body", "run").agg(F.min(_start(F.col("span"))).alias("start"), F.max(_stop(F.col("span"))).alias("stop"), F.min("first").alias("first"))
    return runs.select("doc_id", "body", F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("stop").cast("long")).alias("span"), "first")


def _joined(spans: DataFrame) -> DataFrame:
    """doc_id, body, start, stop, first_doc_id of the spans of a text, joined where they overlap or meet."""
    along = Window.partitionBy("doc_id", "body").orderBy("span")  # the spans of one text
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("new", F.when(F.max(_stop(F.col("span"))).over(before) >= _start(F.col("span")), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(along)).groupBy("doc_id", "body", "run")
    return runs.agg(F.min(_start(F.col("span"))).alias("start"), F.max(_stop(F.col("span"))).alias("stop"), F.min("first").alias("first_doc_id")).drop("run")


def _passages(docs: DataFrame, id_col: str, text_col: str, min_passage: int) -> DataFrame:
    """doc_id, body, start, stop, first_doc_id; LAST_ID for null."""
    rows = _rows(docs, id_col, text_col)
    placed = _placed(rows)
    sides = F.explode(F.array_compact(F.array(F.when(F.col("ahead"), F.lit(True)), F.when(F.col("back"), F.lit(False))))).alias("ahead")
    ends = placed.select("hi", "lo", sides).distinct()
    place = F.struct("hi", "lo", "ahead", "span", "first")
    wanted = placed.drop("ahead", "back").join(ends, ["hi", "lo"]).groupBy("doc_id", "body").agg(F.collect_set(place).alias("places"))
    kind = "hi long, lo long, ahead boolean, doc_id long, body long, span long, first long, near binary"
    near = rows.join(wanted, ["doc_id", "body"]).select("doc_id", "body", "text", "places").mapInArrow(_surroundings, kind)
    near = near.repartition("hi", "lo", "ahead").sortWithinPartitions("hi", "lo", "ahead", "near", "doc_id")
    spans = _runs(placed).unionByName(near.mapInArrow(_extended, "doc_id long, body long, span long, first long"))
    return _joined(spans).where(F.col("stop") - F.col("start") >= min_passage)


def _plain(column: str):
    return F.when(F.col(column) != LAST_ID, F.col(column)).alias(column)


def repeated_passages(docs: DataFrame, *, id_col="doc_id", text_col="text", min_passage=MIN_PASSAGE) -> DataFrame:
    """doc_id, start, stop (bytes of the text), first_doc_id of each passage that other documents hold as well.

    Every repeat of min_passage bytes, 111 at least, lies whole in a passage. What several documents hold of it is joined
    where it overlaps. first_doc_id is the smallest id that holds an anchor of the passage. Null and empty texts have no
    passage. Repeats within a document are none. Rows that share an id count as one document, and so do those without
    one, after all others; but passages are of a row's own text (equal rows have theirs once). Empty table: no rows.
    Other columns are not read.
    """
    return _passages(docs, id_col, text_col, min_passage).select(_plain("doc_id"), "start", "stop", _plain("first_doc_id"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        kept = []
        for text, cuts in zip(part["text"].to_pylist(), part["cuts"].to_pylist(), strict=True):
            pieces, at = [], 0
            for a, b in sorted((c["start"], c["stop"]) for c in cuts or ()):
                while a < b and text[a] & 0xC0 == 0x80:  # whole characters only
                    a += 1
                while a < b < len(text) and text[b] & 0xC0 == 0x80:
                    b -= 1
                pieces.append(text[at:a])
                at = b
            kept.append(b"".join([*pieces, text[at:]]))
        removed = [len(t.as_py()) - len(k) for t, k in zip(part["text"], kept, strict=True)]
        yield pa.RecordBatch.from_arrays([part["row"], pa.array(kept, pa.binary()), pa.array(removed, pa.int64())], ["row", "kept", "n_cut"])


def without_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", min_passage=MIN_PASSAGE) -> DataFrame:
    """row (struct of docs' columns but text), kept (text without chunks that a smaller id holds), n_cut (bytes).

    A chunk is cut if an earlier document holds its anchor and the chunks cut around it make up min_passage bytes, so
    each byte that goes stays with the first document that has it. Rows are kept one by one; edge cases as above.
    """
    rows = _rows(docs, id_col, text_col)
    later = _placed(rows).where(F.col("first") < F.col("doc_id")).select("doc_id", "body", "span", "first")
    whole = _joined(later).where(F.col("stop") - F.col("start") >= min_passage)
    cuts = whole.groupBy("doc_id", "body").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col]).alias("row")
    own = docs.select(others, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), as_bytes(F.col(text_col)).alias("text")).withColumn("body", F.xxhash64("text"))
    joined = own.join(cuts, ["doc_id", "body"], "left").select("row", "text", "cuts")
    return joined.mapInArrow(_cut, f"row {own.schema['row'].dataType.simpleString()}, kept binary, n_cut long")


def repeats_by_document(docs: DataFrame, *, id_col="doc_id", text_col="text", min_passage=MIN_PASSAGE) -> DataFrame:
    """doc_id, n_passages, repeated_bytes, first_doc_id, spans of each text with a repeated passage; edge cases as above."""
    passages = _passages(docs, id_col, text_col, min_passage)
    by_doc = passages.groupBy("doc_id", "body").agg(
        F.count("*").alias("n_passages"), F.sum(F.col("stop") - F.col("start")).cast("long").alias("repeated_bytes"), F.min("first_doc_id").alias("first_doc_id"),
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"),
    )
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias("spans")
    return by_doc.select(_plain("doc_id"), "n_passages", "repeated_bytes", _plain("first_doc_id"), spans)
