"""WARC archives: write one record a page, read them back in splits by boundary-chain verification.

Archives are written by Spark's text sink and read by its splittable text source, so any file system that Spark knows
will do. Reading cuts the bytes at every occurrence of the magic, in parallel; each cut is a candidate record whose
Content-Length names a successor offset. Magic inside payloads yields candidates too: pointer jumping from offset 0
of each file keeps those that the chain of successors reaches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, drop_written, scratch, written

#: Fixed values of the format (ISO 28500).
MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
#: Records of a file; bounds what pointer jumping needs to cover. Files are read in splits, whatever their size.
RECORDS_PER_FILE = 10_000
#: Payloads of at least so many bytes are written once, later copies as revisits.
MIN_REVISIT = 0
#: Tasks that the rows of one payload are dealt to.
SPREAD = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: The base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _base32(sha1_hex: Column) -> Column:
    """Base32 of a SHA-1 in hex: every 5 hex digits are 20 bits, 4 letters."""
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(sha1_hex, 1 + 5 * i, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _header(revisit: Column) -> Column:
    """The header of a record, without the magic in front."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string")),
    )


def write_warc(pages: DataFrame, path: str, *, id_col="page_id", url_col="url", payload_col="html", min_revisit=MIN_REVISIT, compression="none") -> None:
    """One record for each row of pages into archives under path.

    Of the rows with equal payloads of at least min_revisit bytes, that with the smallest id is a response and the
    others revisit it. Null payloads count as empty ones, null urls leave the header out, null ids come last and
    repeated ids are rows of their own: all rows of a payload that share its smallest id are responses. Empty table: no
    records. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), as_bytes(F.col(payload_col)).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "hex": F.sha1("payload")})
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id")
    groups = rows.where(F.col("size") >= min_revisit).groupBy("hex").agg(F.min(order).alias("at"), F.count("*").alias("n"))
    copied = written(groups.where(F.col("n") > 1).select("hex", F.col("at.page_id").alias("first"), F.lit(True).alias("copied")), "warc-copied")
    linked = _linked(rows, copied).withColumn("digest", _base32(F.col("hex")))
    revisit = F.coalesce(F.col("copied") & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    record = F.concat(F.lit(MAGIC), _header(revisit), F.lit(BREAK), body)
    writer = linked.select(record.alias("value")).write.option("lineSep", BREAK).option("compression", compression)
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


#: Digests of copied payloads that are broadcast at most; 57 bytes each.
MOST_BROADCAST = 1 << 18


def _linked(rows: DataFrame, copied: DataFrame) -> DataFrame:
    """rows with first and copied of their digest.

    A few digests are broadcast. For more, a digest is looked up apart from the payloads: rows are dealt by digest and
    one of SPREAD numbers, so that a payload that many rows share does not land in one task.
    """
    if copied.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(copied), "hex", "left")
    dealt = rows.withColumn("spread", F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)).cast("int"))
    each = copied.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(each, ["hex", "spread"], "left").drop("spread")


def _field(header: bytes, name: bytes) -> str | None:
    at = header.find(b"\r\n" + name + b": ")
    if at < 0:
        return None
    at += len(name) + 4
    end = header.find(b"\r\n", at)
    return header[at : end if end >= 0 else len(header)].decode("utf-8", "replace")


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def _page(text: str | None) -> int | None:
    inner = text[len("<urn:page:") : -1] if text and text.startswith("<urn:page:") else ""
    return int(inner) if inner.lstrip("-").isdigit() else None


CANDIDATE = "file string, block long, rel long, bytes long, successor long, whole boolean, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _candidate(cut: bytes) -> tuple:
    """What the bytes after a magic say: length of the record from the magic on, whether the payload is whole, fields."""
    end = cut.find(BREAK.encode())
    length = _number(_field(b"\r\n" + cut[:end], b"Content-Length")) if end >= 0 else None
    if length is None:
        return None, False, None, None, None, None, None
    header, start = b"\r\n" + cut[:end], end + len(BREAK)
    whole = start + length <= len(cut)
    kind = _field(header, b"WARC-Type")
    if kind == "revisit":
        size, digest = _number(_field(header, b"X-Payload-Length")), (_field(header, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
    else:
        size, digest = length, _digest(cut[start : start + length]) if whole else None
    step = len(MAGIC) + start + length + len(BREAK)
    return step, whole, _page(_field(header, b"WARC-Record-ID")), size, digest, kind, _page(_field(header, b"WARC-Refers-To"))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, rel = None, 0
    for batch in batches:
        rows = []
        for file, block, cut in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["cut"].to_pylist(), strict=True):
            if (file, block) != place:
                place, rel = (file, block), 0
            rows.append((file, block, rel, len(cut), *_candidate(cut)))
            rel += len(cut) + len(MAGIC)
        types = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in CANDIDATE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magics with the file and split they were read from, in order within a split."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("cut"))


def _placed(found: DataFrame) -> DataFrame:
    """Candidates with their offset in the file: a split starts where the bytes of the splits before it end."""
    ends = found.groupBy("file", "block").agg((F.max(F.col("rel") + F.col("bytes")) + len(MAGIC)).alias("bytes_here"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # splits of a file
    starts = ends.select("file", "block", F.coalesce(F.sum("bytes_here").over(before), F.lit(0)).alias("start"))
    placed = found.join(starts.hint("merge"), ["file", "block"]).withColumn("offset", F.col("start") + F.col("rel") - len(MAGIC))
    return placed.where(F.col("offset") >= 0).drop("start").withColumn("successor", F.col("offset") + F.col("successor"))


def _reachable(placed: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from offset 0 of each file, by pointer jumping."""
    jump = placed.where(F.col("successor").isNotNull()).select("file", "offset", "successor")
    reach = placed.where(F.col("offset") == 0).select("file", "offset")
    most = placed.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    stages, covered = [], 1
    while covered < most:
        for _ in range(2):  # two doublings a table
            hop = jump.withColumnRenamed("successor", "to").hint("merge")  # both sides grow with the archives
            reach = reach.unionByName(reach.join(hop, ["file", "offset"]).select("file", F.col("to").alias("offset"))).distinct()
            after = jump.select("file", F.col("offset").alias("to"), F.col("successor").alias("then"))
            jump = hop.join(after.hint("merge"), ["file", "to"]).select("file", "offset", F.col("then").alias("successor"))
            covered *= 2
        reach, jump = written(reach, "warc-reach"), written(jump, "warc-jump")
        for old in stages:
            drop_written(old)
        stages = [reach, jump]
    return reach


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for pieces, size in zip(batch["pieces"].to_pylist(), batch["payload_bytes"].to_pylist(), strict=True):
            data = MAGIC.encode().join(p["cut"] for p in sorted(pieces, key=lambda p: p["offset"]))
            start = data.find(BREAK.encode()) + len(BREAK)
            digests.append(_digest(data[start : start + size]) if start + size <= len(data) else None)
        yield pa.RecordBatch.from_arrays([batch["file"], batch["offset"], pa.array(digests, pa.string())], ["file", "offset", "digest"])


def _keyed_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, rel = None, 0
    for batch in batches:
        rels = []
        for file, block, size in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), (len(x) for x in batch["cut"].to_pylist()), strict=True):
            if (file, block) != place:
                place, rel = (file, block), 0
            rels.append(rel)
            rel += size + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], pa.array(rels, pa.int64()), batch["cut"]], ["file", "block", "rel", "cut"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records that the chain of each file reaches.

    Candidates in payloads, broken ones included, are left out. A payload that holds the magic is put together from
    its cuts. A payload that its file cuts short has a null digest. No archive or no record: no rows.
    """
    placed = written(_placed(written(_cuts(spark, path).mapInArrow(_candidates, CANDIDATE), "warc-cuts")), "warc-placed")
    reach = _reachable(placed)
    records = placed.join(reach.hint("merge"), ["file", "offset"], "left_semi")
    kept = records.select("file", "offset", "whole", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    partial = written(records.where(~F.col("whole")).select("file", "offset", "successor", "payload_bytes"), "warc-partial")
    if partial.isEmpty():
        return kept.drop("file", "offset", "whole")
    # Candidates of a file lie in at most RECORDS_PER_FILE records; the last record at or before one holds it.
    owner = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = placed.join(partial.select("file", "offset", F.col("offset").alias("owner"), F.col("successor").alias("stop"), F.col("payload_bytes").alias("size")), ["file", "offset"], "left")
    held = F.last(F.when(F.col("owner").isNotNull(), F.struct("owner", "stop", "size")), ignorenulls=True).over(owner)
    needed = written(marked.withColumn("held", held).where(F.col("offset") < F.col("held.stop")).select("file", "block", "rel", "offset", "held"), "warc-needed")
    cuts = _cuts(spark, path).mapInArrow(_keyed_cuts, "file string, block long, rel long, cut binary")
    pieces = cuts.join(needed, ["file", "block", "rel"]).groupBy("file", F.col("held.owner").alias("owner"), F.col("held.size").alias("payload_bytes"))
    whole = pieces.agg(F.collect_list(F.struct("offset", "cut")).alias("pieces")).select("file", F.col("owner").alias("offset"), "payload_bytes", "pieces")  # one record's bytes
    digests = whole.mapInArrow(_joined, "file string, offset long, digest string")
    return kept.join(digests, ["file", "offset"], "left").select("page_id", "payload_bytes", F.coalesce("payload_digest", "digest").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, *, compression="none", **options) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    path = scratch(pages.sparkSession, "warc")
    write_warc(pages, path, compression=compression, **options)
    return read_warc(pages.sparkSession, path)


WARC_SQL = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages),
bits AS (
  SELECT *, list_aggregate(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
         1 + 4 * (strpos('0123456789abcdef', substr(hex, (i + 1)::INT, 1)) - 1), 4)), 'string_agg', '') AS b FROM sized)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5),
         lambda j: (substr(b, (5 * i + j + 1)::INT, 1)::INT << (4 - j)::INT)))::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM bits
"""
