"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed. The ledger holds a row for each blob and rule version that has been
scanned, with the spans found; a scan reads only blobs that lack some wanted rule version, each once however many
paths hold it, and findings are joined back to all paths by digest.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, scratch, slices, written

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
#: What a text must hold, in lower case, to have an assignment.
ASSIGN_NEEDS = ("passw", "secret", "token", "api")

Spans = list[tuple[int, int]]


def _assign(text: str) -> Spans:
    low = text.lower()
    if not any(x in low for x in ASSIGN_NEEDS):
        return []
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]


def _access(text: str) -> Spans:
    return [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else []


def _hex(text: str) -> Spans:
    return [m.span() for m in HEX.finditer(text)]  # a maximal run of 24 or more


def _pem(text: str) -> Spans:
    return [m.span() for m in PEM.finditer(text)] if "-----BEGIN" in text else []


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    scan: Callable[[str], Spans]

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds are listed at equal starts; `base` kinds first.
RULES = (Rule("assign", 1, _assign), Rule("access", 1, _access), Rule("hex", 1, _hex), Rule("pem", 1, _pem))
BASE = ("assign", "access", "hex")

LEDGER = "digest string, rule string, spans array<struct<start:long,end:long>>"
FOUND = "array<struct<rule:string,spans:array<struct<start:long,end:long>>>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far; empty if nothing has been scanned."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def _scan(rules: tuple[Rule, ...]):
    keys = [r.key for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("rule", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
        here: set[str] = set()  # blobs of this task: rows that repeat path and text meet here mostly
        for batch in slices(batches):
            digests, found = [], []
            for digest, text, seen in zip(batch["digest"].to_pylist(), batch["text"].to_pylist(), batch["seen"].to_pylist(), strict=True):
                if digest not in here:
                    here.add(digest)
                    text = text.decode("utf-8", "replace")
                    digests.append(digest)
                    found.append([{"rule": key, "spans": [{"start": a, "end": b} for a, b in rule.scan(text)]} for rule, key in zip(rules, keys, strict=True) if key not in (seen or ())])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(found, kind)], ["digest", "found"])

    return run


def scan(versions: DataFrame, ledger: str, *, id_col="doc_id", text_col="text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id_col, digest, findings (array of start, kind's place, end, kind) for each row of versions; grows the ledger.

    A row is one version of one path, named by id_col. Null text is an empty blob; rows with equal text, or with an
    equal id, each get the findings of their own text. Null ids are kept. Empty table: no rows, nothing scanned.
    Other columns are not read. The ledger gets one row for each blob and rule, however often a row is repeated and
    whatever ids are null. A run that dies leaves the ledger as it was or whole; a rerun scans what is missing.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(id_col).alias("path"), as_bytes(F.col(text_col)).alias("text")).withColumn("digest", F.sha2("text", 256))
    paths = written(rows.select("path", "digest"), "secret-paths")
    keys = [r.key for r in rules]
    done = read_ledger(spark, ledger).where(F.col("rule").isin(keys)).groupBy("digest").agg(F.collect_set("rule").alias("seen"))
    # One row a blob: the least path that holds it lends its text.
    blobs = paths.groupBy("digest").agg(F.min("path").alias("lender")).join(done, "digest", "left")
    todo = written(blobs.where(F.col("seen").isNull() | (F.size("seen") < len(keys))), "secret-todo")
    lent = rows.join(todo.withColumnRenamed("digest", "wanted"), F.col("path").eqNullSafe(F.col("lender")) & (F.col("digest") == F.col("wanted")))
    found = lent.select("digest", "text", "seen").mapInArrow(_scan(rules), f"digest string, found {FOUND}").dropDuplicates(["digest"])
    found.select("digest", F.explode("found").alias("f")).select("digest", "f.rule", "f.spans").write.mode("append").parquet(ledger)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    ledger_rows = read_ledger(spark, ledger).where(F.col("rule").isin(keys)).where(F.size("spans") > 0).dropDuplicates(["digest", "rule"])
    each = ledger_rows.select("digest", F.explode("spans").alias("s"), order[F.col("rule")].alias("place"), F.substring_index("rule", "@", 1).alias("kind"))
    per_blob = each.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("s.start", "place", "s.end", "kind"))).alias("findings"))
    nothing = F.array().cast("array<struct<start:long,place:int,end:long,kind:string>>")
    return paths.join(per_blob, "digest", "left").select(F.col("path").alias(id_col), "digest", F.coalesce("findings", nothing).alias("findings"))


def scan_once(versions: DataFrame, **options) -> DataFrame:
    """scan() with a ledger of its own."""
    return scan(versions, scratch(versions.sparkSession, "secret-ledger"), **options)
