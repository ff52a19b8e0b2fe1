"""Mix sources to target weights with hash-threshold histograms; DataFrame functions only.

Each document gets a 48-bit hash of its id. Per source, sizes are summed by the leading bits of the hash; the
bucket in which the running sum crosses the source's budget is refined by the next bits, level by level, until the
threshold is exact. A document is taken (once more) if its hash lies below its source's threshold: no sort of
documents, no per-source group in one task, and smaller budgets always take subsets of larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

WEIGHTS = (3, 1, 2)
BUDGET_RATIO = 1.5
CAP = 2.0
HASH_BITS = 48
LEVEL_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """The first 48 bits of the MD5 of the id as text; null ids hash as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """An equi-join key that tells null from every text."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _targets(sized: DataFrame, weights, budget_ratio: float, cap: float) -> DataFrame:
    """(skey, source_size, target) by water-filling: the share per weight unit at which capped shares use the budget."""
    per_source = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    everywhere = Window.partitionBy()  # one row per source: a summary, never documents
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per_source.withColumn("rank", F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last()))).withColumns(
        {
            "weight": F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")),
            "most": F.col("source_size") * F.lit(float(cap)),
            "budget": F.sum("source_size").over(everywhere) * F.lit(float(budget_ratio)),
        }
    )
    rising = everywhere.orderBy(F.col("most") / F.col("weight"), "rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = ranked.withColumns(
        {
            "unit": (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
            "place": F.row_number().over(rising),
        }
    )
    settled = F.min(F.when(F.col("unit") * F.col("weight") <= F.col("most"), F.struct("place", "unit"))).over(everywhere)
    shared = F.coalesce(F.least(F.col("weight") * settled["unit"], F.col("most")), F.col("most"))
    return filled.select("skey", "source_size", shared.alias("target"))


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(skey, source_size, target, whole, threshold): whole copies of all, one more of hashes below threshold."""
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    state = written(
        targets.withColumn("whole", whole).select(
            "skey", "source_size", "target", "whole", (F.col("target") - F.col("whole") * size).alias("rest"), F.lit(0).cast("long").alias("prefix")
        ),
        "mix-state",
    )
    width = HASH_BITS
    while width > 0:
        step = min(LEVEL_BITS, width)
        inside = sized.join(state.select("skey", "prefix"), "skey").where(F.shiftright("h", width) == F.col("prefix"))
        histogram = inside.groupBy("skey", F.shiftright("h", width - step).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("skey").orderBy("bucket")  # at most 2^LEVEL_BITS rows a source
        running = histogram.withColumn("upto", F.sum("words").over(upto)).join(state.select("skey", "rest"), "skey")
        crossing = (
            running.where(F.col("upto") > F.col("rest"))
            .groupBy("skey")
            .agg(F.min(F.struct("bucket", "words", "upto")).alias("edge"))
            .select("skey", F.col("edge.bucket").alias("bucket"), F.col("edge.words").alias("words"), F.col("edge.upto").alias("upto"))
        )
        width -= step
        left = F.col("rest") - (F.col("upto") - F.col("words"))
        # Without a crossing all hashes of the prefix are below the threshold: go on in a bucket past the last.
        past = F.shiftleft(F.col("prefix") + 1, step)
        found = state.join(crossing, "skey", "left").select(
            "skey", "source_size", "target", "whole",
            F.when(F.col("bucket").isNull(), F.lit(float("inf"))).otherwise(left if width else F.when(F.col("words") < 2 * left, F.lit(1.0)).otherwise(0.0)).alias("rest"),
            F.coalesce("bucket", past).alias("prefix"),
        )
        newer = written(found, "mix-state")
        drop_written(state)
        state = newer
    nearest = F.when(F.col("rest") == 1.0, F.col("prefix") + 1).otherwise(F.col("prefix"))
    return state.select("skey", "source_size", "target", "whole", nearest.alias("threshold"))


def plan_mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, budget_ratio=BUDGET_RATIO, cap=CAP) -> tuple[DataFrame, DataFrame]:
    """(sized documents, thresholds by source), both tables in the shared folder."""
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _key(F.col(source_col)).alias("skey"),
            word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h"),
        ),
        "mix-sized",
    )
    targets = written(_targets(sized, weights, budget_ratio, cap), "mix-targets")
    return sized, written(_thresholds(sized, targets), "mix-thresholds")


def _copies() -> Column:
    return F.col("whole") + F.when(F.col("h") < F.col("threshold"), F.lit(1)).otherwise(F.lit(0)).cast("long")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    Null or empty text: size 0. Null source: a source of its own, last in the order of weights. Null or repeated
    ids: rows with the same id share a hash, so they are taken together. Empty table: no rows. Other columns are
    not read.
    """
    sized, limits = plan_mix(docs, **options)
    return sized.join(limits, "skey").select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """docs with each row as many times (0 to cap) as the mix takes it; the columns of docs.

    Edge cases as in mix_report; a row of size 0 is taken like any other row of its source.
    """
    _, limits = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    whole_row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    keyed = docs.select(whole_row, _key(F.col(source_col)).alias("skey"), id_hash(F.col(id_col)).alias("h"))
    times = F.sequence(F.lit(1).cast("long"), F.col("times"))
    taken = keyed.join(limits, "skey").withColumn("times", _copies()).where(F.col("times") > 0)
    return taken.withColumn("copy", F.explode(times)).select("row.*")


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM per),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS most,
         sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget
  FROM ranked),
filled AS (
  SELECT *, (budget - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit, row_number() OVER w AS place
  FROM weighed WINDOW w AS (ORDER BY most / weight, rank)),
settled AS (SELECT min_by(unit, place) AS unit FROM filled WHERE unit * weight <= most),
targets AS (
  SELECT source, source_size, coalesce(least(weight * (SELECT unit FROM settled), most), most) AS target FROM filled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
summed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= rest OR 2 * upto - own < 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
