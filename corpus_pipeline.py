"""The training-data pipeline: language ID, line dedup, near-duplicate removal, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornlake.llm import bpe, langid, lines, mixing, simhash
from hornlake.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, with lang as predicted; those without a letter (null texts too) go.

    Null and repeated ids: rows of their own. Ties go to the language first by name. Without a labelled row in the
    learning folds nothing is determined and all rows go. Empty table: no rows. Other columns stay as they are.
    """
    found = langid.identify(docs, langid.train(docs)).where(F.col("lang_pred") != langid.UNDETERMINED)
    kept = {"text": F.col("text"), "lang": F.col("lang_pred")}
    return found.select(*[kept.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id holds; those of which nothing but white space is left go.

    Rows that share an id keep or lose the same lines; null ids count as one document after all others. n_chars is that
    of the new text. Empty table: no rows. Other columns stay as they are.
    """
    found = lines.dedup_lines(docs).withColumn("kept", F.col("kept").cast("string"))
    found = found.where(F.length(F.btrim("kept", F.lit(lines.SPACE.decode()))) > 0)
    kept = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*[kept.get(c, F.col("row")[c] if c != "text" else None).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by Jaccard similarity >= 0.8 of five-word shingles: candidates by SimHash, verified.

    That is the row of the smallest doc_id, null ids last; of rows that repeat this id, one. Documents without a word
    are one group. Empty table: no rows. All columns stay.
    """
    keyed = written(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    found = simhash.similar_documents(keyed, key_col="__row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    first = found.groupBy("group").agg(least.alias("first")).select("group", F.col("first.key").alias("stays"))
    gone = found.join(first, "group").where(F.col("key") != F.col("stays")).select(F.col("key").alias("__row"))
    return keyed.join(gone, "__row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them; null sources are one, rows of one id are taken together. Empty table: no rows."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids and the digest of what they decode to, a row for each row. Null text: no tokens."""
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("row.doc_id", "row.source", "row.lang", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: Language ID, shingle sets and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return docs
