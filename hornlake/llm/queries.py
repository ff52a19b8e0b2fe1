"""The queries op1_ to op10_ and the SQL of those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from . import bpe, chunks, embed, langid, lines, media, mixing, secrets, simhash, warc
from .common import table


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "phrase_chars")


def op7_embedding_dedup(spark, sf_dir):
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return found.select("row.doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_media_columns(spark, sf_dir):
    found = media.read_media(media.store_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("row.doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op2_secret_scan(spark, sf_dir):
    found = secrets.scan_once(table(spark, sf_dir, "documents"))
    span = lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])
    of = lambda kind: F.filter("findings", lambda f: f["kind"] == kind)
    base = F.filter("findings", lambda f: f["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id", *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(F.array_join(F.transform(base, span), ","), 256).alias("base_sha256"), F.array_join(F.transform("findings", span), ",").alias("spans"),
    )


def op3_substring_dedup(spark, sf_dir):
    return chunks.repeats_by_document(table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries():
    return {name: f for name, f in globals().items() if re.match(r"op\d+_", name)}


def oracle_sql():
    return {"op4_warc": warc.WARC_SQL, "op9_mix": mixing.MIX_SQL, "op10_line_dedup": lines.LINES_SQL}
