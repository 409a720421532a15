"""The operators as queries over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, bpe, chat, merkle, neardup, negatives, packing, pii, quality, secrets, simhash, substring, suffixes


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_chat_format(spark, sf):
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    conversations = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(conversations.unionByName(extra)))


def op2_repeated_passages(spark, sf):
    return substring.repeats(_table(spark, sf, "documents")).drop("row", "copy")


def op3_packing(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_table(spark, sf, "documents"), path, keep_ids=False)


def op4_personal_data(spark, sf):
    docs = _table(spark, sf, "documents")
    found = pii.find_personal_data(docs, pii.train(docs))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(pii.joined("base"), 256).alias("base_sha256"),
        pii.joined("spans").alias("spans"),
    )


def op5_jaccard_join(spark, sf):
    return neardup.near_duplicates(_table(spark, sf, "documents"))


def op6_quality_cascade(spark, sf):
    judged = quality.quality_cascade(_table(spark, sf, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_suffix_dedup(spark, sf):
    left = suffixes.remove_repeats(_table(spark, sf, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_byte_bpe(spark, sf):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_hilbert_neighbours(spark, sf):
    found = ann.nearest(_table(spark, sf, "embeddings"), lambda ident: ident % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_secret_ledger(spark, sf):
    found = secrets.scan_paths(_table(spark, sf, "documents"))
    kinds = [r.kind for r in secrets.RULES]
    base = [r.kind for r in secrets.BASE_RULES]

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    basic = F.filter("findings", lambda f: F.array_contains(F.array(*[F.lit(k) for k in base]), f["kind"]))
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(secrets.in_order(basic, base), 256).alias("base_sha256"),
        secrets.in_order(F.col("findings"), kinds).alias("spans"),
    )


def op11_simhash_near_dedup(spark, sf):
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op12_merkle_manifest(spark, sf):
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = F.when(tampered, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    checked = merkle.manifest(_table(spark, sf, "documents"), changed={"text": found})
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_hard_negatives(spark, sf):
    rows = negatives.valid(_table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    other = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", other), lambda ident: ident % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in [
        op1_chat_format, op2_repeated_passages, op3_packing, op4_personal_data, op5_jaccard_join, op6_quality_cascade, op7_suffix_dedup,
        op8_byte_bpe, op9_hilbert_neighbours, op10_secret_ledger, op11_simhash_near_dedup, op12_merkle_manifest, op13_hard_negatives,
    ]
}
