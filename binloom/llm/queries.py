"""Queries of the twelve operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm import bpe, classlm, graphann, hardneg, langid, media, minhash, mixing, paragraphs, quality, runindex, toxicity
from binloom.session import table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every whole text that other documents, or the same one, hold already; shared: those that stay are counted too."""
    found = paragraphs.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_paragraphs", F.size("removed").cast("long").alias("n_removed"), "removed", "kept_in", F.size("shared").cast("long").alias("n_shared"), "shared_words", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the text decoded from them, as digests."""
    path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    back = bpe.decode(coded, path, pattern)
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors to each whose id is divisible by 20."""
    return graphann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from the labels of ids that aren't held out."""
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), classlm.remainder(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of whole texts: 4-word shingles, similarity of 0.8 or more."""
    docs = table(spark, sf_dir, "documents")
    found = minhash.groups(docs.select(F.col("doc_id").alias("id"), "text"), minhash.Banding(words=4))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as telephony audio and read back, and the resampled PCM stored and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media.payload(F.col("text")).alias("payload"))
    back = media.read(media.store(docs, "payload").drop("payload"), with_pcm=True)
    samples = media.pcm_samples(F.col("pcm"))
    return back.select(
        "doc_id", "n_bytes", F.length("codes").cast("long").alias("payload_bytes"), F.sha2("codes", 256).alias("payload_sha256"), F.crc32(F.substring("codes", -media.UNIT, media.UNIT)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        (F.length(samples) / 2).cast("long").alias("pcm_samples"), F.sha2(samples, 256).alias("pcm_sha256"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labels of ids that aren't held out."""
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), classlm.remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text that strings of 400 bytes cover which stand elsewhere too; longest_shared: the longest run of bytes that matches of 256 or more cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runindex.remove_repeats(docs)
    longest = F.coalesce(F.array_max(F.transform("shared", lambda s: s["end"] - s["start"])), F.lit(0)).cast("long")
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), longest.alias("longest_shared"))


def long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_run_index without the lengths of shared runs, which SQL can't express."""
    return op9_run_index(spark, sf_dir).drop("longest_shared")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7_media that SQL can express: what was stored, as read back."""
    return op7_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole text under the class model, and its unigram base."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = classlm.remainder(F.col("doc_id"), 7) == 2
    model, counts = classlm.fit(docs.filter(~held_out))
    scored = classlm.score(docs, model, counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each vector whose id is divisible by 100; every seventh label is another than its vector's."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mine(rows, F.col("vec_id") % 100 == 0)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the texts of ids that aren't held out."""
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), classlm.remainder(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.filter(~held_out), public_tokenizers.path(TOKENIZER))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_paragraphs": op1_paragraphs, "op2_bpe": op2_bpe, "op3_graph_ann": op3_graph_ann, "op5_mixing": op5_mixing, "op6_minhash": op6_minhash, "op7_media": op7_media, "op4_quality": op4_quality, "op8_toxicity": op8_toxicity, "op9_run_index": op9_run_index, "op10_class_lm": op10_class_lm, "op11_hard_negatives": op11_hard_negatives, "op12_language": op12_language, "long_repeats": long_repeats, "media_payload": media_payload}
ORACLE_SQL: dict[str, str] = {"op1_paragraphs": paragraphs.ORACLE, "op5_mixing": mixing.ORACLE, "op6_minhash": minhash.ORACLE, "op11_hard_negatives": hardneg.ORACLE, "long_repeats": runindex.ORACLE, "media_payload": media.ORACLE}
