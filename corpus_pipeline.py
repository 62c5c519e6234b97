"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Every stage takes rows with the columns doc_id, text, lang, source and n_chars; columns
besides them are kept, whatever their names, up to the last stage. Null and empty texts,
repeated rows, rows that share an id, ids that are null and empty tables are all rows like
others; what a stage makes of them is in its docstring.
"""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm import bpe, classlm, minhash, mixing, runindex, toxicity
from binloom.llm.queries import TOKENIZER
from binloom.session import delete_written, discard, ship, table, written

#: Words of the passages that the repeats stage removes, however few bytes they have.
PASSAGE = 50


def _owner(spark: SparkSession, sf_dir: str) -> str:
    """Intermediate tables of the stage before, over the same folder, are no longer read once this one begins."""
    ship(spark)
    owner = f"pipeline-{zlib.crc32(sf_dir.encode()):08x}"
    delete_written(spark, owner)
    return owner


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    return next(x for k in range(len(taken) + 1) if (x := f"{name}{k}") not in taken)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5; null and empty texts are scored like texts without words, equal texts alike."""
    _owner(spark, sf_dir)
    held_out = classlm.remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    score = _fresh(docs, "toxicity")
    return toxicity.score(docs, model, to=score).filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of 5-word shingles at 0.8.

    Rows that share an id are grouped and dropped one by one, by their texts; of rows equal in
    id and text one stays. Texts without words and rows without id are in no group and stay.
    """
    found = minhash.groups(docs.select(F.col("doc_id").alias("id"), "text"), minhash.Banding(), _owner(spark, sf_dir))
    gone = found.filter("id <> component").select("id", "th").distinct()
    named = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    left = named.join(gone, (named["doc_id"] == gone["id"]) & (F.xxhash64(named["text"]) == gone["th"]), "left_anti")
    return left.dropDuplicates(["doc_id", "text"])


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what strings of 400 bytes or of PASSAGE words cover that stand elsewhere; characters cut in half go too.

    Null and short texts stay as they are. Rows equal in id and text are repeats of each other
    and both lose what they share; a document of which nothing is left stays as an empty text.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    found = runindex.remove_repeats(rows, short=runindex.WINDOW, owner=_owner(spark, sf_dir), words=PASSAGE)
    left = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", "")
    changed = F.size("spans") > 0
    new = {"text": F.when(changed, left).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(left).cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as often as it takes them: a null source is one of its own, texts without words count nothing, repeated rows are taken one by one."""
    _owner(spark, sf_dir)
    return mixing.emitted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number and digest of each document's ids, the digest of the text decoded from them, and whether that is the text. A null text has no ids."""
    _owner(spark, sf_dir)
    path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    back = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return back.select(
        "doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == text).alias("same")
    )


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_duplicates), ("suffix-array dedup", remove_repeats), ("mixing", mix_sources), ("bpe", tokenize)]

#: SQL can't express classifiers, MinHash groups or tokenizers; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
