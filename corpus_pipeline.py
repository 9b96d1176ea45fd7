"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of ``documents``; others that ``docs`` may have are left out.

Rows are judged each by their own text, never by ``doc_id``, which may be null or repeated. Null and
empty texts pass every stage and are packed as their end token. Nulls in lang, source and n_chars are
kept as they are; a null source is a queue of its own when packed. Repeated rows and ties are
near-duplicates of each other, and the first in the order of reading stays. Texts of any length are
taken whole. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill import storage
from leadmill.llm import decontamination, minhash, packing, suffix_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE_BYTES = 200  # of a repeated passage at least: over fifty words of three letters and a space


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. Null and empty texts score as without evidence and stay."""
    return toxicity.accepted(_columns(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.
    Texts without words are no duplicates and all stay. Rows have a key of their own, so repeated and
    null ids are documents like others."""
    keyed = storage.materialise(_columns(docs).withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    with storage.scratch(spark) as made:
        groups = minhash.near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), "text"), size=5, percent=80)
        gone = made.keep(storage.materialise(groups.where("not kept").select(F.col("doc_id").alias("row_key")), "gone"))
    return _columns(keyed.join(storage.broadcast_if_small(gone), "row_key", "left_anti"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_BYTES or more that start anywhere else too are cut out; documents stay, with what
    is left of them, and n_chars follows it (null for a null text)."""
    out = suffix_dedup.deduplicated(_columns(docs), PASSAGE_BYTES)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts hold none."""
    return decontamination.clean(_columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024, each window near the corpus's mixture of sources."""
    import public_tokenizers

    return packing.pack(_columns(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores, suffix sorting and tokenisation are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written once, read by the next, and then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{storage.shared_dir(spark)}/leadmill/{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES[:-1]:
        with storage.scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(f"{base}/{name}")
        if done:
            storage.remove(spark, done)
        done = f"{base}/{name}"
        docs = spark.read.schema(kept.schema).parquet(done)
    out = STAGES[-1][1](spark, docs, sf_dir)
    storage.remove(spark, base)  # packing has written the tokens
    return out
