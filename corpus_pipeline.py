"""Corpus pipeline: five stages over ``documents``, each a thin call of an operator.

``run`` writes every stage's result as Parquet in the shared folder of
``spark.checkpoint.dir`` and reads it back as the next stage's documents, so a
lost executor costs one stage at most.  All stages but the last return the
columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drover.llm import bpe, jaccard, mixing, pii, toxicity
from drover.llm.common import keep, read
from drover.llm.queries import tokenizer_path
from drover.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    ship_package(spark)
    net = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.drop_toxic(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ship_package(spark)
    return jaccard.drop_near_duplicates(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; n_chars follows the new text."""
    from pyspark.sql import functions as F
    ship_package(spark)
    new = pii.replace_private(docs)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return new.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    ship_package(spark)
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed corpus, with the digest of the decoded text."""
    from pyspark.sql import functions as F
    ship_package(spark)
    done = bpe.encode_decode(docs.select("doc_id", "source", "text"), tokenizer_path("byte_bpe_50k.json"),
                             keep_cols=["doc_id", "source"])
    return done.select("doc_id", "source", "n_tokens", "ids",
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("private_data", replace_private),
          ("mixing", mix_sources), ("bpe", encode)]

# The stages hold a trained network and iterated fixpoints, which SQL can't state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
