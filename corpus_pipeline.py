"""A corpus made ready for training: five stages over ``documents``, each written as Parquet and read by the next.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all its predecessor kept. All but the
last return the columns of ``documents``; the last returns the packed pieces.

Nulls pass through as each operator defines it: a null text is an empty one to the classifiers, the fingerprints (all
texts without a word are copies of each other), the mixture (no words) and the packing (one separator); a null source is a
source; a document without an id has no name to be told apart by, so near-duplicate removal keeps it. Without labels the
classifiers keep everything. Rows that repeat an id are one document to near-duplicate removal where their texts are near
copies, else each is told apart by its fingerprint, and rows of their own before and after. Empty tables give empty tables.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from cuelight.llm import mixing, packing, quality, simhash, toxicity
from cuelight.scratch import committed
from cuelight.session import ship


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/labels.parquet")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal model puts into the lowest grade."""
    model = quality.train(docs, _labels(spark, sf_dir))
    return quality.keep_good(docs, model)


def keep_not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the noisy-or of their sentences calls toxic."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.keep_clean(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each class of linked SimHash fingerprints."""
    ship(spark)
    return simhash.representatives(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents to the water-filled targets of their sources; a document comes up to three times."""
    ship(spark)
    return mixing.mix(docs, max_epochs=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token pieces of the mixture, each copy of a document for itself, with their ids."""
    ship(spark)
    return packing.pack(docs, capacity=packing.CAPACITY, with_ids=True)


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("toxicity", keep_not_toxic),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Fitted models, XXH64 fingerprints and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; when a stage is written, the one before and whatever it needed on the way are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = committed(partial(stage, spark, docs, sf_dir), docs)
    return docs
