"""Corpus pipeline: quality, near-duplicates, secrets, mixture, tokens; each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.llm import bpe, mixture, quality, secrets, simhash
from packetlens.llm.common import durable, prepared, shared_dir

#: Near-duplicates of the corpus: sets of five-word shingles of similarity 0.8 or more.
WORDS, SIMILARITY = 5, 0.8
#: Classifiers that this process has fitted to all documents, by application and folder of tables.
FITTED: dict[tuple[str, str], tuple] = {}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. The mixture weighs by the same classifier."""
    prepared(spark)
    model = FITTED[spark.sparkContext.applicationId, sf_dir] = quality.fit(docs)
    return quality.classified(docs, model=model).where("kept").select(*docs.columns)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple:
    """What the first stage has fitted; where it ran elsewhere, fitted anew to all documents, or to ``docs`` if the folder has none."""
    if model := FITTED.get((spark.sparkContext.applicationId, sf_dir)):
        return model
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return quality.fit(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id, once. Rows without an id stay."""
    prepared(spark)
    found = durable(simhash.similar(docs, WORDS, SIMILARITY))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = durable(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not twice.count():
        return left
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(left.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark; n_chars follows."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole documents; weighted by the classifier's score."""
    model = classifier(prepared(spark), docs, sf_dir)
    mix = mixture.mixed(quality.scored(docs, model), weight=F.col("quality_score"), keep=docs.columns)
    return mix.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).where("copies > 0").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded bytes."""
    prepared(spark)
    return bpe.encoded(docs.select("doc_id", "source", "lang", "text")).drop("text")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]
#: The classifier is fitted, so SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
