"""The corpus pipeline: quality, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents; each works on all that its predecessor
kept, and its decisions take effect. Further columns pass through whatever their
names are: the stages hold a row as one struct beside their own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askbatch.llm import bpe, exact_dedup, jaccard, mixing, quality
from askbatch.llm.catalog import vocabulary
from askbatch.llm.common import ascii_lower, ship_package, whole_text
from askbatch.session import checkpointed


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more, learned from the labelled ones."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.train_quality(docs, labels)
    scored = quality.score_quality(docs, model, keep_columns=True)
    return scored.filter("_quality_score >= 0.5").select("_doc.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the smallest doc_id.
    Of rows that share doc_id and text, one stays."""
    kept = (exact_dedup.exact_dedup(docs, keep="smallest").filter("kept")
            .select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_key"),
                    F.col("text_sha256").alias("_sha")))
    text = whole_text(F.col("text"))
    keyed = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_key"),
                        F.sha2(F.encode(ascii_lower(text), "UTF-8"), 256).alias("_sha"))
    one = Window.partitionBy("_key", "_sha").orderBy("_doc.text", "_doc.source", "_doc.lang")
    return (keyed.join(kept, ["_key", "_sha"]).withColumn("_rn", F.row_number().over(one))
            .filter("_rn = 1").select("_doc.*"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard
    similarity of 0.8 or more: the one with the smallest doc_id."""
    ship_package(spark)
    classes = jaccard.jaccard_components(docs, shingle=5, percent=80)
    gone = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in its order, repeats included."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix its digest columns of encoding and decoding."""
    ship_package(spark)
    return bpe.bpe_round_trip(docs, vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

# The learned classifier cannot be written in SQL; tests/llm holds the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
