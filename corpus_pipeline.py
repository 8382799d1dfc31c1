"""From raw documents to packed sequences: the stages apply operators of cubespan.llm, one after the other.

Each stage works on all that the one before it kept, and its decisions take effect. Stages write Parquet to
the folder that spark.checkpoint.dir names, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespan.llm import _shared, jaccard, mixing, packing, quality, queries, secrets


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars after the text was changed; null stays null."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bad lines go, and so do documents that fail or lose too much."""
    return _measured(quality.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by 80 % of their shingles of five words the smallest id stays."""
    return jaccard.deduplicate(docs, n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; every document stays."""
    return _measured(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix over a document, with the words that it takes."""
    return mixing.Mix(docs).texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack(docs, queries.tokenizer_path(), end_id=1, capacity=2048)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("mixing sources", mix_sources), ("packing", pack_sequences)]

#: Token ids and shingle classes can't be written in SQL; the tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = _shared.table(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        _shared.remove(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
