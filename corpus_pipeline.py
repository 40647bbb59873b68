"""The corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, mixing sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. ``run`` applies them to documents, each stage's result written as Parquet and read again.

Every stage limits the session's Arrow batches to BATCH_ROWS rows: executors hold a batch of whole texts several times (in
the JVM's direct memory and in each Python worker), besides a heap that fills up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, jaccard, mixing, packing, quality
from gridloom.llm.common import staged


#: Rows of an Arrow batch; the default of 10 000 whole texts is some 20 MB a copy.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified rule go."""
    _small_batches(spark)
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    _small_batches(spark)
    return exact_dedup.deduplicated(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by five-word shingles at a similarity of 0.8 the smallest id stays."""
    _small_batches(spark)
    return jaccard.one_per_component(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _small_batches(spark)
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    _small_batches(spark)
    import public_tokenizers

    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", jaccard_stage),
    ("mix_sources", mixing_stage),
    ("pack_sequences", packing_stage),
]

#: Hash-ranked sampling and tokenisation are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
