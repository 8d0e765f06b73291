"""A corpus from documents: language ID, near-duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and calls one operator. All but the last return the columns
of documents; the last adds shard, slot and grown_shard. run() chains the stages through Parquet files in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, langid, mixing, near, sharding
from lectern.llm.common import scratch, small_batches, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are mostly in none of the corpus's languages: null texts, texts without letters, strange languages, random letters, and
    mixtures of which no language holds half. Languages are learned from three quarters of the rows that name one; where none does, all documents go. Repeated rows
    stay or go together."""
    small_batches(spark)
    return langid.identified(docs, langid.fit(docs.filter(~langid.held_out(F.col("doc_id"), 4, 2))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of five-word shingles alike to 0.8: that with the least doc_id (null ids last), and one row of it. Null and blank texts, which
    have no shingles, all stay."""
    small_batches(spark)
    return near.distinct_documents(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with ten words in a row of a benchmark item, or a whole shorter one. Null and empty texts stay, and so does all with an empty benchmark."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target says: never, once or twice. Null sources are one source; documents without words count
    as size 0; equal rows are sampled each by itself."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the rows into eight shards by doc_id, shuffled; null ids go together. Adds shard, slot and grown_shard; columns of these names are replaced."""
    return sharding.shuffled(docs)


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", benchmark_passages), ("mixing", mix), ("sharding", shards)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
