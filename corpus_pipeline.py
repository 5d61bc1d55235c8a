"""Documents to training sequences: quality rules, near-dedup, substring dedup, private values, packing.

Each stage is written as Parquet in the shared folder and read again as the next one's documents; all but the last
return the columns of `documents`.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneframe.llm.common import Scratch, scratch_path
from cloneframe.llm.minhash_forest import near_duplicates
from cloneframe.llm.packing import pack
from cloneframe.llm.pii import pseudonymise
from cloneframe.llm.quality import measure, train
from cloneframe.llm.queries import PII_KEY
from cloneframe.llm.substring_dedup import remove_repeats

PII_SETTING = "spark.cloneframe.pii.key"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the likelihood ratio."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return measure(docs, model).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id (null is the largest), then the least n_chars.

    Rows are told apart by their place in that order, so rows of one id or none go by their texts alone. Texts without
    words are no group; of them, a row that repeats goes.
    """
    scratch = Scratch(spark)
    order = (F.col("doc_id").asc_nulls_last(), F.col("n_chars").asc(), F.xxhash64("text").asc())
    rows = scratch.put("rows", docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    kept = near_duplicates(rows.select("_row", "text"), "_row").filter("kept")
    whole, bare = (rows.join(kept.filter(f"n_shingles {n} 0").select("_row").hint("merge"), "_row", "left_semi") for n in (">", "="))
    return whole.unionByName(bare.dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; n_chars follows. Documents of which nothing is left go."""
    out = remove_repeats(docs).filter("n_words > n_removed")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms, by the key of the setting PII_SETTING (the tests' key, where it is unset); n_chars follows."""
    return pseudonymise(docs, spark.conf.get(PII_SETTING, PII_KEY)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    return pack(docs, path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("private_values", private_values),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


#: Models, hashes and tokenizers have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None
