"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows of docs that it keeps,
with the columns of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import Table
from framelake.llm.compact_windows import near_duplicate_passages, remove_passages
from framelake.llm.exact_dedup import exact_dedup
from framelake.llm.packing import best_fit_packing
from framelake.llm.quality import quality_classifier
from framelake.llm.rows import drop_documents, losers, repeated
from framelake.llm.simhash import simhash_groups


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject."""
    scored = quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("predicted = 1").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text: that with the smallest doc_id."""
    decided = Table(exact_dedup(docs).select("id", "row", "text_sha256"), "exact-decisions").df
    dropped = Table(losers(decided, "text_sha256"), "exact-losers").df
    return drop_documents(docs, dropped, Table(repeated(decided), "exact-doubles").df)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest doc_id.

    Documents link when their five-word shingles have a Jaccard similarity of 0.8
    or more. Fingerprints of 256 bits say which may: at 0.8, 39 bits differ on
    average with a deviation of 6, so 52 bits are allowed.
    """
    found = simhash_groups(docs, shingle_words=5, words=4, repeats=False, max_bits=52, similarity=0.8, jaccard=0.8)
    decided = Table(found.select("id", "row", "root"), "near-decisions").df
    dropped = Table(losers(decided, "root"), "near-losers").df
    return drop_documents(docs, dropped, Table(repeated(decided), "near-doubles").df)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat one of a document with a smaller doc_id are cut out; a document that is nothing else goes."""
    found = Table(near_duplicate_passages(docs).select("id", "row", "first_word", "n_words"), "repeated-passages").df
    cut = remove_passages(docs, found)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    emptied = found.select(F.col("id").alias("doc_id")).distinct()
    blank = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    whole = cut.filter(~blank)
    left = cut.filter(blank).join(emptied, "doc_id", "left_anti").select(*docs.columns)
    return whole.unionByName(left)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packing),
]

#: SQL can express neither the trained classifier nor XXH64 fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), name.replace(" ", "-")).df
    return STAGES[-1][1](spark, docs, sf_dir)
