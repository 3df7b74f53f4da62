"""Exact dedup with an extendible-hash index kept in shared files; DataFrame functions only.

1. Every row gives an index entry: id, 64-bit key of the normalised text and its
   SHA-256.
2. The directory starts with one cell. As long as a bucket holds more distinct
   keys than ``bucket_keys``, the directory doubles and that bucket splits by the
   next leading bit of the key. Copies of one text are one key, so a group of
   copies of any size neither overfills a bucket nor makes it split.
3. The directory places every entry in its bucket. The index's files, Parquet in the
   shared folder, are ranges of buckets and keys, each written and owned by one task;
   ranges are cut by id as well, so the entries of a hot key spread over several owners.
4. Keys met once are settled. For keys met more often the texts are read again, find
   their bucket by the directory, and chain under their key there by the bytes of the
   whole text: grouping is on the text itself, summed up within tasks before the
   shuffle, so copies collapse where they are read. A hash collision only makes a longer
   chain. Owners then look up the chains of their entries in the bucket.

Cost: two scans of the text, two shuffles of entries (some 60 bytes each), and a
shuffle of one text per copied text and task. Texts that occur once are never shuffled
if the copied keys fit ``broadcast_keys``; beyond that the second scan is a
shuffled join, for which the few hot keys are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import Table, documents, hot_join, text_of

#: Fixed value: the white space that is folded to one space.
SPACES = r"[\x20\x09-\x0D]+"
#: Distinct keys that a bucket may hold before it splits.
BUCKET_KEYS = 100_000
#: The directory never has more than two to this power cells, which bounds what is broadcast; buckets hold more where that would not do.
MAX_DEPTH = 14
#: Up to so many 8-byte keys are broadcast (8 MB); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def cell(key: Column) -> Column:
    """The directory cell of a key: its leading MAX_DEPTH bits."""
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH).cast("int")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """``cell, depth, bucket``: the bucket of each of the finest cells, by the first of its cells.

    Doubling is read off the key counts per cell: a bucket of depth d is kept
    when it isn't overfull, or can't split further, and its parent was overfull.
    At most ``2 ** MAX_DEPTH`` rows whatever the input.
    """
    fine = keys.groupBy(cell(F.col("key")).alias("cell")).agg(F.count("*").alias("n"))
    nodes = (
        fine.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth"))
        .groupBy("depth", F.expr(f"shiftright(cell, {MAX_DEPTH} - depth)").alias("prefix"))
        .agg(F.sum("n").alias("n"))
    )
    full = (F.col("n") > bucket_keys) & (F.col("depth") < MAX_DEPTH)
    split = nodes.filter(full).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    leaves = nodes.filter(~full).withColumn("parent", F.shiftright("prefix", 1))
    leaves = leaves.filter("depth = 0").select("depth", "prefix").unionByName(leaves.join(split, ["depth", "parent"], "left_semi").select("depth", "prefix"))
    bucket = F.expr(f"shiftleft(prefix, {MAX_DEPTH} - depth)").alias("bucket")
    cells = fine.select("cell", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {MAX_DEPTH} - depth)"))
    return cells.join(leaves, ["depth", "prefix"]).select("cell", "depth", bucket)


def exact_dedup(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_keys: int = BUCKET_KEYS,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per input row: ``id, row, keep_id, group_size, kept, text_sha256, bucket``.

    Rows are equal when their normalised texts have the same bytes; of equal rows
    the smallest id stays. Null texts count as empty, and empty texts are equal
    to each other. Other columns are ignored, whatever their names. An empty
    table gives an empty result. Ids that repeat each give a row; rows with a
    null id are copies like others, and a group of null ids alone keeps null.
    ``row`` is the XXH64 of the text, which tells rows apart that share an id.
    """
    norm = normalised(text_of(text_column))
    rows = df.select(F.col(id_column).alias("id"), norm.alias("norm"), F.xxhash64(text_of(text_column)).alias("row"))
    entry = rows.select("id", "row", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    entries = Table(entry, "hash-entries")
    pages = entries.df
    # A row for each distinct key; summed up within tasks first, so a hot key is a few rows.
    keys = Table(pages.groupBy("key").agg(F.count("*").alias("n")), "hash-keys").df
    # Keys are spread evenly, so buckets of two cells' mean load always split far enough.
    cells = Table(directory(keys, max(bucket_keys, keys.count() >> (MAX_DEPTH - 1))).select("cell", "bucket"), "hash-directory").df
    in_bucket = lambda df: df.join(F.broadcast(cells), cell(F.col("key")) == F.col("cell")).drop("cell")
    index = Table(in_bucket(pages).repartitionByRange("bucket", "key", "id").sortWithinPartitions("bucket", "key", "id"), "hash-index").df
    entries.drop()
    copied = in_bucket(keys.filter("n > 1"))
    few = copied.count() <= broadcast_keys
    again = rows.withColumn("key", F.xxhash64("norm"))
    again = again.join(F.broadcast(copied.drop("n")), "key") if few else hot_join(again, copied, ["key"], "n")
    chained = again.groupBy("bucket", "key", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    chains = (
        chained.withColumn("sha", F.unhex(F.sha2("norm", 256)))
        .groupBy("bucket", "key", "sha")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
        # Two texts under one key and one SHA-256 can't be told apart by the entries; stop instead of merging them.
        .withColumn("keep_id", F.when(F.col("texts") == 1, F.col("keep_id")).otherwise(F.raise_error(F.lit("two texts share their key and SHA-256")).cast(chained.schema["keep_id"].dataType)))
        .drop("texts")
    )
    chains = Table(chains, "chains").df
    # The chains are a row per copied text; few are broadcast, so a hot key needs no shuffle. Many are
    # dealt out with a salt, so the entries of a hot key meet their one chain row in several tasks.
    if few:
        joined = index.join(F.broadcast(chains), ["bucket", "key", "sha"], "left")
    else:
        salted = chains.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        joined = index.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(salted, ["bucket", "key", "sha", "salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        "id",
        "row",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("id") == keep, F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, with the group of equal texts it belongs to."""
    out = exact_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept,
       sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
