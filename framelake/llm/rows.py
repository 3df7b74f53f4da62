"""Applying decisions about documents to their rows.

Operators name a document by its id and ``row``, the XXH64 of its text, so that rows
with null or repeated ids can be told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import sized, text_of
from framelake.llm.suffix_dedup import BROADCAST_KEYS, within


def losers(decided: DataFrame, *group: str) -> DataFrame:
    """``id, row`` of the documents that aren't the first of their group: by id, nulls last, then by row."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    best = decided.groupBy(*group).agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return decided.join(sized(best, "group-firsts"), [*group]).filter("NOT (id <=> best.id) OR row <> best.row").select("id", "row")


def repeated(decided: DataFrame) -> DataFrame:
    """``id, row`` of documents that are several rows."""
    return decided.groupBy("id", "row").agg(F.count("*").alias("n")).filter("n > 1").select("id", "row")


def drop_documents(df: DataFrame, dropped: DataFrame, doubled: DataFrame, id_column: str = "doc_id", text_column: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """df without the dropped documents, and with one row of each doubled one; all columns as they were."""
    names = df.columns
    keyed = df.withColumn("__row", F.xxhash64(text_of(text_column).cast("string")))

    def split(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        keys = keys.select(F.col("row").alias("__row")).distinct()
        return within(rows, keys, "__row", broadcast_keys, anti=True), within(rows, keys, "__row", broadcast_keys)

    clear, doubtful = split(keyed, dropped)
    match = (F.col("k.__row") == F.col("d.row")) & F.col(f"k.{id_column}").eqNullSafe(F.col("d.id"))
    kept = clear.unionByName(doubtful.alias("k").join(dropped.distinct().alias("d"), match, "left_anti"))
    single, several = split(kept, doubled)
    return single.unionByName(several.dropDuplicates(["__row", id_column])).select(*names)
