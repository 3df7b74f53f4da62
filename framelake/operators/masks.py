"""Pixel sets: validity, priority, union, intersection, difference, as joins and set operations.

A mask is rows of its key columns (say frame, row, col); masks of several prompts are
rows with a prompt column. Packed bitmaps are in ``framelake.sources.masks``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_pixels(pixels: DataFrame, masks: DataFrame, keys: list[str], excluded: list[str], prompt: str = "prompt") -> DataFrame:
    """Pixels that no mask of an excluded prompt covers."""
    return pixels.join(masks.filter(F.col(prompt).isin(excluded)).select(*keys), keys, "left_anti")


def resolve_priority(masks: DataFrame, keys: list[str], order: list[str], prompt: str = "prompt") -> DataFrame:
    """Each pixel belongs to the first prompt of the order that covers it; other prompts don't count."""
    rank = reduce(lambda when, p: when.when(F.col(prompt) == p[1], p[0]), enumerate(order), F.when(F.lit(False), -1))
    first = masks.withColumn("_rank", rank).filter("_rank is not null").groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return first.select(*keys, F.element_at(F.array(*map(F.lit, order)), F.col("_rank") + 1).alias(prompt))


def union(masks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, masks).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().exceptAll(b.distinct())


def top_pixels(mask: DataFrame, keys: list[str], row: str) -> DataFrame:
    """The topmost row of a mask in each column."""
    return mask.groupBy(*keys).agg(F.min(row).alias("top"))


def steepest_rows(df: DataFrame, keys: list[str], row: str, gradient: str) -> DataFrame:
    """The row with the least gradient in each column, the upper one of equals."""
    return df.groupBy(*keys).agg(F.min(F.struct(gradient, row)).alias("m")).select(*keys, F.col(f"m.{row}").alias("ridge_row"), F.col(f"m.{gradient}").alias("least_gradient"))
