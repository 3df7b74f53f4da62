"""Arithmetic on colour channels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def greenness(r: Column, g: Column, b: Column) -> Column:
    """G / (R + G + B), 0 for a black pixel."""
    total = r + g + b
    return F.when(total > 0, g / total).otherwise(F.lit(0.0))


def blue_share(b: Column, g: Column, r: Column) -> Column:
    return b / (r + g + b + F.lit(1e-6))


def sky_index(b: Column, g: Column, r: Column) -> Column:
    return F.lit(2) * b - r - g


def luma(b: Column, g: Column, r: Column) -> Column:
    """Gray level of 8-bit channels, rounded."""
    return F.floor(F.lit(0.114) * b + F.lit(0.587) * g + F.lit(0.299) * r + F.lit(0.5)).cast("int")


def bright_neutral(r: Column, g: Column, b: Column, least_sum: float = 535.5, most_spread: float = 30) -> Column:
    """Bright, nearly colourless pixels such as sunlit rock."""
    return (r + g + b >= least_sum) & (F.greatest(r, g, b) - F.least(r, g, b) < most_spread)
