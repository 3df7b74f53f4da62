"""Functions for SQL text: greenness, blue share, the double sigmoid, dates in names, pixels of a frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: SQL functions, which Catalyst inlines: name, parameters, type, body.
FUNCTIONS = {
    "gr": ("r DOUBLE, g DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN r + g + b > 0 THEN g / (r + g + b) ELSE 0D END"),
    "blue_share": ("b DOUBLE, g DOUBLE, r DOUBLE", "DOUBLE", "b / (r + g + b + 1e-6)"),
    "double_sigmoid": (
        "t DOUBLE, base DOUBLE, a1 DOUBLE, k1 DOUBLE, t1 DOUBLE, a2 DOUBLE, k2 DOUBLE, t2 DOUBLE", "DOUBLE",
        "base + a1 / (1 + exp(-k1 * (t - t1))) - a2 / (1 + exp(-k2 * (t - t2)))",
    ),
    "parse_ts": (
        "name STRING", "TIMESTAMP_NTZ",
        r"CAST(coalesce(try_to_timestamp(nullif(regexp_extract(name, '\\d{8}_\\d{4}', 0), ''), 'yyyyMMdd_HHmm'), "
        r"try_to_timestamp(nullif(regexp_extract(name, '\\d{4}-\\d{2}-\\d{2}_\\d{2}-\\d{2}', 0), ''), 'yyyy-MM-dd_HH-mm'), "
        r"try_to_timestamp(nullif(regexp_extract(name, '(\\d{8})(?!\\d)', 1), ''), 'yyyyMMdd')) AS TIMESTAMP_NTZ)",
    ),
}


@udtf(returnType="row: int, col: int, b: int, g: int, r: int")
class Pixels:
    """Rows of a frame's pixels; meant for small areas, after filters."""

    def eval(self, height: int, width: int, data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        if data:
            image = np.frombuffer(data, np.uint8).reshape(height, width, 3)
            for row in range(height):
                for col in range(width):
                    yield (row, col, *map(int, image[row, col]))


@udtf(returnType="origin_row: int, origin_col: int, height: int, width: int")
class Tiles:
    """Origins and sizes of overlapping tiles; the last ones are flush with the edges."""

    def eval(self, height: int, width: int, crop: int, stride: int) -> Iterator[tuple[int, int, int, int]]:
        starts = lambda n: sorted({*range(0, max(n - crop, 0) + 1, stride), max(n - crop, 0)})
        for y in starts(height):
            for x in starts(width):
                yield y, x, min(crop, height - y), min(crop, width - x)


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("pixels", Pixels)
    spark.udtf.register("tiles", Tiles)
