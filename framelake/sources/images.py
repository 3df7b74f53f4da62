"""Frames: listing, decoding, EXIF tags.

Only paths and sizes are listed first; bytes are read for the frames that are left
after filters, as Catalyst can't push a filter through a decoding function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.dates import basename
from framelake.sources.exif import read_exif

#: The patterns that are listed by default; the upper-case form of each counts as well.
PATTERNS = ("*.jpg", "*.jpeg", "*.tif", "*.tiff")
FRAME = "path string, height int, width int, data binary"


def check_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(folder)


def name_pattern(patterns: tuple[str, ...]) -> str:
    """A regular expression for file names that match a glob or its upper-case form."""
    import fnmatch

    return "|".join(fnmatch.translate(q).removesuffix(r"\Z").removesuffix(r"\z").replace("(?s:", "(?:") + "$" for p in patterns for q in dict.fromkeys((p, p.upper())))


def list_files(spark: SparkSession, folder: str, patterns: tuple[str, ...] | None = None) -> DataFrame:
    """``path, filename, filesize`` of matching files at any depth, each once; their bytes aren't read."""
    check_folder(spark, folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("filesize"))
    found = found.withColumn("filename", basename(F.col("path")))
    return found.filter(F.col("filename").rlike(name_pattern(tuple(patterns or PATTERNS)))).dropDuplicates(["path"]).select("path", "filename", "filesize")


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """``path, height, width, data`` of the folder's images as row-major BGR bytes; undecodable files have nulls."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [bgr(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["path", "height", "width", "data"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)  # frames are large
    return raw.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, FRAME)


def bgr(path: str, height: int, width: int, channels: int, data: bytes) -> tuple:
    if not data or height <= 0 or width <= 0:
        return path, None, None, None
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        x = np.repeat(x, 3, axis=2)
    return path, height, width, np.ascontiguousarray(x[..., :3]).tobytes()


def exif_tags(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """``path, tags`` (a map) of listed files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags = [list(read_exif(c.as_py() or b"").items()) for c in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(tags, pa.map_(pa.string(), pa.string()))], ["path", "tags"])

    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return content.join(files.select("path"), "path", "left_semi").mapInArrow(run, "path string, tags map<string,string>")


def array(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def luma_stats(image: np.ndarray) -> dict[str, float]:
    """Mean, population deviation, percentiles and saturated share of the gray levels, from their 256 counts."""
    b, g, r = (image[..., i].astype(np.uint32) for i in range(3))
    # The usual gray weights in 14-bit fixed point.
    gray = (b * 1868 + g * 9617 + r * 4899 + 8192) >> 14
    n = np.bincount(gray.ravel(), minlength=256)
    total, level = n.sum(), np.arange(256)
    mean = (n * level).sum() / total
    upto = np.cumsum(n)

    def percentile(q: float) -> float:
        at = q * (total - 1)
        lo = int(np.floor(at))
        a, z = np.searchsorted(upto, [lo, min(lo + 1, total - 1)], side="right")
        return float(a + (z - a) * (at - lo))

    return {
        "mean_luma": float(mean), "std_luma": float(np.sqrt((n * (level - mean) ** 2).sum() / total)), "p05_luma": percentile(0.05),
        "p50_luma": percentile(0.5), "p95_luma": percentile(0.95), "saturated_ratio": float(n[250:].sum() / total),
    }
