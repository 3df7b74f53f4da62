"""Masks as packed bitmaps: ``stem, prompt, height, width, bits``; archives of numpy arrays; AOI images."""

from __future__ import annotations

import io
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.dates import basename
from framelake.sources.png import decode_png

MASK = "stem string, prompt string, height int, width int, bits binary"


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def pack(mask: np.ndarray) -> bytes:
    return np.packbits(np.asarray(mask, bool)).tobytes()


def unpack(height: int, width: int, bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=height * width).reshape(height, width).astype(bool)


def load_mask(path: str) -> np.ndarray | None:
    """The array ``mask`` of an archive, or None if there is no such file."""
    if not Path(path).exists():
        return None
    with np.load(path) as f:
        return f["mask"].astype(bool)


def save_mask(path: str, mask: np.ndarray) -> None:
    np.savez_compressed(path, mask=np.asarray(mask, bool))


def read_masks(spark: SparkSession, folder: str, prompts: list[str] | None = None) -> DataFrame:
    """All ``<stem>_<prompt>.npz`` files of a folder; the prompt is what follows the last underscore, or a listed prompt."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    known = sorted(prompts or [], key=len, reverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1].removesuffix(".npz")
                prompt = next((p for p in known if name.endswith(f"_{p}")), name.rsplit("_", 1)[-1])
                with np.load(io.BytesIO(content)) as f:
                    mask = f["mask"]
                rows.append((name[: -len(prompt) - 1], prompt, *mask.shape, pack(mask)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], [f.split()[0] for f in MASK.split(", ")])

    return files.mapInArrow(run, MASK)


def area(bits: str = "bits", height: str = "height", width: str = "width") -> Column:
    """Share of set pixels, counted on the packed bytes' hex digits in the JVM; 0 for an empty mask."""
    digits = F.hex(bits)
    ones = sum((F.length(digits) - F.length(F.translate(digits, "".join(f"{d:X}" for d in range(16) if d.bit_count() == n), ""))) * n for n in range(1, 5))
    return F.coalesce(F.try_divide(ones.cast("double"), (F.col(height) * F.col(width)).cast("double")), F.lit(0.0))


def load_aoi_mask(path: str) -> np.ndarray:
    """Pixels of a colour PNG of which any channel is set."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    image = decode_png(Path(path).read_bytes())
    if image.ndim != 3 or image.shape[2] < 3:
        raise ValueError(f"{path} isn't a three-channel image")
    return (image[..., :3] > 0).any(axis=2)


def pixels_of(spark: SparkSession, mask: np.ndarray) -> DataFrame:
    """``row, col`` of set pixels."""
    row, col = np.nonzero(mask)
    return spark.createDataFrame(pa.table({"row": row.astype(np.int32), "col": col.astype(np.int32)}))
