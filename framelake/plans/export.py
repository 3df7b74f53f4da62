"""Copying results to an export folder with a manifest of hashes."""

from __future__ import annotations

import json
import shutil
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import framelake

#: Result folders that are exported.
PARTS = ("images", "phenology", "snowmelt", "viz")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``file, n_bytes, sha256`` of all files below a folder, by their path in it."""
    root = Path(folder).resolve().as_uri().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.url_decode(F.substring_index("path", root.removeprefix("file://"), -1))
    return files.select(name.alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def export(spark: SparkSession, output_dir: str, export_dir: str | None = None, include_log: bool = True) -> str:
    """Copies the result folders that exist; the log lists version, time, place and each file's hash by its relative path."""
    source = Path(output_dir)
    if not source.is_dir():
        raise FileNotFoundError(output_dir)
    target = Path(export_dir) if export_dir else source.parent / "export"
    target.mkdir(parents=True, exist_ok=True)
    hashes: dict[str, str] = {}
    for part in PARTS:
        if (source / part).is_dir():
            shutil.copytree(source / part, target / part, dirs_exist_ok=True)
            if any(p.is_file() for p in (target / part).rglob("*")):
                hashes |= {f"{part}/{r['file']}": r["sha256"] for r in manifest(spark, str(target / part)).collect()}
    if include_log:
        log = {"version": framelake.__version__, "timestamp": datetime.now(UTC).isoformat(), "export_path": str(target), "file_hashes": dict(sorted(hashes.items()))}
        (target / "processing_log.json").write_text(json.dumps(log, indent=2))
    return str(target)
