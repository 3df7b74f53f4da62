"""Segmentation of frames into masks by a pluggable segmenter; priority, ratios and scores are handled here.

A segmenter maps a BGR image and a prompt to a score plane in [0, 1] (semantic
branch) and to a list of instance masks. The built-in one uses colour rules; a model
is plugged in by registering a factory, which runs once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.sources.images import array
from framelake.sources.masks import MASK, pack

#: Prompts in order of priority, and modes other than fused.
PROMPTS = ("fog", "cloud", "sky", "sun", "reflection", "snow", "mountain")
MODES = {"fog": "instance", "cloud": "semantic_only"}
KNOWN_MODES = ("instance", "semantic_only", "fused")

Scores = Callable[[np.ndarray, str], np.ndarray]
SEGMENTERS: dict[str, Callable[[], Scores]] = {}


def register_segmenter(name: str) -> Callable:
    def add(factory: Callable[[], Scores]) -> Callable[[], Scores]:
        SEGMENTERS[name] = factory
        return factory

    return add


@register_segmenter("colour")
def colour_segmenter() -> Scores:
    """Scores from colours and position alone."""

    def score(image: np.ndarray, prompt: str) -> np.ndarray:
        b, g, r = (image[..., i].astype(float) for i in range(3))
        total, spread = (b + g + r) / 3, image.max(axis=2).astype(float) - image.min(axis=2)
        height = np.linspace(1, 0, image.shape[0])[:, None] * np.ones(image.shape[1])
        soft = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
        rules = {
            "sky": soft((b - r - 15) / 8) * soft((height - 0.35) * 20),
            "cloud": soft((total - 190) / 8) * soft((25 - spread) / 5) * soft((height - 0.5) * 20),
            "fog": soft((total - 170) / 10) * soft((12 - spread) / 3) * (image.std() < 20),
            "sun": soft((total - 252) / 1.0) * soft((height - 0.5) * 20),
            "reflection": soft((total - 250) / 1.0) * soft((0.5 - height) * 20),
            "snow": soft((total - 200) / 8) * soft((0.6 - height) * 20),
            "mountain": soft((0.6 - height) * 20) * soft((200 - total) / 8),
        }
        return rules.get(prompt, np.zeros(image.shape[:2]))

    return score


def tile_starts(length: int, crop: int, stride: int) -> list[int]:
    last = max(length - crop, 0)
    return sorted({*range(0, last + 1, stride), last})


def tiled_scores(image: np.ndarray, prompt: str, score: Scores, size: int, stride: int) -> np.ndarray:
    """Scores of overlapping tiles, blended with a cosine window that is nowhere below 0.08."""
    total = np.zeros(image.shape[:2])
    weight = np.zeros(image.shape[:2])
    for y in tile_starts(image.shape[0], size, stride):
        for x in tile_starts(image.shape[1], size, stride):
            tile = image[y : y + size, x : x + size]
            w = np.outer(*(np.maximum(np.hanning(n), 0.08) if n > 1 else np.ones(n) for n in tile.shape[:2]))
            total[y : y + size, x : x + size] += score(tile, prompt) * w
            weight[y : y + size, x : x + size] += w
    return total / np.maximum(weight, 1e-6)


def normalise_modes(mode: str | dict | None, prompts: tuple[str, ...]) -> dict[str, str]:
    """A mode for each prompt; ``semantic`` means semantic_only."""
    given = mode if isinstance(mode, dict) else dict.fromkeys(prompts, mode) if mode else MODES
    out = {p: {"semantic": "semantic_only"}.get(m := given.get(p, MODES.get(p, "fused")), m) for p in prompts}
    if bad := sorted(set(out.values()) - set(KNOWN_MODES)):
        raise ValueError(f"unknown modes: {', '.join(bad)}")
    return out


def per_prompt(value: float | dict, prompts: tuple[str, ...], default: float) -> dict[str, float]:
    return {p: float(value.get(p, default) if isinstance(value, dict) else value) for p in prompts}


def resize_nearest(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    y = (np.arange(height) * mask.shape[0] / height).astype(int)
    x = (np.arange(width) * mask.shape[1] / width).astype(int)
    return mask[y[:, None], x[None, :]]


def apply_priority(masks: dict[str, np.ndarray], order: tuple[str, ...], height: int, width: int) -> dict[str, np.ndarray]:
    """Disjoint masks: a pixel stays with the first prompt that claims it. Missing masks are empty, others are resized."""
    taken, out = np.zeros((height, width), bool), {}
    for p in order:
        m = masks.get(p)
        m = np.zeros((height, width), bool) if m is None else m if m.shape == (height, width) else resize_nearest(m, height, width)
        out[p] = m & ~taken
        taken |= m
    return out


def segment(
    frames: DataFrame, prompts: tuple[str, ...] = PROMPTS, segmenter: str = "colour", mode: str | dict | None = None, threshold: float | dict = 0.5,
    tile_size: int | None = None, tile_stride: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Frames (path, height, width, data) -> labels (path, prompt, ratio, mode, threshold, score_mean, score_max) and masks.

    Undecodable frames have ratio 0 for every prompt and no masks.
    """
    if segmenter not in SEGMENTERS:
        raise ValueError(f"unknown segmenter {segmenter}")
    factory, modes, limits = SEGMENTERS[segmenter], normalise_modes(mode, prompts), per_prompt(threshold, prompts, 0.5)
    fields = ["path string", *MASK.split(", "), "ratio double", "mode string", "threshold double", "score_mean double", "score_max double"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = factory()
        types = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
        for b in batches:
            rows = []
            for path, height, width, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                if data is None:
                    rows += [(path, stem, p, None, None, None, 0.0, modes[p], None, None, None) for p in prompts]
                    continue
                image = array(height, width, data)
                planes = {p: tiled_scores(image, p, score, tile_size, tile_stride or tile_size) if tile_size and modes[p] != "instance" else score(image, p) for p in prompts}
                masks = apply_priority({p: s >= limits[p] for p, s in planes.items()}, prompts, height, width)
                for p in prompts:
                    plane = modes[p] != "instance"
                    rows.append((path, stem, p, height, width, pack(masks[p]), float(masks[p].mean()) if masks[p].size else 0.0, modes[p], limits[p] if plane else None, float(planes[p].mean()) if plane else None, float(planes[p].max()) if plane else None))
            if rows:
                yield pa.record_batch([pa.array(c, types[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], [f.split()[0] for f in fields])

    out = frames.select("path", "height", "width", "data").mapInArrow(run, ", ".join(fields))
    labels = out.select("path", "prompt", "ratio", "mode", "threshold", "score_mean", "score_max")
    masks = out.filter(F.col("bits").isNotNull()).select(*[f.split()[0] for f in MASK.split(", ")])
    return labels, masks
