"""A quality classifier on supervised subword embeddings.

A text is the mean of learned vectors: one for each word and one for each character
n-gram of it, all hashed into ``BUCKETS`` rows. Of word bigrams one kind has a vector:
a word that repeats the one before it counts as REPEAT instead of as itself, with the
weight REPEAT_WEIGHT. Every text also holds the feature TEXT with TEXT_WEIGHT, which
keeps a few words from deciding about a short text. A softmax layer turns the mean
into class probabilities. Vectors and layer are trained together by stochastic gradient
descent in numpy, on a sample of labelled rows that ``MAX_ROWS`` and ``MAX_BYTES``
bound (the rows with the smallest hash of their id, whole texts).

Scoring covers every row. For two classes the log odds of a text is the mean of its
features' own scores, (difference of the layer's rows) * vector; so only a number per
bucket is shipped to the tasks, and a word's sum over its features is kept in a
bounded cache.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, documents, lean, raw

#: Bounds of the training sample.
MAX_ROWS, MAX_BYTES = 6000, 16_000_000
BUCKETS, DIM, EPOCHS, BATCH, RATE, SEED = 1 << 17, 16, 6, 64, 12.0, 11
#: A step changes no component of a vector by more.
LIMIT = 0.1
NGRAMS = (3, 4)
#: Pseudo-words (no word holds a space) and their weights in features.
REPEAT, REPEAT_WEIGHT = b"same word", 16
TEXT, TEXT_WEIGHT = b"a text", 100
#: Words cached by a scoring worker.
CACHED = 200_000
THRESHOLD = 0.7


def features(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams, borders marked."""
    w = b"<" + word + b">"
    out = [zlib.crc32(w) % BUCKETS]
    for n in NGRAMS:
        out += [zlib.crc32(w[i : i + n], n) % BUCKETS for i in range(len(w) - n + 1)]
    return out


def new_words(words: list[bytes]) -> tuple[list[bytes], int]:
    """Words that differ from the one before, and how many don't."""
    new = [w for w, before in zip(words, [b"", *words], strict=False) if w != before]
    return new, len(words) - len(new)


class Trainer:
    """Sparse counts of a sample: texts by words, words by features."""

    def __init__(self, texts: list[bytes], labels: list[int]) -> None:
        self.y = np.array(labels, np.int64)
        index: dict[bytes, int] = {}
        own: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            new, again = new_words(text.split())
            counts = Counter(new)
            counts[TEXT] = TEXT_WEIGHT
            if again:
                counts[REPEAT] = again * REPEAT_WEIGHT
            own.append((np.array([index.setdefault(w, len(index)) for w in counts], np.int32), np.array(list(counts.values()), np.float32)))
        # Plain arrays from the start: lists of so many numbers would take ten times the memory.
        flat, size = array("i"), array("i")
        for w in index:
            found = features(w)[:1] if w in (TEXT, REPEAT) else features(w)
            flat.extend(found)
            size.append(len(found))
        self.flat, self.size = np.frombuffer(flat, np.int32), np.frombuffer(size, np.int32).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.own = own
        self.total = np.array([float((c * self.size[w]).sum()) for w, c in own], np.float32)

    def step(self, at: np.ndarray, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, rate: float) -> None:
        words = np.concatenate([self.own[k][0] for k in at])
        weight = np.concatenate([self.own[k][1] / self.total[k] for k in at])
        text = np.repeat(np.arange(len(at)), [len(self.own[k][0]) for k in at])
        unique, inverse = np.unique(words, return_inverse=True)
        size = self.size[unique]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.begin[unique] - (ends - size), size) + np.arange(ends[-1])]
        sums = np.add.reduceat(vectors[flat], ends - size, axis=0)
        parts = sums[inverse] * weight[:, None]
        mean = np.stack([np.bincount(text, weights=parts[:, j], minlength=len(at)) for j in range(parts.shape[1])], axis=1)
        logits = mean @ layer.T + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(at)), self.y[at]] -= 1
        p /= len(at)
        back = (p @ layer)[text] * weight[:, None]
        layer -= rate * (p.T @ mean)
        bias -= rate * 0.1 * p.sum(axis=0)
        for j in range(back.shape[1]):
            word_part = np.bincount(inverse, weights=back[:, j], minlength=len(unique))
            change = rate * len(at) * np.bincount(flat, weights=np.repeat(word_part, size), minlength=len(vectors))
            vectors[:, j] -= np.clip(change, -LIMIT, LIMIT).astype(np.float32)

    def fit(self, classes: int = 2, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        layer, bias = np.zeros((classes, DIM)), np.zeros(classes)
        layer[:] = rng.uniform(-1, 1, layer.shape) / DIM
        n, done = len(self.y), 0
        steps = epochs * -(-n // BATCH)
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, BATCH):
                self.step(order[lo : lo + BATCH], vectors, layer, bias, rate * (1 - done / steps))
                done += 1
        return vectors, layer, bias


class Scorer(dict):
    """Word -> (sum of its features' scores) + 1j * (number of features); complex numbers add up both at once."""

    def __init__(self, odds: np.ndarray, bias: float) -> None:
        super().__init__()
        self.odds, self.bias = odds, bias
        self.text, self.repeat = (w * complex(float(odds[features(f)[0]]), 1) for f, w in ((TEXT, TEXT_WEIGHT), (REPEAT, REPEAT_WEIGHT)))

    def __missing__(self, word: bytes) -> complex:
        f = features(word)
        value = complex(float(self.odds[f].sum()), len(f))
        if len(word) < 64:
            if len(self) >= CACHED:
                self.clear()
            self[word] = value
        return value

    def score(self, text: bytes) -> float:
        new, again = new_words(text.split())
        found = sum(map(self.__getitem__, new), self.text + again * self.repeat)
        z = self.bias + found.real / found.imag
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample(df: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels of the rows with the smallest id hash, within both bounds; very long texts only where room is left."""
    rows = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(F.col(id_column)))
    chosen = rows.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"), F.xxhash64(id_column).alias("h")).orderBy("h", "label").limit(max_rows)
    texts = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    met = texts.join(F.broadcast(chosen), "id").select("h", "id", "label", F.coalesce("text", F.lit("")).alias("text")).orderBy("h", "id", "text").limit(max_rows)
    size = F.octet_length("text")
    # Texts of over a hundredth of the bound come last, from short to long: what follows one that doesn't fit doesn't fit either.
    order = W.orderBy(F.when(size > max_bytes // 100, size).otherwise(0), "h", "id", "text")
    running = F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0))
    got = met.withColumn("bytes", running).filter(F.col("bytes") <= max_bytes).select("text", "label").toArrow()
    if not got.num_rows and met.limit(1).count():
        raise ValueError(f"no labelled text fits into a sample of {max_bytes} bytes")
    return raw(got.column("text").combine_chunks()), got.column("label").to_pylist()


def train(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", positive: int = 1, **bounds: int) -> tuple[np.ndarray, float]:
    """Score of each bucket and bias, for the odds of the positive label. All zero without labelled rows."""
    texts, found = sample(df, labels, id_column, text_column, label_column, **bounds)
    y = [int(x == positive) for x in found]
    if not y:
        return np.zeros(BUCKETS, np.float32), 0.0
    trainer = Trainer(texts, y)
    del texts
    vectors, layer, bias = trainer.fit()
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def quality_scores(df: DataFrame, odds: np.ndarray, bias: float, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) to all rows.

    Null and empty texts get the score that all texts start from. The score depends on
    the text only. Columns named score or predicted are replaced.
    """
    bounded_batches(df.sparkSession)
    names = [c for c in df.columns if c not in ("score", "predicted")]
    at = names.index(text_column)
    kept = df.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(odds, bias)
        for b in batches:
            score = [own.score(t) for t in raw(b.column(at))]
            yield pa.record_batch([*b.columns, pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], [*names, "score", "predicted"])

    return kept.mapInArrow(lean(run), f"{fields}, score double, predicted int")


def quality_classifier(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """Every row of df with ``score`` and ``predicted``, by a model trained on df's labelled rows.

    Labels join by id. Rows without an id or label, and rows whose crc32 of the id
    as text is 2 modulo 4, are never trained on. Repeated rows are scored each for
    itself. Empty tables give empty results; without training rows every score
    is 0.5.
    """
    odds, bias = train(df, labels, id_column, text_column, label_column, **bounds)
    return quality_scores(df, odds, bias, text_column, threshold)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all rows of ``documents``, learned from ``labels.quality``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
