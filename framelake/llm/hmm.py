"""A hidden Markov language model over words, trained by Baum-Welch across partitions.

The unigram base gives every known word w the probability p(w) = (c + 0.1) / (N +
0.1 (V + 1)) and an unknown word that of c = 0. Words fall into a fixed number of
classes: the end, the ``TOP`` most frequent words each alone, and all others by a hash
of their last three bytes; each of these hashed classes has an unknown word of its
own. A state s emits class k with probability e(s, k), and the word within its class
in proportion to p, so

    P(w | s) = p(w) * e(s, k(w)) / q(k(w)),   q(k) = sum of p over class k,

which sums to 1 over all words. Hence the log probability of a text is its base score
plus that of its classes under e / q, and the model's parameters stay small however
many words there are.

Training counts come from all training texts: in each round every partition sums up
the expected counts of its texts, Spark adds these up, and the parameters are set
from the sums. Counts are those of whole texts: short texts move in step, and longer
ones do so in runs of ``RUN`` words, for which the products of the runs' matrices give
the exact forward and backward vectors at every border first. Scoring is the exact
scaled forward recursion over each whole text (for very long ones as a product of the
same matrices).

Word counts reach the texts in two ways. The ``NEAR`` most frequent words, a bounded
number, go to all tasks and settle most of the words where the text is read. The
other words of a text become rows that are joined with the counts and summed up by
text, so nothing of the size of the vocabulary is collected or broadcast, and no text
is shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import Table, bounded_batches, documents, lean, raw

STATES, ROUNDS, RUN = 6, 3, 512
#: Most frequent words whose counts go to all tasks.
NEAR = 200_000
#: Classes: end, most frequent words, hashed others.
TOP, HASHED = 1000, 1024
CLASSES = 1 + TOP + HASHED
END = 0
#: The end of a text as a word; no word is empty.
END_WORD = b""
#: Distinct words that a counting task holds, and rare ones that an encoding task remembers.
HELD_WORDS, RARE_WORDS = 400_000, 100_000
#: Words that are scored in step; texts of more words than LONG are products of matrices.
STEP_WORDS, LONG = 400_000, 4096
#: Pseudo-counts that tie a state's emissions to the base.
PRIOR = 50.0


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for text in raw(b.column(0)):
            held.update(_words(text))
            held[END_WORD] += 1
        if len(held) >= HELD_WORDS:
            yield out()
            held.clear()
    if held:
        yield out()


def frequent_words(counts: DataFrame) -> DataFrame:
    """The words that occur at least so often that NEAR words at most do.

    The bound is read off how many words occur how often, so no task sorts words:
    only the NEAR largest of these numbers, each a row, reach the driver.
    """
    words = counts.filter(F.length("word") > 0)
    left, least = NEAR, None
    for r in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc()).limit(NEAR).collect():
        left -= r["words"]
        if left < 0:
            break
        least = r["n"]
    return words.filter(F.lit(False) if least is None else F.col("n") >= least).select("word", "n")


def hashed_class(word: bytes) -> int:
    return 1 + TOP + zlib.crc32(word[-3:]) % HASHED


def base_classes(counts: DataFrame, near: dict[bytes, tuple[float, int]], room: float) -> np.ndarray:
    """q of each class, summed over all words where they are."""
    hashed = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(HASHED)).cast("int") + 1 + TOP
    q = np.zeros(CLASSES)
    q[1 + TOP :] = 0.1 / room
    for r in counts.groupBy(hashed.alias("class")).agg(F.sum((F.col("n") + 0.1) / room).alias("q")).collect():
        q[r["class"]] += r["q"]
    # Words with a class of their own leave their hashed one.
    for word, (p, k) in near.items():
        if k <= TOP:
            q[hashed_class(word)] -= p
            q[k] += p
    return q


class Near(dict):
    """Word -> (class, score, known) of frequent words; others are remembered as rare."""

    def __init__(self, near: dict[bytes, tuple[float, int]]) -> None:
        super().__init__((w, (k, math.log10(p), 1)) for w, (p, k) in near.items())
        self.known = len(self)

    def __missing__(self, word: bytes) -> tuple[int, float, int]:
        value = (hashed_class(word), 0.0, 0)
        if len(self) >= self.known + RARE_WORDS:
            for w in [w for w, v in self.items() if not v[2]]:
                del self[w]
        self[word] = value
        return value


def _encoder(near: dict[bytes, tuple[float, int]], end_score: float, end_known: bool):
    """Classes of each text, the base score of its frequent words, and its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Near(near)
        for b in batches:
            rows = []
            for text in raw(b.column(2)):
                words = _words(text)
                if words:
                    kind, score, known = zip(*map(own.__getitem__, words), strict=True)
                    rare = [w for w, k in zip(words, known, strict=True) if not k]
                    kind = np.array(kind + (END,), np.uint16).tobytes()
                    rows.append((len(words) + 1, len(words) - len(rare) + end_known, math.fsum(score) + end_score, kind, rare))
                else:
                    rows.append((1, int(end_known), end_score, np.array([END], np.uint16).tobytes(), []))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), *cols], ["id", "held_out", "n_tokens", "n_near", "near_score", "classes", "rare"])

    return run


class Model:
    """Start, transition and emission probabilities; ``ratio`` is e / q by class."""

    def __init__(self, base: np.ndarray, states: int = STATES, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.base = base
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.9 if states > 1 else 1.0)
        self.emit = base * rng.uniform(0.2, 1.8, (states, len(base)))
        self.emit /= np.maximum(self.emit.sum(axis=1, keepdims=True), 1e-300)

    @property
    def ratio(self) -> np.ndarray:
        """Rows by class."""
        return np.divide(self.emit, self.base, out=np.ones_like(self.emit), where=self.base > 0).T.copy()

    def fit(self, sums: np.ndarray) -> None:
        """Sets the parameters from expected counts, flat as in expected()."""
        s, k = self.emit.shape
        start, move, emit = np.split(sums, [s, s + s * s])
        start, move = start + 1, move.reshape(s, s) + 1
        emit = emit.reshape(s, k) + PRIOR * self.base
        self.start, self.move = start / start.sum(), move / move.sum(axis=1, keepdims=True)
        self.emit = emit / np.maximum(emit.sum(axis=1, keepdims=True), 1e-300)


def borders(model: Model, ratio: np.ndarray, words: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities before each run's first word, and backward vectors after its last one; runs of a text are adjacent."""
    s = len(model.start)
    enter, leave = np.tile(model.start, (len(begin), 1)), np.ones((len(begin), s))
    last = np.append(first[1:], True)
    several = np.flatnonzero(~(first & last))
    if not len(several):
        return enter, leave
    own = several[np.argsort(-length[several], kind="stable")]
    product = np.tile(np.eye(s), (len(own), 1, 1))
    for t in range(int(length[own[0]])):
        n = int(np.searchsorted(-length[own], -t, side="left"))
        step = (product[:n] * ratio[words[begin[own[:n]] + t]][:, None, :]).reshape(-1, s) @ model.move
        product[:n] = step.reshape(n, s, s) / step.reshape(n, -1).max(axis=1)[:, None, None]
    at = dict(zip(own.tolist(), range(len(own)), strict=True))
    for r in several.tolist():
        if not last[r]:
            v = enter[r] @ product[at[r]]
            enter[r + 1] = v / v.sum()
    behind = np.ones(s)
    for r in reversed(several.tolist()):
        behind = np.ones(s) if last[r] else behind
        leave[r] = behind if last[r] else model.move @ behind
        behind = product[at[r]] @ behind
        behind /= behind.sum()
    return enter, leave


def expected(model: Model, texts: list[np.ndarray], run: int = RUN) -> np.ndarray:
    """Expected counts (starts, moves, emissions) of whole texts, which move in step in runs of so many words."""
    s, k = model.emit.shape
    ratio, move = model.ratio, model.move.astype(np.float32)
    words = np.concatenate(texts).astype(np.int64)
    size = np.array([len(t) for t in texts])
    runs_of = -(-size // run)
    begin = np.repeat(np.cumsum(size) - size, runs_of) + run * (np.arange(runs_of.sum()) - np.repeat(np.cumsum(runs_of) - runs_of, runs_of))
    length = np.minimum(run, np.repeat(np.cumsum(size), runs_of) - begin)
    first = np.zeros(len(begin), bool)
    first[np.cumsum(runs_of) - runs_of] = True
    enter, leave = borders(model, ratio, words, begin, length, first)
    ratio = ratio.astype(np.float32)
    order = np.argsort(-length, kind="stable")
    place = np.argsort(order)
    # For runs that aren't a text's first, the place of the run before.
    follows = np.flatnonzero(~first[order])
    came = place[order[follows] - 1]
    begin, length, first, enter, leave = (x[order] for x in (begin, length, first, enter.astype(np.float32), leave.astype(np.float32)))
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]) + 1)]  # runs longer than t
    alpha: list[np.ndarray] = []
    seen: list[np.ndarray] = []
    ends = np.empty_like(enter)
    for t, n in enumerate(live[:-1]):
        seen.append(words[begin[:n] + t])
        now = (enter if not t else alpha[-1][:n] @ move) * ratio[seen[-1]]
        now /= now.sum(axis=1, keepdims=True)
        alpha.append(now)
        ends[live[t + 1] : n] = now[live[t + 1] :]
    moves = np.zeros((s, s))
    posterior: list[np.ndarray] = [np.empty(0)] * len(alpha)
    beta = leave[: live[len(alpha) - 1]]
    for t in range(len(alpha) - 1, -1, -1):
        n = len(alpha[t])
        gamma = alpha[t] * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        posterior[t] = gamma
        ahead = ratio[seen[t]] * beta
        if t:
            before = alpha[t - 1][:n]
        else:
            before, ahead = ends[came], ahead[follows]
        scale = np.einsum("ni,ni->n", before @ move, ahead)
        ahead = ahead / scale[:, None]
        moves += (before.T @ ahead) * move
        if t:
            beta = leave[: len(alpha[t - 1])].copy()
            beta[:n] = ahead @ move.T
            beta /= beta.sum(axis=1, keepdims=True) / s
    at = np.concatenate(seen)
    all_gamma = np.concatenate(posterior)
    emits = np.stack([np.bincount(at, weights=all_gamma[:, i], minlength=k) for i in range(s)])
    starts = posterior[0][first].sum(axis=0)
    return np.concatenate([starts, moves.ravel(), emits.ravel()])


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log of each text's probability relative to the base, by the scaled forward recursion."""
    ratio, move = model.ratio, model.move
    out = np.zeros(len(texts))
    size = np.array([len(t) for t in texts])
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    if len(short):
        words = np.concatenate([texts[k] for k in short]).astype(np.int64)
        length = size[short]
        begin = np.cumsum(length) - length
        now = None
        total = np.zeros(len(short))
        for t in range(int(length[0])):
            n = int(np.searchsorted(-length, -t, side="left"))
            now = (np.broadcast_to(model.start, (n, len(model.start))) if now is None else now[:n] @ move) * ratio[words[begin[:n] + t]]
            scale = now.sum(axis=1)
            now = now / scale[:, None]
            total[:n] += np.log(scale)
        out[short] = total
    for k in np.flatnonzero(size > LONG):
        out[k] = long_forward(model, ratio, texts[k].astype(np.int64))
    return out


def long_forward(model: Model, ratio: np.ndarray, words: np.ndarray, run: int = 256) -> float:
    """The same for one long text: runs' matrices are multiplied in step, then applied one after another."""
    now = model.start * ratio[words[0]]
    total = np.log(now.sum())
    now = now / now.sum()
    rest = words[1:]
    whole = len(rest) // run * run
    if whole:
        runs = rest[:whole].reshape(-1, run)
        product = np.broadcast_to(np.eye(len(now)), (len(runs), len(now), len(now)))
        log = np.zeros(len(runs))
        for t in range(run):
            product = (product @ model.move) * ratio[runs[:, t]][:, None, :]
            scale = product.max(axis=(1, 2))
            product = product / scale[:, None, None]
            log += np.log(scale)
        for m, x in zip(product, log, strict=True):
            now = now @ m
            total += x + np.log(now.sum())
            now = now / now.sum()
    for w in rest[whole:]:
        now = (now @ model.move) * ratio[w]
        total += np.log(now.sum())
        now = now / now.sum()
    return float(total)


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows in groups of some STEP_WORDS words, with their class arrays."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(column).nbytes // 2
        if n >= STEP_WORDS:
            t = pa.Table.from_batches(held)
            yield t, [np.frombuffer(x, np.uint16) for x in t.column(column).to_pylist()]
            held, n = [], 0
    if held:
        t = pa.Table.from_batches(held)
        if len(t):
            yield t, [np.frombuffer(x, np.uint16) for x in t.column(column).to_pylist()]


def _collector(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for _, texts in _grouped(batches, 0):
            own = expected(model, texts)
            sums = own if sums is None else sums + own
        if sums is not None:
            at = np.flatnonzero(sums)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["at", "value"])

    return run


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, texts in _grouped(batches, 1):
            yield from pa.table({"key": t.column("key"), "gain": pa.array(forward(model, texts) / np.log(10))}).to_batches()

    return run


def hmm_scores(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    A row is held out of all training counts when crc32 of its id as text is a
    multiple of 10 (a null id counts as an empty text: held out). Null and empty
    texts are an end alone. Repeated rows count, and are scored, each for itself.
    Without training rows every token is unknown, the end too. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("out", held_out(F.col("id")))
    counts = rows.filter(~F.col("out")).select("text").mapInArrow(lean(_counts), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = Table(counts, "word-counts").df
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds")).first()
    room = sums["total"] + 0.1 * (sums["kinds"] + 1)
    most = frequent_words(counts).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, times = (most.column(c).to_pylist() for c in ("word", "n"))
    near = {bytes(w): ((n + 0.1) / room, min(k + 1, TOP) if k < TOP else hashed_class(w)) for k, (w, n) in enumerate(zip(words, times, strict=True))}
    ends = counts.filter(F.length("word") == 0).first()
    end_p = ((ends["n"] if ends else 0) + 0.1) / room
    base = base_classes(counts.filter(F.length("word") > 0), near, room)
    base[END] = end_p

    schema = f"id {kind}, held_out boolean, n_tokens long, n_near long, near_score double, classes binary, rare array<binary>"
    encoded = rows.select("id", F.col("out").alias("held_out"), "text").mapInArrow(lean(_encoder(near, math.log10(end_p), ends is not None)), schema)
    encoded = Table(encoded.withColumn("key", F.monotonically_increasing_id()), "encoded-texts").df
    rare = encoded.select("key", F.explode("rare").alias("word")).join(counts, "word", "left")
    rest = rare.groupBy("key").agg(F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.1) / room)).alias("rest_score"), F.count("n").alias("n_rest"))
    rest = Table(rest, "rare-scores").df

    model = Model(base, states)
    for _ in range(rounds):
        got = encoded.filter(~F.col("held_out")).select("classes").mapInArrow(lean(_collector(model)), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(states + states * states + states * CLASSES)
        for r in got:
            total[r["at"]] = r["value"]
        model.fit(total)
    gains = Table(encoded.select("key", "classes").mapInArrow(lean(_scorer(model)), "key long, gain double"), "gains").df
    out = encoded.drop("classes", "rare").join(rest, "key", "left").join(gains, "key")
    base_score = F.col("near_score") + F.coalesce("rest_score", F.lit(0.0))
    return out.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_near") + F.coalesce("n_rest", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(sums["total"]).cast("long").alias("train_tokens"),
        base_score.alias("base_score"),
        (base_score + F.col("gain")).alias("score"),
    )


def op5_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all rows of ``documents``."""
    return hmm_scores(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
