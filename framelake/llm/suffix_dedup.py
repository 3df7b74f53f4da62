"""Removal of repeated byte strings by sparse prefix doubling.

Prefix doubling ranks positions by the L bytes after them, L doubling from round to
round: the rank at 2 L is the rank of a pair, (rank at p, rank at p + L), and
positions whose rank is unique leave. Ranking every byte position of a corpus in
each round would move many times its size, so the rounds here start at half the
threshold and at sampled positions that equal strings are sure to share:

1. Round one, L = threshold / 2: of each window (a string of threshold bytes) the
   half-length string with the least rank, leftmost among ties, is the window's
   anchor. Equal windows have equal anchors at equal places. Spark groups the
   anchors' ranks; anchors with a unique rank leave, and with them every window that
   they own, as such a window can't occur twice. Neighbouring windows share their
   anchor, so this moves a row per hundred bytes.
2. Anchors with all their windows' bytes (the context) in common are settled
   together, however many there are: each of these windows occurs in all of them.
3. Round two, L = threshold: the windows of the remaining contexts, one context for
   each distinct one, get the rank pair (rank at p, rank at p + L / 2); windows with a
   pair that isn't unique are repeated. Up to MEET contexts of an anchor rank are sorted
   together and compared where they meet; the pairs of larger groups are rows that
   Spark groups, so a group of any size spreads over all tasks.

Ranks are hashes (of fixed random values for bytes, so they agree between tasks): 64
bits per half, 128 for a window. Repeated windows go back to their documents as
intervals, and their bytes are cut out of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import Table, bounded_batches, documents, hot_join, lean, mix64, raw, text_of

LENGTH = 400
#: Window starts of a text that are ranked at once; long texts come in blocks.
BLOCK = 1 << 18
#: Up to so many 8-byte keys are broadcast as a filter; beyond that the filter is a shuffled join.
BROADCAST_KEYS = 500_000

#: Distinct contexts of one anchor rank that meet in one task: some 600 bytes each, so 2.5 MB.
MEET = 4096

BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, and powers of the base and of its inverse modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        for name, x in (("up", BASE), ("down", inverse)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
        _POWERS["byte"] = mix64(np.arange(1, 257, dtype=np.uint64))
    return _POWERS["byte"], _POWERS["up"], _POWERS["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    byte, up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * up[: len(data)], out=out[1:])
    return out


def ranks(sums: np.ndarray, size: int) -> np.ndarray:
    """The rank of the string of a size at each position."""
    n = len(sums) - size
    return mix64((sums[size:] - sums[:n]) * powers(n)[2][:n])


def owners(rank: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` ranks, the position of the least one, leftmost among ties."""
    keyed = (rank & ~np.uint64(BLOCK * 2 - 1)) | np.arange(len(rank), dtype=np.uint64)
    n = len(rank) - width + 1
    padded = np.full(-(-len(rank) // width) * width, np.uint64(2**64 - 1))
    padded[: len(rank)] = keyed
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(BLOCK * 2 - 1)).astype(np.int64)


def anchors(text: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (anchor rank, context rank, first start, number of starts), a block of starts at a time."""
    half = length // 2
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        sums = prefix_sums(part)
        rank = ranks(sums, half)
        owner = owners(rank, length - half + 1)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        count = np.diff(first, append=len(owner))
        own = owner[first]
        end = first + count + length - 1
        context = mix64((sums[end] - sums[first]) * powers(len(part))[2][first] + mix64((((own - first) << 24) + count).astype(np.uint64)))
        yield rank[own].view(np.int64), context.view(np.int64), first + at, count


def window_ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank pair of each window of a few bytes."""
    half = length // 2
    rank = ranks(prefix_sums(data), half)
    n = len(data) - length + 1
    return rank[:n].view(np.int64), rank[length - half : length - half + n].view(np.int64)


def spans(starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of bytes, as rows (begin, end), that windows beginning in these runs of starts cover."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], starts[order] + counts[order] - 1 + length
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    return np.stack([begin[new], reach[np.append(new[1:] - 1, len(reach) - 1)]], axis=1)


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, columns = [], [[], [], [], []]
            for k, text in enumerate(raw(b.column(2))):
                for found in anchors(text, length):
                    at.append(np.full(len(found[0]), k, np.int32))
                    for c, x in zip(columns, found, strict=True):
                        c.append(x)
            if at:
                take = pa.array(np.concatenate(at))
                rank, context, first, count = (np.concatenate(c) for c in columns)
                yield pa.record_batch(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(rank), pa.array(context), pa.array(first, pa.int64()), pa.array(count.astype(np.int32))],
                    ["id", "row", "rank", "context", "first", "n"],
                )

    return run


PIECE = "rank long, context long, row long, id {kind}, first long, single boolean, kinds long, data binary"


def _context_bytes(length: int):
    """The bytes of the contexts asked for, cut from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rank", "context", "first", "single", "kinds"]
        for b in batches:
            texts, jobs = raw(b.column(2)), b.column(3)
            whose = np.repeat(np.arange(b.num_rows, dtype=np.int32), jobs.value_lengths().to_numpy())
            job = jobs.flatten()
            first, count = (job.field(c).to_numpy() for c in ("first", "n"))
            data = [texts[k][s : s + n + length - 1] for k, s, n in zip(whose.tolist(), first.tolist(), count.tolist(), strict=True)]
            row, key = (b.column(c).take(pa.array(whose)) for c in (0, 1))
            own = {c: job.field(c) for c in names}
            yield pa.record_batch([own["rank"], own["context"], row, key, own["first"], own["single"], own["kinds"], pa.array(data, pa.binary())], [f.split()[0] for f in PIECE.split(", ")])

    return run


def _meet(length: int):
    """Contexts of the same anchor rank, adjacent in the partition: runs of starts whose windows occur in several of them."""

    def runs(t: pa.Table) -> pa.RecordBatch:
        left, right, size = [], [], []
        for data in t.column("data").to_pylist():
            x, y = window_ranks(np.frombuffer(data, np.uint8), length)
            left.append(x), right.append(y), size.append(len(x))
        whose = np.repeat(np.arange(len(size)), size)
        pair = np.stack([np.concatenate(left), np.concatenate(right)], axis=1)
        _, inverse, times = np.unique(pair, axis=0, return_inverse=True, return_counts=True)
        starts = np.arange(len(whose)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.flatnonzero((times[inverse.ravel()] > 1) & t.column("single").to_numpy()[whose])
        new = np.append(True, (np.diff(hit) > 1) | (np.diff(whose[hit]) > 0)) if len(hit) else np.empty(0, bool)
        begin = np.flatnonzero(new)
        n = np.diff(begin, append=len(hit))
        at = pa.array(whose[hit[begin]])
        first = t.column("first").to_numpy()[whose[hit[begin]]] + starts[hit[begin]]
        take = t.select(["id", "row"]).take(at).combine_chunks()
        return pa.table({"id": take.column("id"), "row": take.column("row"), "first": pa.array(first, pa.int64()), "n": pa.array(n.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 1000:
                t = pa.Table.from_batches(held)
                rank = t.column("rank").to_numpy()
                end = int(np.searchsorted(rank, rank[-1]))
                if end:
                    yield from runs(t.slice(0, end)).to_batches()
                held, n = t.slice(end).to_batches(), len(t) - end
        if n:
            yield from runs(pa.Table.from_batches(held)).to_batches()

    return run


def _window_rows(length: int):
    """A row for each window of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right, own, at = [], [], [], []
            for context, data in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                x, y = window_ranks(np.frombuffer(data, np.uint8), length)
                left.append(x), right.append(y), own.append(np.full(len(x), context)), at.append(np.arange(len(x), dtype=np.int32))
            if left:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in (left, right, own, at)], ["left", "right", "context", "at"])

    return run


def _cutter(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            runs = b.column(2)
            size = runs.value_lengths().to_numpy()
            ends = np.cumsum(size)
            flat = runs.flatten()
            first, count = (flat.field(c).to_numpy() for c in ("first", "n"))
            for text, lo, hi in zip(raw(b.column(1)), ends - size, ends, strict=True):
                cut = spans(first[lo:hi], count[lo:hi], length)
                kept, at = [], 0
                for x, y in cut.tolist():
                    kept.append(text[at:x])
                    at = y
                left = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(left), len(cut), hashlib.sha256(left).hexdigest(), cut.tolist() if with_text else None, left if with_text else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()), strict=True)]
            yield pa.record_batch([b.column(0), *columns][: 7 if with_text else 5], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 7 if with_text else 5])

    return run


def within(df: DataFrame, keys: DataFrame, column: str, most: int, anti: bool = False) -> DataFrame:
    """Rows of df whose key is (not) among distinct keys: by a broadcast if these are few, else by a shuffle."""
    few = keys.limit(most + 1).count() <= most
    return df.join(F.broadcast(keys) if few else keys, column, "left_anti" if anti else "left_semi")


def repeated_runs(rows: DataFrame, length: int = LENGTH, broadcast_keys: int = BROADCAST_KEYS, meet: int = MEET) -> DataFrame:
    """``id, row, first, n``: runs of starts of windows that occur more than once, of rows ``id, row, text``."""
    bounded_batches(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    found = Table(rows.mapInArrow(lean(_anchor_rows(length)), f"id {kind}, row long, rank long, context long, first long, n int"), "anchors")
    again = Table(found.df.groupBy("rank").agg(F.count("*").alias("c")).filter("c > 1").select("rank"), "repeated-ranks")
    shared = Table(within(found.df, again.df, "rank", broadcast_keys), "shared-anchors").df
    found.drop()
    place = F.struct("row", "id", "first", "n")
    contexts = Table(shared.groupBy("rank", "context").agg(F.count("*").alias("copies"), F.min(place).alias("place")), "contexts").df
    mixed = contexts.groupBy("rank").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).filter("kinds > 1 and least = 1").select("rank", "kinds")
    # A passage that many texts share is one context, so its anchors must not meet in one task.
    settled = hot_join(shared, contexts.filter("copies > 1").select("rank", "context", "copies"), ["rank", "context"], "copies").select("id", "row", "first", "n")
    # So is a rank that many contexts share.
    asked = hot_join(contexts, mixed.withColumn("contexts", F.col("kinds")), ["rank"], "contexts").select("rank", F.xxhash64("rank", "context").alias("context"), "place.*", (F.col("copies") == 1).alias("single"), "kinds")
    jobs = Table(asked, "context-jobs").df
    by_row = jobs.groupBy("row", "id").agg(F.collect_list(F.struct("rank", "context", "first", "n", "single", "kinds")).alias("jobs"))
    texts = within(rows, jobs.select("row").distinct(), "row", broadcast_keys)
    met = texts.alias("t").join(by_row.alias("j"), (F.col("t.row") == F.col("j.row")) & F.col("t.id").eqNullSafe(F.col("j.id")))
    # Repeated rows hold the same jobs; one of them answers.
    met = met.select(F.col("t.row").alias("row"), F.col("t.id").alias("id"), "text", "jobs").dropDuplicates(["row", "id"])
    pieces = Table(met.mapInArrow(lean(_context_bytes(length)), PIECE.format(kind=kind)), "contexts-bytes").df
    # Few contexts of a rank meet in one task; many are compared as window rows, which spread over all tasks.
    few = pieces.filter(F.col("kinds") <= meet).repartition("rank").sortWithinPartitions("rank")
    few_runs = few.mapInArrow(lean(_meet(length)), f"id {kind}, row long, first long, n int")
    many = pieces.filter(F.col("kinds") > meet)
    windows = Table(many.select("context", "data").mapInArrow(lean(_window_rows(length)), "left long, right long, context long, at int"), "window-ranks").df
    twice = windows.groupBy("left", "right").agg(F.count("*").alias("c")).filter("c > 1").select("left", "right")
    hits = windows.join(twice, ["left", "right"], "left_semi").groupBy("context").agg(F.sort_array(F.collect_list("at")).alias("at"))
    # Adjacent starts become one run: number minus rank is constant within a run.
    joined = hits.select("context", F.posexplode("at").alias("k", "at")).groupBy("context", (F.col("at") - F.col("k")).alias("run")).agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n"))
    many_runs = joined.join(many.filter("single").select("context", "id", "row", "first"), "context").select("id", "row", (F.col("first") + F.col("at")).alias("first"), "n")
    found_runs = few_runs.unionByName(many_runs)
    return settled.unionByName(found_runs)


def substring_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, with_text: bool = False, broadcast_keys: int = BROADCAST_KEYS, meet: int = MEET) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_removed, n_spans, kept_sha256`` and, if wanted, ``spans, kept``.

    Every byte of a text that lies in a string of ``length`` bytes (an even
    number) that also starts elsewhere, in the same text or another one, is
    removed; all occurrences go, overlaps count, and nothing is judged again on
    what is left. Matches never cross texts. Null texts are empty: no byte, no
    span. Repeated rows are copies of each other; ids may be null or repeat.
    Other columns are ignored. An empty table gives an empty result.
    """
    if length % 2 or length < 2:
        raise ValueError("length must be even")
    text = text_of(text_column).cast("string")
    rows = df.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    runs = Table(repeated_runs(rows, length, broadcast_keys, meet), "repeated-runs").df
    by_row = Table(runs.groupBy("row", "id").agg(F.collect_list(F.struct("first", "n")).alias("runs")), "runs-by-row").df
    touched = by_row.select("row").distinct()
    clean = within(rows, touched, "row", broadcast_keys, anti=True)
    rest = within(rows, touched, "row", broadcast_keys)
    none = F.lit(0).cast("long")
    extra = [F.array().cast("array<array<bigint>>").alias("spans"), F.col("text").cast("binary").alias("kept")] if with_text else []
    whole = [F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")]
    joined = rest.alias("t").join(by_row.alias("r"), (F.col("t.row") == F.col("r.row")) & F.col("t.id").eqNullSafe(F.col("r.id")), "left")
    # A row that only shares its hash with a touched one has no runs.
    empty = F.array().cast(by_row.schema["runs"].dataType)
    joined = joined.select(F.col("t.id").alias("id"), "text", F.coalesce("runs", empty).alias("runs"))
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<array<bigint>>, kept binary" if with_text else "")
    return joined.mapInArrow(lean(_cutter(length, with_text)), schema).unionByName(clean.select("id", *whole, *extra))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text of ``documents`` without strings of 400 bytes that occur again."""
    return substring_dedup(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
