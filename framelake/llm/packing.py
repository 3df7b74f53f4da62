"""Hierarchical best-fit packing of token sequences.

1. Texts are tokenised where they are read; only pieces (ids' lengths and CRCs)
   leave the task. A document longer than a sequence is cut into full pieces, the
   first of them taking the remainder.
2. Each partition packs its pieces by best fit, longest first: a piece goes to
   the open bin whose free room is smallest but sufficient.
3. Bins that are nearly full are final. Underfull bins become items themselves: those
   of ``FAN_IN`` nodes meet in one node of the next level and are packed by best fit
   again, up the tree to its root; the partitions are the leaves. A bin never
   opens, so an item's place is its offset in the bin plus the bin's offset in its
   parent.

What goes up is bounded however many bins are underfull: best fit leaves one bin at
most that is half empty or more, as anything in a second one would have fitted into
the first. Two bins of over half can't share a sequence, so in a node of FAN_IN
children at most FAN_IN of them find a partner; a child passes up its half-empty bin
and the FAN_IN others with most room, and the rest of its bins are final.

Each level is written before the next reads it, so a task that is run again can't
disagree with the placements that others have already used.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import Table, bounded_batches, documents, lean, strings

#: Tokens of a sequence.
CAPACITY = 2048
#: The id that ends each document.
END_ID = 0
#: Bins with at least this share of their room used are final below the root.
NEARLY_FULL = 0.998
#: Nodes whose underfull bins meet in one node of the next level.
FAN_IN = 8

#: Fixed value: the word pattern of byte-level BPE vocabularies.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters beyond Latin, whose classes may differ between Unicode versions of the two libraries.
BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level BPE tokenizer file, equal to those of the tokenizers library.

    Latin texts are encoded by tiktoken with the file's own vocabulary, several
    times faster; texts with other characters or special tokens' strings, and
    files of which the ids don't follow the merges, by tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [x["content"] for x in spec.get("added_tokens", [])]
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        plain = {t: i for t, i in vocab.items() if t not in set(added)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        pre = spec.get("pre_tokenizer") or {}
        self.fast = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and made == sorted(made) and all(c in alphabet for t in plain for c in t)
        )
        if self.fast:
            ranks = {bytes(alphabet[c] for c in t): i for t, i in plain.items()}
            self.encoding = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def __call__(self, text: str) -> list[int]:
        if self.fast and not BEYOND_LATIN.search(text) and not (self.special and self.special.search(text)):
            return self.encoding.encode_ordinary(text)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker and file."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens: full pieces, but the first takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, longest first; a bit for each free room that some open bin has."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, own, count = capacity, count, count + 1
        bins[k], offsets[k] = own, capacity - room
        if room > n:
            rooms[room - n].append(own)
            mask |= 1 << (room - n)
    return bins, offsets


def pieces(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` for every piece of every text; null counts as empty."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()
    tail = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(strings(b.column(1))):
                ids = np.array(encode(text) + tail, dtype="<u4")
                for n, (s, size) in enumerate(cut(len(ids), capacity) if len(ids) else []):
                    at.append(k), piece.append(n), start.append(s), length.append(size)
                    crc.append(zlib.crc32(ids[s : s + size].tobytes()))
            yield pa.record_batch(
                [b.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(lean(run), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def _packed(t: pa.Table, lengths: list[int], capacity: int, nearly_full: float, fan_in: int, base: int) -> pa.Table:
    """Adds each item's bin (base plus its number), its offset there, the bin's length, and whether the bin goes up."""
    bins, offsets = best_fit(lengths, capacity)
    full = np.bincount(bins, weights=lengths).astype(np.int64)
    up = full < int(nearly_full * capacity)
    up[np.flatnonzero(up & (2 * full > capacity))] = False
    over = np.flatnonzero((full < int(nearly_full * capacity)) & (2 * full > capacity))
    up[over[np.argsort(full[over], kind="stable")[:fan_in]]] = True
    own = np.array(bins, np.int64)
    for name, column in (("bin", own + base), ("at", np.array(offsets, np.int64)), ("filled", full[own]), ("up", up[own])):
        t = t.append_column(name, pa.array(column))
    return t


def _leaf(capacity: int, nearly_full: float, fan_in: int, length_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            yield from _packed(t, t.column(length_at).to_pylist(), capacity, nearly_full, fan_in, TaskContext.get().partitionId() << 34).to_batches()

    return run


def _node(capacity: int, nearly_full: float, fan_in: int, level: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("item", "ascending")])
        base = level << 58 | t.column("node")[0].as_py() << 34
        return _packed(t.select(["item", "length"]), t.column("length").to_pylist(), capacity, nearly_full, fan_in, base)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL, fan_in: int = FAN_IN) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to items that have a ``length`` of 1 to capacity.

    Sequences are gapless from offset 0. Ties and repeated rows are items of
    their own. An empty table gives an empty result.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    names = items.columns
    added = "bin long, at long, filled long, up boolean"
    level = Table(items.mapInArrow(lean(_leaf(capacity, nearly_full, fan_in, names.index("length"))), f"{fields}, {added}"), "packed-0").df
    local = level
    partition = F.shiftright("bin", 34).bitwiseAND((1 << 24) - 1)
    n = (local.agg(F.max(partition)).first()[0] or 0) + 1
    maps: list[DataFrame] = []
    while n > 1:
        n = -(-n // fan_in)
        rising = level.filter("up").select("bin", F.col("filled").alias("length"), F.floor(partition / fan_in).cast("long").alias("node")).distinct()
        packed = rising.withColumnRenamed("bin", "item").groupBy("node").applyInArrow(_node(capacity, nearly_full, fan_in, len(maps) + 1), f"item long, length long, {added}")
        level = Table(packed, f"packed-{len(maps) + 1}").df
        maps.append(level)
    if not maps:
        return local.select(*names, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    # From the root down: where each bin of a level ends up.
    placed = maps[-1].select("item", F.col("bin").alias("root"), F.col("at").alias("shift"))
    for below in reversed(maps[:-1]):
        up = placed.select(F.col("item").alias("bin"), F.col("root").alias("higher"), F.col("shift").alias("more"))
        placed = below.join(up, "bin", "left").select("item", F.coalesce("higher", "bin").alias("root"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("shift"))
    out = local.join(placed.withColumnRenamed("item", "bin"), "bin", "left")
    return out.select(*names, F.coalesce("root", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))


def best_fit_packing(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """Every text's pieces with their places: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are a piece of the end id alone. Ids may be null or
    repeat; each row is packed for itself. Other columns are ignored.
    """
    return pack(Table(pieces(df, tokenizer, id_column, text_column, capacity, end_id), "pieces").df, capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as sequences of at most 2048 tokens."""
    import public_tokenizers

    return best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
