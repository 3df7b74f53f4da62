"""SimHash near-dedup with pivot distance tables.

The pivot table holds a row for every distinct fingerprint, computed once and written:
its Hamming distances to ``PIVOTS`` fixed reference fingerprints, a byte each. By the
triangle inequality, fingerprints within ``max_bits`` of each other differ by at most
``max_bits`` at every pivot. So the rows that meet are sorted by their distance to the
first pivot, each is paired with those only that follow within ``max_bits``, pairs
with a larger difference at any other pivot are discarded, and the survivors
are verified.

Which pairs meet at all depends on the radius. For a few bits, the fingerprint is cut
into ``max_bits + 2`` segments: two fingerprints with at most ``max_bits`` differing
bits agree in at least two of them, so each is filed under every pair of segments (ten
files for three bits, keys of 25 or 26 bits), and only fingerprints under the same key
meet. This loses no pair. For a similarity, where many bits may differ, fingerprints
of several words are filed under samples of their bits; the number of files follows
from the wanted recall, and the size of a sample grows with the logarithm of the
number of fingerprints, so that keys stay as selective at any size.

Large groups under a key are dealt out as pairs of blocks. From each block pair only a
spanning forest of its links is emitted, never all pairs.

With ``jaccard``, fingerprints only say which documents may belong together: within
their components, links are those pairs whose sets of shingles have that Jaccard
similarity. A component that is small enough is compared in one task. Of a larger one
all documents are compared with its first, and those that it doesn't link, with all.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import EDGE, Table, batch, bounded_batches, components, documents, lean, local_roots, mix64, raw, sized, text_of
from framelake.llm.suffix_dedup import BROADCAST_KEYS, within

#: Reference fingerprints of the pivot table.
PIVOTS = 16
#: Fingerprints of one key that are compared with each other in one block.
BLOCK = 2048
#: Shingles of one component that are compared in one task (8 bytes each).
SHINGLES = 1 << 19
#: Bytes of the first documents of large components that are broadcast at most.
FIRSTS = 1 << 25
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_blocks(text: bytes, size: int = 200_000) -> Iterator[list[bytes]]:
    """Words of a text, A-Z lower-cased; very long texts come in blocks."""
    if len(text) < 4_000_000:
        yield text.lower().split()
        return
    found = WORD.finditer(text)
    while words := [m[0].lower() for m in itertools.islice(found, size)]:
        yield words


def shingle_hashes(text: bytes, k: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each k-word shingle, repeats included; a text of fewer words is one shingle."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    held: list[bytes] = []
    seen = False
    for words in word_blocks(text):
        held += words
        if len(held) >= k:
            seen = True
            yield np.array([digest(join(s), seed) for s in zip(*(held[i:] for i in range(k)), strict=False)], np.uint64)
            held = held[len(held) - k + 1 :] if k > 1 else []
    if held and not seen:
        yield np.array([digest(join(held), seed)], np.uint64)


def fingerprint(text: bytes, k: int, seed: int, words: int = 1, repeats: bool = True) -> list[int]:
    """Bits set in over half of the shingles' hashes, as signed 64-bit words.

    One word: the XXH64 hashes themselves, and 0 for a text without shingles.
    More words: hashes derived from them, and a text without shingles has the
    bits of an empty one. Without ``repeats``, equal shingles count once.
    """
    ones, n = np.zeros((words, 64), np.int64), 0
    found = shingle_hashes(text, k, seed)
    if not repeats:
        parts = [*found]
        found = iter([np.unique(np.concatenate(parts))] if parts else [])
    for h in found if words == 1 else itertools.chain(_first_or(found, xxhash.xxh64_intdigest(b"", seed))):
        for part in np.array_split(h, len(h) // 65536 + 1):
            for w in range(words):
                own = part if not w else mix64(part + np.uint64(w * 0x9E3779B97F4A7C15 % 2**64))
                ones[w] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return [int.from_bytes(np.packbits(2 * row > n, bitorder="little").tobytes(), "little", signed=True) for row in ones]


def _first_or(found: Iterator[np.ndarray], default: int) -> Iterator[np.ndarray]:
    any_found = False
    for h in found:
        any_found = True
        yield h
    if not any_found:
        yield np.array([default], np.uint64)


def print_columns(words: int) -> list[str]:
    return [f"fp{w}" for w in range(words)]


def fingerprints(df: DataFrame, id_column: str, text_column: str, shingle_words: int, seed: int, words: int = 1, repeats: bool = True) -> DataFrame:
    """``id, row, fp0, ...`` of every row."""
    bounded_batches(df.sparkSession)
    names = print_columns(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, shingle_words, seed, words, repeats) for t in raw(b.column(2))], np.int64).reshape(-1, words)
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(prints[:, w]) for w in range(words))], ["id", "row", *names])

    kind = df.schema[id_column].dataType.simpleString()
    text = text_of(text_column).cast("string")
    fields = ", ".join(f"{n} long" for n in names)
    return df.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("row"), text.alias("text")).mapInArrow(lean(run), f"id {kind}, row long, {fields}")


def segments(parts: int) -> list[int]:
    """A mask for each segment of the 64 bits."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [((1 << b) - (1 << a)) for a, b in itertools.pairwise(cuts)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def segment_masks(max_bits: int) -> list[list[int]]:
    """A mask for every pair of segments of one word: two fingerprints within max_bits agree under one of them."""
    return [[a | b] for a, b in itertools.combinations(segments(max_bits + 2), 2)]


def sampled_masks(words: int, n: int, similarity: float, recall: float, seed: int = 5) -> list[list[int]]:
    """Masks of sampled bits: a pair at the similarity agrees under one of them with probability ``recall`` at least.

    Bits of a pair with Jaccard similarity s differ with probability acos(2 s /
    (1 + s)) / pi. Samples have 14 bits, and one more for each doubling of the
    fingerprints beyond 2 ** 18.
    """
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    size = max(14, math.ceil(math.log2(max(n, 2))) - 4)
    files = math.ceil(math.log(1 - recall) / math.log(1 - same**size))
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(files):
        bits = rng.choice(64 * words, size, replace=False).tolist()
        out.append([sum(1 << (b % 64) for b in bits if b // 64 == w) for w in range(words)])
    return out


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances of fingerprints (rows of 64-bit words) to the references, at most 255: that keeps the bound."""
    words = fp.shape[1]
    refs = mix64(np.arange(1, PIVOTS * words + 1, dtype=np.uint64)).reshape(PIVOTS, words)
    return np.stack([np.minimum(np.bitwise_count(fp ^ r).sum(axis=1, dtype=np.int16), 255).astype(np.uint8) for r in refs], axis=1)


def with_pivots(distinct: DataFrame, names: list[str]) -> DataFrame:
    """Distinct fingerprints with their row of the pivot table, ``pivots``."""

    columns = distinct.columns
    at = [columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                table = pivot_table(np.stack([b.column(i).to_numpy() for i in at], axis=1).view(np.uint64))
                yield pa.record_batch([*b.columns, pa.array([r.tobytes() for r in table], pa.binary())], [*columns, "pivots"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    return distinct.mapInArrow(lean(run), f"{fields}, pivots binary")


def _within(table: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that survive the pivot table, verified."""
    for lo in range(0, PIVOTS, 8):
        near = np.abs(table[a, lo : lo + 8] - table[b, lo : lo + 8]).max(axis=1) <= most
        a, b = a[near], b[near]
    ok = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64) <= most
    return a[ok], b[ok]


def _linker(most: int):
    def links(group: np.ndarray, node: np.ndarray, pivots: pa.ChunkedArray, fp: np.ndarray) -> pa.RecordBatch | None:
        table = np.frombuffer(b"".join(pivots.to_pylist()), np.uint8).reshape(-1, PIVOTS).astype(np.int16)
        # Rows of a group are adjacent; in it they go by the first pivot, so a row's partners follow until they are too far.
        order = np.lexsort((table[:, 0], group))
        group, node, table, fp = group[order], node[order], table[order], fp[order]
        first = table[:, 0]
        found_a, found_b = [], []
        a = np.arange(len(group))
        for gap in itertools.count(1):
            a = a[a < len(group) - gap]
            a = a[(group[a] == group[a + gap]) & (first[a + gap] - first[a] <= most)]
            if not len(a):
                break
            x, y = _within(table, fp, a, a + gap, most)
            if len(x):
                found_a.append(x), found_b.append(y)
            if sum(map(len, found_a)) > 500_000:
                # What is linked so far shrinks to its forest, so a dense group doesn't pile up pairs.
                found_a, found_b = ([e] for e in local_roots(np.concatenate(found_a), np.concatenate(found_b)))
        if not found_a:
            return None
        nodes, roots = local_roots(node[np.concatenate(found_a)], node[np.concatenate(found_b)])
        own = nodes != roots
        return batch(EDGE, nodes[own], roots[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush(last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
            t = pa.Table.from_batches(held).combine_chunks()
            group, node, *words = (t.column(i).to_numpy() for i in range(t.num_columns) if t.schema.field(i).name != "pivots")
            end = len(group) if last else int(np.flatnonzero(group != group[-1])[-1] + 1) if group[0] != group[-1] else 0
            out = links(group[:end], node[:end], t.column("pivots").slice(0, end), np.stack(words, axis=1)[:end].view(np.uint64)) if end else None
            return out, t.slice(end).to_batches()

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 65536:
                out, held = flush(False)
                n = sum(x.num_rows for x in held)
                if out is not None:
                    yield out
        if held:
            out, _ = flush(True)
            if out is not None:
                yield out

    return run


def fingerprint_links(distinct: DataFrame, masks: list[list[int]], max_bits: int, block: int = BLOCK, broadcast_keys: int = 1_000_000) -> DataFrame:
    """``node, root``: a forest whose trees are the components of distinct fingerprints (``node, fp0, ..., pivots``) that meet under a mask."""
    names = [c for c in distinct.columns if c not in ("node", "pivots")]
    key = lambda n, mask: F.xxhash64(F.lit(n), *(F.col(c).bitwiseAND(F.lit(signed(m))) for c, m in zip(names, mask, strict=True)))
    filed = distinct.select("node", *names, "pivots", F.explode(F.array(*(key(n, m) for n, m in enumerate(masks)))).alias("key"))
    counts = filed.groupBy("key").agg(F.count("*").alias("n"))
    # Keys of one block or less need no split; the others are few, and are broadcast if they are.
    large = Table(counts.filter(F.col("n") > block), "large-keys").df
    few = large.limit(broadcast_keys + 1).count() <= broadcast_keys
    met = filed.join(F.broadcast(large) if few else large, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A row of block i goes to the block pairs (i, j) and (j, i) with the smaller one first.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group")
    dealt = met.select(group, "node", *names, "pivots").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(lean(_linker(max_bits)), "node long, root long")


SET = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("size", pa.int32()), ("shingles", pa.binary())])


def _shingle_sets(k: int, seed: int):
    """The sorted distinct shingle hashes of texts (``node, root, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for text in raw(b.column(2)):
                parts = [*shingle_hashes(text, k, seed)]
                sets.append(np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64))
            yield batch(SET, b.column(0), b.column(1), [len(x) for x in sets], [x.tobytes() for x in sets])

    return run


def alike(one: np.ndarray, two: np.ndarray, jaccard: float) -> bool:
    """Whether two sorted sets have the similarity; two empty ones are equal."""
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared >= jaccard * (len(one) + len(two) - shared)


def _with_first(jaccard: float):
    """Whether documents have the similarity with the first one of their component (``node, root, size, shingles, first``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), jaccard) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns[:4], pa.array(linked, pa.bool_())], [*SET.names, "linked"])

    return run


def linked_sets(node: np.ndarray, sets: list[np.ndarray], linked: np.ndarray, jaccard: float) -> list[tuple[int, int]]:
    """Pairs of positions that have the similarity, as many as connect all that such pairs connect.

    Linked rows are of one component as they are, and aren't compared with each other.
    """
    rows = len(sets)
    size = np.array([len(x) for x in sets])
    value, at = np.concatenate(sets), np.repeat(np.arange(rows), size)
    _, kind, often = np.unique(value, return_inverse=True, return_counts=True)
    holders = at[np.argsort(kind, kind="stable")]
    begin = np.cumsum(often) - often
    first = np.cumsum(size) - size
    root = np.arange(rows)
    if linked.any():
        root[linked] = np.flatnonzero(linked)[0]
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(~linked).tolist():
        own = kind[first[i] : first[i] + size[i]]
        n = often[own]
        places = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(holders[places], minlength=rows)
        near = (shared >= jaccard * (size + size[i] - shared)) & (root != root[i])
        for j in np.flatnonzero(near).tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return out


def _set_linker(jaccard: float):
    """The links of each group of adjacent rows ``group, node, size, shingles, linked``; a group is bounded by its shingles and its rows."""

    def links(rows: list[tuple[int, bytes, bool]]) -> pa.RecordBatch | None:
        rows = [*{r[0]: r for r in rows}.values()]
        if len(rows) < 2:
            return None
        node = np.array([r[0] for r in rows], np.int64)
        pairs = linked_sets(node, [np.frombuffer(r[1], np.uint64) for r in rows], np.array([r[2] for r in rows]), jaccard)
        ends = [sorted((int(node[a]), int(node[b])), reverse=True) for a, b in pairs]
        return batch(EDGE, *zip(*ends, strict=True)) if ends else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for b in batches:
            columns = (b.column(n).to_pylist() for n in ("group", "node", "shingles", "linked"))
            for own, *row in zip(*columns, strict=True):
                if own != group:
                    if (out := links(held)) is not None:
                        yield out
                    group, held = own, []
                held.append(tuple(row))
        if (out := links(held)) is not None:
            yield out

    return run


def verified_roots(texts: DataFrame, members: DataFrame, shingle_words: int, seed: int, jaccard: float, shingles: int = SHINGLES, block: int = BLOCK, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``node, root`` of the components that links of the similarity make within those of ``members`` (``node, row, root``; ``texts``: ``row, text``)."""
    asked = within(texts, members.select("row").distinct(), "row", broadcast_keys).dropDuplicates(["row"])
    asked = asked.join(members, "row").select("node", "root", "text")
    sets = Table(asked.mapInArrow(lean(_shingle_sets(shingle_words, seed)), "node long, root long, size int, shingles binary"), "shingle-sets").df
    sizes = sets.groupBy("root").agg(F.sum("size").alias("all"), F.count("*").alias("n"))
    large = sized(sizes.filter((F.col("all") > shingles) | (F.col("n") > block)).withColumn("mean", F.ceil(F.col("all") / F.col("n"))).select("root", "mean"), "large-components")
    small = sets.join(large, "root", "left_anti").select(F.col("root").alias("group"), "node", "size", "shingles", F.lit(False).alias("linked"))

    # The first of a large component links what it can; only the others are compared with all.
    of_large = sets.join(large, "root")
    firsts = Table(of_large.filter("node = root").select("root", F.col("shingles").alias("first")), "first-sets").df
    few = (firsts.agg(F.sum(F.length("first"))).first()[0] or 0) <= FIRSTS
    compared = of_large.join(F.broadcast(firsts) if few else firsts, "root").select(*SET.names, "first")
    compared = Table(compared.mapInArrow(lean(_with_first(jaccard)), "node long, root long, size int, shingles binary, linked boolean"), "compared-sets").df
    open_ones = compared.groupBy("root").agg(F.sum(F.col("size").cast("long")).alias("all"), F.count("*").alias("n"), F.sum((~F.col("linked")).cast("int")).alias("open"), F.sum(F.when(~F.col("linked"), F.col("size")).otherwise(0)).alias("open_all"))
    blocks = lambda n, size: F.greatest(F.ceil(2 * n / block), F.ceil(2 * size / shingles)).cast("int")
    dealt = open_ones.filter("open > 0").select("root", blocks(F.col("open"), F.col("open_all")).alias("open_blocks"), blocks(F.col("n") - F.col("open"), F.col("all") - F.col("open_all")).alias("linked_blocks"))
    dealt = compared.join(sized(dealt, "open-components"), "root")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("linked_blocks")).otherwise(F.col("open_blocks"))).cast("int")
    key = lambda kind, a, b: F.xxhash64("root", F.lit(kind), a, b)
    each = F.sequence(F.lit(0), F.col("open_blocks") - 1)
    among = F.transform(each, lambda o: key(0, F.least(F.col("own"), o), F.greatest(F.col("own"), o)))
    across = F.transform(F.sequence(F.lit(0), F.col("linked_blocks") - 1), lambda a: key(1, F.col("own"), a))
    groups = F.when(F.col("linked"), F.transform(each, lambda o: key(1, o, F.col("own")))).otherwise(F.concat(among, across))
    met = dealt.withColumn("own", own).withColumn("group", F.explode(groups)).select("group", "node", "size", "shingles", "linked")

    def edges(rows: DataFrame) -> DataFrame:
        return rows.repartition("group").sortWithinPartitions("group", "node").mapInArrow(lean(_set_linker(jaccard)), "node long, root long")

    return components(edges(small).unionByName(edges(met)).unionByName(compared.filter("linked AND node <> root").select("node", "root")))


def simhash_groups(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 3, max_bits: int = 3, seed: int = 42,
    words: int = 1, repeats: bool = True, similarity: float | None = None, recall: float = 0.97, jaccard: float | None = None,
) -> DataFrame:
    """One row per input row: ``id, row, fp0, ..., component_id, root``; component_id is the smallest id reachable by links, itself included.

    Fingerprints of 64 * words bits link at ``max_bits`` or fewer differing ones.
    Without a ``similarity`` (and with one word) all such pairs are found; with
    it, pairs of that Jaccard similarity with probability ``recall``, more
    similar ones with a higher one.

    Texts without words, null ones among them, are equal to each other. Texts
    with the same words have the same fingerprint: they are linked once, by it.
    Null ids don't count as smallest unless a group has no other. ``row`` is the
    XXH64 of the text, which tells rows apart that share an id; ``root`` names
    the component. An empty table gives an empty result. Other columns are ignored.
    """
    if words > 1 and similarity is None:
        raise ValueError("fingerprints of several words need a similarity")
    names = print_columns(words)
    prints = Table(fingerprints(df, id_column, text_column, shingle_words, seed, words, repeats), "fingerprints").df
    node = F.col("fp0") if words == 1 else F.xxhash64(*names)
    distinct = Table(with_pivots(prints.groupBy(*names).agg(F.min("id").alias("least"), F.min("row").alias("text_row")).withColumn("node", node), names), "pivot-table").df
    masks = segment_masks(max_bits) if similarity is None else sampled_masks(words, distinct.count(), similarity, recall)
    roots = components(fingerprint_links(distinct.select("node", *names, "pivots"), masks, max_bits))
    if jaccard is not None:
        # Nodes that aren't their own root are listed; each of them and its root is a member.
        loose = Table(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "loose-components").df
        members = Table(loose.join(distinct.select("node", F.col("text_row").alias("row")), "node").select("node", "row", "root"), "loose-members").df
        text = text_of(text_column).cast("string")
        roots = verified_roots(df.select(F.xxhash64(text).alias("row"), text.alias("text")), members, shingle_words, seed, jaccard)
    rooted = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = Table(rooted, "rooted-prints").df
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = sized(rooted.join(sized(least, "component-ids"), "root").select(*names, "component_id", "root"), "named-prints")
    return prints.join(named, names, "left").select("id", "row", *names, "component_id", "root")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of every row of ``documents``."""
    out = simhash_groups(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
