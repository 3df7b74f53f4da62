import random

import xxhash
from framelake.llm import simhash
from framelake.llm.simhash import fingerprint, sampled_masks, segment_masks, simhash_groups
from pyspark.sql import functions as F

from tests.llm.conftest import docs


def brute(text, k=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = list(parent)
    for a in range(len(own)):
        for b in range(a):
            if (own[a] ^ own[b]).bit_count() <= 3:
                x, y = find(own[a]), find(own[b])
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in own}


def check(df, rows):
    prints = {(i, t): brute(t) for i, t in rows}
    root = components(set(prints.values()))
    least: dict = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    got = simhash_groups(df).collect()
    assert sorted((str(r["id"]), r["fp0"] % 2**64, r["component_id"]) for r in got) == sorted((str(i), prints[i, t], least.get(root[prints[i, t]])) for i, t in rows)


def test_fingerprints_and_components_of_odd_rows(odd, odd_rows):
    check(odd, odd_rows)


def test_near_copies_link(spark):
    rng = random.Random(3)
    base = [[f"{rng.randrange(10**6)}" for _ in range(200)] for _ in range(5)]
    rows = []
    for n in range(150):
        words = list(base[n % 5])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(200)] = "edit"
        rows.append((n, " ".join(words)))
    check(docs(spark, rows), rows)


def test_blocks_of_large_groups(spark):
    from framelake.llm.common import components as connect

    rng = random.Random(4)
    center = rng.getrandbits(63)
    prints = list({center ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(4))) for _ in range(300)})
    df = spark.createDataFrame([(f, f) for f in prints], "node long, fp0 long")
    got = {r["node"]: r["root"] for r in connect(simhash.fingerprint_links(simhash.with_pivots(df, ["fp0"]), simhash.segment_masks(3), 3, block=20)).collect()}
    root = components(prints)
    assert {f: got.get(f, f) for f in prints} == root


def test_very_long_texts_come_in_blocks(monkeypatch):

    text = " ".join(f"W{i % 977}" for i in range(5000)).encode()
    whole = fingerprint(text, 3, 42), fingerprint(text, 3, 42, 4, False)
    monkeypatch.setattr(simhash, "word_blocks", lambda t, size=7: iter([t.lower().split()[i : i + 7] for i in range(0, 5000, 7)]))
    assert (simhash.fingerprint(text, 3, 42), simhash.fingerprint(text, 3, 42, 4, False)) == whole


def test_recall_at_a_similarity(spark):
    rng = random.Random(11)
    rows, pairs = [], []
    for n in range(120):
        words = [f"{rng.randrange(10**7)}" for _ in range(300)]
        edited = list(words)
        # Five shingles change with each edited word: 6 edits of 300 words leave a similarity of 0.82.
        for at in rng.sample(range(0, 300, 10), 6):
            edited[at] = "edit"
        far = list(words)
        for at in rng.sample(range(0, 300, 10), 20):
            far[at] = f"far{rng.randrange(10**7)}"
        rows += [(3 * n, " ".join(words)), (3 * n + 1, " ".join(edited)), (3 * n + 2, " ".join(far))]
    got = {r["id"]: r["component_id"] for r in simhash_groups(docs(spark, rows), shingle_words=5, words=4, repeats=False, max_bits=48, similarity=0.8).collect()}
    assert sum(got[3 * n + 1] == 3 * n for n in range(120)) >= 112
    assert all(got[3 * n] == 3 * n and got[3 * n + 2] == 3 * n + 2 for n in range(120))


def test_words_and_similarity_of_odd_rows(odd, odd_rows):
    got = simhash_groups(odd, shingle_words=5, words=4, repeats=False, max_bits=48, similarity=0.8).collect()
    by_root: dict = {}
    for r in got:
        by_root.setdefault(r["root"], set()).add(r["id"])
    assert len(got) == len(odd_rows) and {1, 2, 3, None} in by_root.values() and {7, 8} in by_root.values() and {13, 14, 15} in by_root.values()


def test_masks_cover_their_promises():
    assert len(segment_masks(3)) == 10
    assert len(sampled_masks(4, 10**5, 0.8, 0.97)) < 40 and all(sum(m.bit_count() for m in s) == 14 for s in sampled_masks(4, 10**5, 0.8, 0.97))
    assert sum(m.bit_count() for m in sampled_masks(4, 2**30, 0.8, 0.97)[0]) == 26


def test_empty_table(none):
    assert simhash_groups(none).count() == 0


def test_pairs_come_from_the_stored_pivot_table(spark):
    """The written distances decide which fingerprints are compared: with those of one row moved, its link is lost."""
    df = spark.createDataFrame([(1, 0b1011), (2, 0b1010), (3, 0b111111 << 40)], "node long, fp0 long")
    table = simhash.with_pivots(df, ["fp0"])
    links = lambda t: {tuple(r) for r in simhash.fingerprint_links(t, simhash.segment_masks(3), 3).collect()}
    assert links(table) == {(2, 1)}
    assert links(table.withColumn("pivots", F.when(F.col("node") == 2, F.unhex(F.lit("00" * simhash.PIVOTS))).otherwise(F.col("pivots")))) == set()


def five_word_sets(rows):
    return {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in rows}


def by_jaccard(rows, least=0.8):
    """The smallest id that links of the similarity reach, by all pairs."""
    sets = five_word_sets(rows)
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if b < a and root[a] != root[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def near_rows(rng, copies, edits):
    base = [[f"{rng.randrange(10**6)}" for _ in range(150)] for _ in range(4)]
    rows = [(0, ""), (1, "  "), (2, "a b"), (3, "a b c")]
    for n in range(4, 4 + copies):
        words = list(base[n % 4])
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(150)] = f"{rng.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    return rows


def linked(spark, rows):
    found = simhash_groups(docs(spark, rows), shingle_words=5, words=4, repeats=False, max_bits=64, similarity=0.75, recall=0.995, jaccard=0.8)
    return {r["id"]: r["component_id"] for r in found.collect()}


def test_only_pairs_of_the_similarity_link(spark):
    rows = near_rows(random.Random(4), 120, 9)
    want = by_jaccard(rows)
    assert 10 < len(set(want.values())) < 100
    assert linked(spark, rows) == want


def test_large_components_are_compared_with_their_first(spark, monkeypatch):
    rows = near_rows(random.Random(5), 160, 9)
    defaults = list(simhash.verified_roots.__defaults__)
    monkeypatch.setattr(simhash.verified_roots, "__defaults__", (2000, 6, 0))
    assert len(defaults) == 3
    assert linked(spark, rows) == by_jaccard(rows)
