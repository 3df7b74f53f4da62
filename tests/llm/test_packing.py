import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from framelake.llm import packing
from framelake.llm.packing import Encoder, best_fit, best_fit_packing, cut
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(library):
    rng, own = random.Random(5), Encoder(PATH)
    assert own.fast
    letters = "ab éß \n\t.,'sLL12²½\u0085\xa0中😀  <|>"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30))) + rng.choice(["", "", "<|endoftext|>", "it's we'll"])
        assert own(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 5, 2047, 2048, 2049, 4096, 10_000])
def test_cut(n):
    parts = cut(n, 2048)
    assert parts[0][0] == 0 and sum(p[1] for p in parts) == n and all(p[1] == 2048 for p in parts[1:]) and 1 <= parts[0][1] <= 2048
    assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))]


def test_best_fit_is_gapless_and_tight():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 2049) for _ in range(3000)]
    bins, at = best_fit(lengths, 2048)
    own = defaultdict(list)
    for b, o, n in zip(bins, at, lengths):
        own[b].append((o, n))
    for items in own.values():
        items.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and items[0][0] == 0 and sum(n for _, n in items) <= 2048
    assert len(own) <= 1.02 * sum(lengths) / 2048 + 1


def verify(out, rows, library):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[i] += [(n, s, k, zlib.crc32(ids[s : s + k].tobytes())) for n, (s, k) in enumerate(cut(len(ids), 2048))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    return len(places), sum(r["length"] for r in out)


def test_odd_rows(odd, odd_rows, library):
    verify(best_fit_packing(odd, PATH).collect(), odd_rows, library)


def test_tree_over_many_partitions(spark, library):
    rng = random.Random(2)
    rows = [(n, " ".join("word" for _ in range(rng.randrange(1, 1500)))) for n in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    bins, total = verify(best_fit_packing(df, PATH).collect(), rows, library)
    assert bins <= 1.02 * total / 2048 + 1


@pytest.mark.parametrize("sizes", [(1, 2048), (1100, 1100), (300, 900)])
def test_tree_of_three_levels(spark, monkeypatch, sizes):
    """Eighty leaves under nodes of four: 80, 20, 5, 2, 1; what meets in a node is bounded."""
    rng = random.Random(3)
    rows = [(n, rng.randint(*sizes)) for n in range(8000)]
    seen = []
    table = packing.Table

    def kept(df, name):
        out = table(df, name)
        seen.append((name, out.df))
        return out

    monkeypatch.setattr(packing, "Table", kept)
    out = packing.pack(spark.createDataFrame(rows, "n long, length long").repartition(80), fan_in=4).collect()
    assert [n for n, _ in seen] == [f"packed-{i}" for i in range(5)]
    assert all(max((r["count"] for r in t.groupBy(F.shiftright("bin", 34)).count().collect()), default=0) <= 4 * 5 for _, t in seen[1:])
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted((r["n"], r["length"]) for r in out) == rows
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    # As good as best fit over all leaves' bins at once, to a thousandth.
    leaves = [r["filled"] for r in seen[0][1].select("bin", "filled").distinct().collect()]
    assert len(places) <= 1.001 * len(set(best_fit(leaves, 2048)[0])) + 1


def test_empty_table(none):
    assert best_fit_packing(none, PATH).count() == 0
