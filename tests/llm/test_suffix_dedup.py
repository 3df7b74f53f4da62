import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from framelake.llm.suffix_dedup import owners, spans, substring_dedup

from tests.llm.conftest import docs


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        cut = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                cut[s : s + length] = True
        left = np.frombuffer(t, np.uint8)[~cut].tobytes()
        out.append((str(i), len(t), int(cut.sum()), int((np.diff(cut.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def got(df, length, **options):
    return sorted((str(r["id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup(df, length=length, **options).collect())


@pytest.mark.parametrize("options", [{}, {"meet": 1}, {"broadcast_keys": 0}])
def test_random_texts(spark, options):
    rng = random.Random(9)
    parts = ["".join(rng.choice("abc é") for _ in range(rng.randrange(5, 90))) for _ in range(12)]
    rows = [(n, "".join(rng.choice([*parts, "xy", "q"]) for _ in range(rng.randrange(6)))) for n in range(80)]
    rows += [(80, None), (80, ""), (81, "a" * 200), (82, "ab" * 100), (None, parts[0] * 2), (3, rows[3][1])]
    assert got(docs(spark, rows), 24, **options) == brute(rows, 24)


def test_odd_rows(odd, odd_rows):
    assert got(odd, 400) == brute(odd_rows, 400)


def test_many_contexts_of_one_passage(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh") for _ in range(40))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(10, 60)))
    rows = [(n, word() + passage + word()) for n in range(150)]
    assert got(docs(spark, rows), 30, meet=20) == brute(rows, 30)


def test_blocks_of_long_texts(monkeypatch, spark):
    from framelake.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    rng = random.Random(4)
    part = "".join(rng.choice("ab") for _ in range(70))
    texts = [part + "".join(rng.choice("ab") for _ in range(300)) + part, part[5:] + "zz"]
    own = [[x.tolist() for x in c] for t in texts for c in suffix_dedup.anchors(t.encode(), 20)]
    assert sum(sum(c[3]) for c in own) == sum(len(t) - 19 for t in texts)


def test_owners_are_leftmost_minima():
    rank = np.array([5, 3, 3, 9, 1, 1, 8], np.uint64) << np.uint64(40)
    assert owners(rank, 3).tolist() == [1, 1, 4, 4, 4]


def test_spans_merge():
    assert spans(np.array([10, 0, 3]), np.array([1, 2, 1]), 5).tolist() == [[0, 8], [10, 15]]


def test_texts_on_request(spark):
    row = substring_dedup(docs(spark, [(1, "uno" + "x" * 12 + "dos"), (2, "x" * 12)]), length=10, with_text=True).filter("id = 1").first()
    assert bytes(row["kept"]) == b"unodos" and row["spans"] == [[3, 15]]


def test_empty_table(none):
    assert substring_dedup(none).count() == 0
