import math
import zlib
from collections import Counter

import numpy as np
import pytest
from framelake.llm import hmm


def test_forward_equals_the_sum_over_paths():
    rng = np.random.default_rng(0)
    m = hmm.Model(rng.dirichlet(np.ones(hmm.CLASSES)), states=3)
    words = rng.integers(0, hmm.CLASSES, 6)
    total = 0.0
    for path in np.ndindex(*[3] * 6):
        p = m.start[path[0]] * m.ratio[words[0], path[0]]
        for t in range(1, 6):
            p *= m.move[path[t - 1], path[t]] * m.ratio[words[t], path[t]]
        total += p
    assert hmm.forward(m, [words.astype(np.uint16)])[0] == pytest.approx(math.log(total))


def test_long_texts_are_products():
    rng = np.random.default_rng(1)
    m = hmm.Model(rng.dirichlet(np.ones(hmm.CLASSES)))
    x = rng.integers(0, hmm.CLASSES, hmm.LONG + 300).astype(np.uint16)
    now, total = m.start * m.ratio[x[0]], 0.0
    for w in x[1:]:
        total += math.log(now.sum())
        now = (now / now.sum()) @ m.move * m.ratio[w]
    assert hmm.forward(m, [x])[0] == pytest.approx(total + math.log(now.sum()))


def test_expected_counts_add_up_and_raise_the_likelihood():
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(1, 30, n) + 400 * (n % 2), hmm.END).astype(np.uint16) for n in rng.integers(1, 200, 50)]
    base = np.bincount(np.concatenate(texts), minlength=hmm.CLASSES) / sum(map(len, texts))
    m = hmm.Model(base, states=2)
    before = hmm.forward(m, texts).sum()
    for _ in range(4):
        sums = hmm.expected(m, texts)
        assert sums[:2].sum() == pytest.approx(50, rel=1e-4)
        assert sums[6:].sum() == pytest.approx(sum(map(len, texts)), rel=1e-4)
        m.fit(sums)
    assert hmm.forward(m, texts).sum() > before + 100


def test_counts_are_those_of_whole_texts():
    rng = np.random.default_rng(3)
    m = hmm.Model(rng.dirichlet(np.ones(hmm.CLASSES)), states=3)
    texts = [rng.integers(0, 60, n).astype(np.uint16) for n in (1, 2, 7, 8, 15, 40, 100)]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES))
    for x in texts:
        alpha, beta = np.zeros((len(x), 3)), np.ones((len(x), 3))
        for t, w in enumerate(x):
            alpha[t] = (alpha[t - 1] @ m.move if t else m.start) * m.ratio[w]
            alpha[t] /= alpha[t].sum()
        for t in range(len(x) - 2, -1, -1):
            beta[t] = m.move @ (m.ratio[x[t + 1]] * beta[t + 1])
            beta[t] /= beta[t].sum()
        gamma = alpha * beta / (alpha * beta).sum(axis=1, keepdims=True)
        starts += gamma[0]
        np.add.at(emits.T, x.astype(int), gamma)
        for t in range(len(x) - 1):
            pair = alpha[t][:, None] * m.move * (m.ratio[x[t + 1]] * beta[t + 1])[None, :]
            moves += pair / pair.sum()
    want = np.concatenate([starts, moves.ravel(), emits.ravel()])
    for run in (7, 8, 1000):
        assert hmm.expected(m, texts, run) == pytest.approx(want, rel=1e-3, abs=1e-4)


def check(df, rows, monkeypatch=None):
    count = Counter()
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b""]
        out[i, t] = zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        if not out[i, t]:
            count.update(w)
    n, kinds = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b""]
        want.append((str(i), out[i, t], len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (kinds + 1))) for x in w), 6)))
    got = hmm.hmm_scores(df).collect()
    assert sorted((str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) for r in got)
    return got


def test_odd_rows(odd, odd_rows):
    check(odd, odd_rows)


def test_rare_words_are_joined(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(hmm, "NEAR", 3)
    check(odd, odd_rows)


def test_class_masses_sum_to_one(spark):
    counts = spark.createDataFrame([(bytearray(f"w{i}".encode()), i + 1) for i in range(3000)], "word binary, n long")
    total = 3000 * 3001 // 2 + 7
    room = total + 0.1 * 3002
    near = {f"w{i}".encode(): ((i + 1.1) / room, 3000 - i if i >= 2000 else hmm.hashed_class(f"w{i}".encode())) for i in range(1000, 3000)}
    q = hmm.base_classes(counts, near, room)
    q[hmm.END] = 7.1 / room
    assert q.sum() == pytest.approx(1 + (hmm.HASHED - 1) * 0.1 / room)


def test_model_beats_the_base_on_held_out_texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        stem, end = ("ab", "x") if i % 2 else ("cd", "yz")
        rows.append((i, " ".join(f"{stem}{rng.integers(50)}{end}" for _ in range(40))))
    got = [r for r in hmm.hmm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert got and all(r["score"] > r["base_score"] + 5 for r in got)


def test_empty_table(none):
    assert hmm.hmm_scores(none).count() == 0


def test_no_training_rows(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = hmm.hmm_scores(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in got} == {(0, 0)} and all(r["base_score"] == 0 for r in got)
