import math
import random
from collections import Counter

import numpy as np
import pytest
from framelake.llm.embedding_dedup import embedding_near_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node long, links string, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def check(df, rows, threshold=0.93, **options):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and l is not None for _, v, l in rows]
    vec = [np.array(v, np.float32).astype(float) if o else None for (_, v, _), o in zip(rows, ok)]
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(vec[a]) == len(vec[b]):
                if vec[a] @ vec[b] / math.sqrt((vec[a] @ vec[a]) * (vec[b] @ vec[b])) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    least: dict = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    want = Counter((rows[i][0], links[i], least.get(find(i)), rows[i][0] == least.get(find(i))) for i in range(n))
    assert Counter(tuple(r) for r in embedding_near_dedup(df, threshold=threshold, **options).collect()) == want


@pytest.mark.parametrize("tile", [4, 1000])
def test_random_vectors(spark, tile):
    rng = random.Random(8)
    centers = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for n in range(120):
        c = rng.choice(centers)
        rows.append((n, [x + rng.gauss(0, 0.25) for x in c], rng.choice([0, 0, 0, 1, None])))
    rows += [(200 + n, centers[0], 0) for n in range(30)]
    check(frame(spark, rows), rows, tile=tile)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 1.0], None),
        (8, [1.0, 1.0], 0), (8, [1.0, 1.0], 0), (None, [1.0, 1.0], 0), (None, None, 0), (9, [1.0, 1.0, 0.0], 0), (10, [2.0, 2.0], 0), (11, [1e-20, 1e-20], 0), (12, [3e38, 3e38], 0), (13, [-0.0, 1.0], 1), (14, [0.0, 1.0], 1),
    ]
    check(frame(spark, rows), rows)


def test_empty_table(spark):
    assert embedding_near_dedup(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_but_not_the_vector(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.01, 1.0], 0)]
    check(frame(spark, rows), rows)
