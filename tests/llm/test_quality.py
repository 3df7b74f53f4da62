import zlib

import numpy as np
import pytest
from framelake.llm import quality

from tests.llm.conftest import docs


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    words = ["river", "stone", "light", "market", "winter", "letter", "garden", "music"]
    rows, marks = [], []
    for i in range(600):
        good = i % 4 > 0
        text = " ".join(rng.choice(words, 60)) if good else " ".join(w + "$$$" for w in rng.choice(words, 60)) if i % 8 else " ".join(np.repeat(rng.choice(words, 6), 10))
        rows.append((i, text))
        marks.append((i, int(good), 0))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {i: q for i, q, _ in marks}


def test_held_out_accuracy(labelled):
    df, marks, truth = labelled
    got = quality.quality_classifier(df, marks).collect()
    test = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(test) > 100 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_held_out_labels_are_never_learned(labelled, spark):
    df, marks, _ = labelled
    other = marks.selectExpr("doc_id", "CASE WHEN pmod(crc32(CAST(doc_id AS STRING)), 4) = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r["doc_id"]: r["score"] for r in quality.quality_classifier(df, m).collect()} for m in (marks, other))
    assert a == b


def test_odd_rows_are_all_scored(odd, odd_rows, labelled):
    _, marks, _ = labelled
    got = quality.quality_classifier(odd, marks).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)


def test_scores_depend_on_text_alone(labelled):
    scorer = quality.Scorer(np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    assert scorer.score(b"a b  c") == scorer.score(b"a b\nc") and 0 < scorer.score(b"") < 1


def test_sample_bounds(labelled):
    df, marks, _ = labelled
    texts, _ = quality.sample(df, marks, "doc_id", "text", "quality", max_rows=10)
    assert len(texts) == 10
    texts, _ = quality.sample(df, marks, "doc_id", "text", "quality", max_bytes=1000)
    assert 0 < sum(map(len, texts)) <= 1000


def test_without_labels_and_rows(none, odd, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_classifier(none, empty).count() == 0
    assert {r["score"] for r in quality.quality_classifier(odd, empty).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality_classifier(odd, nulls).collect()} == {0.5}


def test_long_texts_dont_crowd_out_the_sample(spark):
    # The first texts by hash of their id are too long or nearly so.
    ids = [r["id"] for r in spark.range(100).filter(~quality.held_out(quality.F.col("id"))).selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()]
    long = {ids[0]: 20_000, ids[1]: 9_000, ids[3]: 600}
    df = docs(spark, [(i, "x" * long.get(i, 50)) for i in ids])
    marks = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    texts, _ = quality.sample(df, marks, "doc_id", "text", "quality", max_bytes=10_000)
    assert sorted(map(len, texts)) == [50] * (len(ids) - 3) + [600]
    with pytest.raises(ValueError, match="no labelled text fits"):
        quality.sample(df, marks, "doc_id", "text", "quality", max_bytes=40)
