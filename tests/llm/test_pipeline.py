import re

import corpus_pipeline
import pytest
from framelake.llm.common import Table, components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(Table(stage(spark, out[-1], SF), "stage").df.cache())
    return out


def test_every_stage_keeps_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_stages_only_take_rows_away(stages):
    before = {r["doc_id"]: r["text"] for r in stages[0].collect()}
    for s in stages[1:4]:
        now = {r["doc_id"]: r["text"] for r in s.collect()}
        assert now.items() <= before.items()
        before = now


def test_no_normalised_text_is_left_twice(stages):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in stages[2].collect()]
    assert len(texts) == len(set(texts))


def test_no_passage_of_fifty_words_is_left_twice(stages):
    seen: dict = {}
    for r in stages[4].orderBy("doc_id").collect():
        w = (r["text"] or "").lower().split()
        for run in {tuple(w[i : i + 50]) for i in range(len(w) - 49)}:
            assert run not in seen, (r["doc_id"], seen[run])
            seen[run] = r["doc_id"]


def test_all_that_is_left_is_packed(stages):
    left = {r["doc_id"] for r in stages[4].collect()}
    packed = stages[5].collect()
    assert {r["doc_id"] for r in packed} == left
    used = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= 1.05 * sum(used.values()) / 2048 + 1


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, stages[5].select("doc_id", "piece", "ids_crc32").collect()))


@pytest.mark.parametrize("held", [10**6, 40])
def test_components_of_long_chains(spark, monkeypatch, held):
    from framelake.llm import common

    monkeypatch.setattr(common, "EDGES", held)
    edges = [(i + 1, i) for i in range(300)] + [(1000 + i, 1000) for i in range(50)] + [(2000, 2000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 50)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
