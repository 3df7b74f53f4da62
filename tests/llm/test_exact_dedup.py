import hashlib
import importlib
import re
from collections import Counter

from framelake.llm.exact_dedup import directory, exact_dedup, normalised
from framelake.llm.rows import drop_documents, losers, repeated
from pyspark.sql import functions as F


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check(out, rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = Counter()
    for i, t in rows:
        own = groups[norm(t)]
        ids = [x for x in own if x is not None]
        keep = i if len(own) == 1 else min(ids) if ids else None
        want[i, keep, len(own), i is not None and i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in out.select("id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_odd_rows_match_brute_force(odd, odd_rows):
    check(exact_dedup(odd), odd_rows)


def test_shuffled_path_equals_broadcast_path(odd, odd_rows):
    check(exact_dedup(odd, bucket_keys=2, broadcast_keys=0), odd_rows)


def test_empty_table(none):
    assert exact_dedup(none).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    cells = directory(keys, 50).collect()
    sizes = Counter()
    bucket = {r["cell"]: r["bucket"] for r in cells}
    for r in keys.collect():
        sizes[bucket[(r["key"] % 2**64) >> 50]] += 1
    assert max(sizes.values()) <= 50 and len({r["depth"] for r in cells}) >= 1 and sum(sizes.values()) == 1000


def test_many_copies_are_one_key(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact_dedup(df)
    assert out.filter("keep_id = 0").count() == out.filter("keep_id = 0").first()["group_size"] == 1667


def test_normalises_only_ascii_space(spark):
    df = spark.createDataFrame([("a b \r\n\x0b c",)], ["t"])
    assert df.select(normalised(F.col("t"))).first()[0] == "a b c"


def test_dropping_keeps_one_row_of_each_text(odd, odd_rows):
    decided = exact_dedup(odd).select("id", "row", "text_sha256").cache()
    left = drop_documents(odd, losers(decided, "text_sha256"), repeated(decided)).collect()
    assert len(left) == len({norm(t) for _, t in odd_rows}) == len({norm(r["text"]) for r in left})
    assert left[0].asDict().keys() == {"doc_id", "text", "id", "row", "key", "fp", "score", "n"}


def test_the_directory_places_what_is_found(odd, monkeypatch):
    """Entries and chains meet in the buckets that the directory names: without a cell, its rows are lost."""
    module = importlib.import_module("framelake.llm.exact_dedup")
    whole = module.exact_dedup(odd, bucket_keys=3).select("id", "bucket").collect()
    assert len({r["bucket"] for r in whole}) > 3
    made = module.directory
    monkeypatch.setattr(module, "directory", lambda *a: made(*a).filter(f"bucket <> {whole[0]['bucket']}"))
    assert len(module.exact_dedup(odd, bucket_keys=3).collect()) == sum(r["bucket"] != whole[0]["bucket"] for r in whole) < len(whole)
