"""Embedding near-dedup by PCA-ordered, tiled comparison with early stopping.

Unit vectors are rotated onto the principal axes of all vectors (second moments are
summed across partitions; only the d x d sums reach the driver). Rotation keeps dot
products, and puts most of a product into its leading dimensions. Vectors are
compared within a label only, tile by tile: a tile pair accumulates the leading
dimensions first; by Cauchy-Schwarz the rest of a product is at most the product of
the two suffix norms, so a vector pair whose sum and bound stay below the threshold
is given up, and the tile pair ends when no pair is left. Survivors are verified in
double precision on the vectors as given.

Equal vectors of a label are one row with a multiplicity, so a vector that a third of
the table holds is compared once. A label of any size is dealt out as tile pairs of
bounded size. A tile pair emits link counts and a spanning forest, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import Table, components, local_roots, sized

THRESHOLD = 0.93
#: Vectors of a tile.
TILE = 1536
#: Dimensions after which pairs are given up.
STOPS = (4, 8, 16, 32)
#: Pairs of which whole vectors are compared at once.
PAIRS = 50_000
#: Slack for rounding of the bounds; survivors are verified exactly.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Not null, all components finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, all of one length, as rows."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, the axes as columns, largest second moment first."""

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(1).to_numpy()
            for d in np.unique(dims):
                u = unit(matrix(pa.chunked_array([b.column(0).filter(pa.array(dims == d))])))
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, m in sums.items():
            at = np.arange(m.size)
            yield pa.record_batch([pa.array(np.full(m.size, d), pa.int32()), pa.array(at, pa.int32()), pa.array(m.ravel())], ["dim", "at", "value"])

    parts = vectors.select("vector", "dim").mapInArrow(moments, "dim int, at int, value double")
    rows = parts.groupBy("dim", "at").agg(F.sum("value").alias("value")).collect()
    axes = {}
    for d in {r["dim"] for r in rows}:
        m = np.zeros(d * d)
        for r in rows:
            if r["dim"] == d:
                m[r["at"]] = r["value"]
        axes[d] = np.linalg.eigh(m.reshape(d, d))[1][:, ::-1]
    return axes


def _survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two rotated tiles whose product may reach the threshold."""
    d = a.shape[1]
    stops = [s for s in STOPS if s < d] + [d]
    rest = lambda x, s: np.sqrt(np.maximum((x[:, s:] ** 2).sum(axis=1), 0))
    product = np.zeros((len(a), len(b)))
    x = y = None
    done = 0
    for s in stops:
        if x is None:
            product += a[:, done:s] @ b[:, done:s].T
            open_pairs = product + np.outer(rest(a, s), rest(b, s)) >= threshold - SLACK
            n = np.count_nonzero(open_pairs)
            if not n:
                return np.empty(0, int), np.empty(0, int)
            if n < 0.05 * open_pairs.size or s == d:
                x, y = np.nonzero(open_pairs)
                sums = product[x, y]
        else:
            for lo in range(0, len(x), PAIRS):
                at = slice(lo, lo + PAIRS)
                sums[at] += np.einsum("ij,ij->i", a[x[at], done:s], b[y[at], done:s])
            keep = sums + rest(a, s)[x] * rest(b, s)[y] >= threshold - SLACK
            x, y, sums = x[keep], y[keep], sums[keep]
            if not len(x):
                break
        done = s
    return x, y


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def run(t: pa.Table) -> pa.Table:
        node, copies, tile, first = (t.column(c).to_numpy() for c in ("node", "copies", "own", "lower"))
        v = matrix(t.column("vector"))
        u = unit(v)
        y = u @ axes[v.shape[1]]
        i = np.flatnonzero(tile == first[0])
        j = np.flatnonzero(tile != first[0])
        same = not len(j) and bool((t.column("lower").to_numpy() == t.column("upper").to_numpy()).all())
        j = i if same else j
        links = np.zeros(len(node), np.int64)
        pa_, pb_ = [np.empty(0, int)], [np.empty(0, int)]
        for lo in range(0, len(i), 512):
            block = i[lo : lo + 512]
            a, b = _survivors(y[block], y[j], threshold)
            a, b = block[a], j[b]
            if same:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), PAIRS):
                p, q = a[at : at + PAIRS], b[at : at + PAIRS]
                cosine = np.einsum("ij,ij->i", v[p], v[q]) / (np.sqrt(np.einsum("ij,ij->i", v[p], v[p])) * np.sqrt(np.einsum("ij,ij->i", v[q], v[q])))
                if not np.isfinite(cosine).all():
                    cosine = np.einsum("ij,ij->i", u[p], u[q])
                ok = cosine >= threshold
                p, q = p[ok], q[ok]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                nodes, roots = local_roots(np.concatenate([pa_[-1], p]), np.concatenate([pb_[-1], q]))
                pa_[-1], pb_[-1] = nodes[nodes != roots], roots[nodes != roots]
        p, q = pa_[-1], pb_[-1]
        own = np.flatnonzero(links)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table({
            "node": pa.concat_arrays([pa.array(node[own]), pa.array(node[p])]),
            "other": pa.concat_arrays([none(len(own)), pa.array(node[q])]),
            "links": pa.concat_arrays([pa.array(links[own]), none(len(p))]),
        })

    return run


def embedding_near_dedup(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    threshold: float = THRESHOLD,
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept``.

    Rows link when their labels are equal and not null, their vectors have the
    same length, and their cosine is at least the threshold (below 1, so that
    equal vectors always link). Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing: 0 links, their own component,
    kept. n_links counts other rows, repeated rows each for itself. A null id
    isn't kept unless it is alone; it never names a component that has an id.
    """
    vector = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), vector.alias("vector"))
    ok = usable(F.col("vector")) & F.col("label").isNotNull()
    rows = rows.withColumn("vector", F.when(ok, F.col("vector")))
    distinct = (
        rows.filter("vector is not null and label is not null")
        .groupBy("label", "vector")
        .agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("vector"))
        .withColumn("node", F.xxhash64("label", "vector"))
    )
    distinct = Table(distinct, "distinct-vectors").df
    axes = principal_axes(distinct)
    count = distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    tiled = distinct.join(sized(count, "label-tiles"), ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumn("lower", F.least("own", "other")).withColumn("upper", F.greatest("own", "other"))
    pairs = tiled.select("label", "dim", "lower", "upper", "own", "node", "copies", "vector")
    found = pairs.groupBy("label", "dim", "lower", "upper").applyInArrow(_compare(axes, threshold), "node long, other long, links long")
    found = Table(found, "vector-links").df
    links = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other is not null").select("node", "other"))
    rooted = distinct.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = Table(rooted.select("label", "vector", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "rooted-vectors").df
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = Table(rooted.join(sized(least, "component-ids"), "root").select("label", "vector", "n_links", "component"), "named-vectors").df
    out = rows.join(named, ["label", "vector"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        "id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings``."""
    return embedding_near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
