"""Centroid clustering of integer vectors: Lloyd's rounds over different vectors, weighted by how often they occur.

Equal quantised vectors are one row with their multiplicity, so a vector that a third of the rows share costs as much as
any other. A round sends back a sum for each task and centroid, all of them exact integers; the assignments of the
different vectors are joined to the rows at the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.common import heavy_hitters, map_arrow, written

DIMS, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: Components up to EXACT have distances that float64 products give exactly; others go by Python's integers.
EXACT = 2**22
#: Quantised components beyond this are taken as this: their squared distances are beyond a long anyway.
LARGEST = 2**62
LONG = 2**63 - 1


class _Quantised:
    """(id, packed components, their digest) of the vectors of `dims` finite components; others give no row."""

    def __init__(self, dims: int, scale: int):
        self.dims, self.scale = dims, scale

    def __call__(self, batches):
        for batch in batches:
            vectors = batch.column(1)
            right = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == self.dims)
            flat = vectors.take(pa.array(right, pa.int64())).flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, self.dims).all(axis=1)
            x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, self.dims)
            known &= np.isfinite(x).all(axis=1)
            x = np.floor(np.clip(x[known], -LARGEST, LARGEST) * self.scale).clip(-LARGEST, LARGEST).astype("<i8")
            packed = [row.tobytes() for row in x]
            columns = [batch.column(0).take(pa.array(right[known], pa.int64())), pa.array(packed, pa.binary()), pa.array([hashlib.sha256(p).digest()[:16] for p in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "packed", "digest"])


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """For each vector its nearest centroid (the smaller number of equals) and the exact squared distance."""
    near, far = np.zeros(len(x), np.int32), [0] * len(x)
    plain = np.abs(x).max(axis=1, initial=0) <= EXACT
    if max(abs(v) for c in centroids for v in c) <= EXACT and plain.any():
        c, some = np.array(centroids, np.float64), x[plain].astype(np.float64)
        d = (some**2).sum(axis=1)[:, None] - 2 * (some @ c.T) + (c**2).sum(axis=1)
        near[plain] = d.argmin(axis=1)
        for i, v in zip(np.flatnonzero(plain), d.min(axis=1), strict=True):
            far[i] = int(v)
    else:
        plain = np.zeros(len(x), bool)
    for i in np.flatnonzero(~plain):
        row = x[i].tolist()
        far[i], near[i] = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), k) for k, c in enumerate(centroids))
    return near, far


class _Sums:
    """(cluster, n, components' sums) of a task's vectors, weighted by n; sums as decimal text."""

    def __init__(self, centroids: list[list[int]], dims: int):
        self.centroids, self.dims = centroids, dims

    def __call__(self, batches):
        counts, sums = {}, {}
        for batch in batches:
            x, n = _unpacked(batch.column(0), self.dims), batch.column(1).to_numpy(zero_copy_only=False)
            near, _ = nearest(x, self.centroids)
            # what could pass a long is added up by Python's integers
            fits = len(x) == 0 or float(np.abs(x).max()) * float(n.sum()) < 2**62
            weighted = x * n[:, None] if fits else x.astype(object) * n.astype(object)[:, None]
            for k in np.unique(near).tolist():
                own = near == k
                counts[k] = counts.get(k, 0) + int(n[own].sum())
                sums[k] = [a + int(b) for a, b in zip(sums.get(k, [0] * self.dims), weighted[own].sum(axis=0), strict=True)]
        keys = sorted(counts)
        columns = [pa.array(keys, pa.int32()), pa.array([counts[k] for k in keys], pa.int64()), pa.array([[str(v) for v in sums[k]] for k in keys], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])


class _Assigned:
    def __init__(self, centroids: list[list[int]], dims: int):
        self.centroids, self.dims = centroids, dims

    def __call__(self, batches):
        for batch in batches:
            near, far = nearest(_unpacked(batch.column(0), self.dims), self.centroids)
            columns = [batch.column(1), batch.column(2), pa.array(near, pa.int32()), pa.array([min(v, LONG) for v in far], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "n", "cluster", "distance"])


def first_centroids(rows: DataFrame, k: int, dims: int) -> list[list[int]]:
    """The vectors of the k rows whose `2:<id>` has the smallest SHA-256, in that order; rows of one id by their components."""
    order = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(order.alias("order"), F.col("id").isNull().alias("last"), "packed").orderBy("last", "order", "packed").limit(k).collect()
    return [np.frombuffer(bytes(r["packed"]), "<i8").tolist() for r in first]


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int, dims: int) -> list[list[int]]:
    """Centroids after `rounds` rounds over distinct (packed, n). A round collects a row for each centroid."""
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    for _ in range(rounds):
        sums = map_arrow(distinct.select("packed", "n"), _Sums(centroids, dims), "cluster int, n long, sums array<string>")
        centroids = list(centroids)
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return centroids


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly `dims` components, none null or non-finite; component x becomes floor(scale * x).
    Null vectors and others drop out; rows may repeat ids and vectors, each is counted; a null id never starts a
    cluster while k others are there. With fewer than k kept vectors there are as many clusters; an empty
    table gives an empty result. Columns other than the two named are not read. Components of 2^62 and more count as
    2^62, and distances and inertias beyond a long as the largest long.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    picked = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    rows = written(map_arrow(picked, _Quantised(dims, scale), f"id {kind}, packed binary, digest binary"), "vectors")
    start = first_centroids(rows, k, dims)
    if not start:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    distinct = written(rows.groupBy("digest", "packed").agg(F.count(F.lit(1)).alias("n")), "distinct")
    centroids = lloyd(distinct, start, rounds, dims)
    assigned = map_arrow(distinct.select("packed", "digest", "n"), _Assigned(centroids, dims), "digest binary, n long, cluster int, distance long")
    assigned = written(assigned, "assigned")
    weighted = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("s")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(weighted).collect()}  # k rows
    whole = min(sum(inertia.values()), LONG)
    known = [(c, min(s, LONG), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sorted(inertia.items())]
    known = F.broadcast(spark.createDataFrame(pd.DataFrame(known, columns=["cluster", "cluster_inertia", "inertia", "centroid_sha256"]), "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    # vectors with many rows find their cluster by a broadcast of at most 1000 of them, the others by an ordinary shuffle
    ids, lookup = rows.select("id", "digest"), assigned.select("digest", "cluster", "distance")
    hot = written(lookup.join(F.broadcast(heavy_hitters(ids, "digest")), "digest", "left_semi"), "hot")
    settled = ids.join(F.broadcast(hot), "digest")
    rest = ids.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(lookup, "digest")
    out = settled.unionByName(rest).join(known, "cluster")
    return out.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """The rounds unrolled; vectors and centroids as a row for each component."""
    steps = [
        f"""WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
parts AS (SELECT vec_id, unnest(v) AS x, unnest(range({dims})) AS dim FROM kept),
c0 AS (SELECT cluster, unnest(v) AS c, unnest(range({dims})) AS dim FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v FROM kept) WHERE cluster < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT vec_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM parts JOIN c{i} USING (dim) GROUP BY ALL)")
        steps.append(f"a{i} AS (SELECT vec_id, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS r FROM d{i}) WHERE r = 1)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM parts JOIN a{i} USING (vec_id) GROUP BY ALL)")
            steps.append(f"c{i + 1} AS (SELECT cluster, dim, CASE WHEN n IS NULL THEN c ELSE (s - (s % n + n) % n) // n END AS c FROM c{i} LEFT JOIN s{i} USING (cluster, dim))")
    steps.append(f"h AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    last = f"a{rounds}"
    return ",\n".join(steps) + f"\nSELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM {last} JOIN h USING (cluster)"


QUERIES = {"op12_centroids": op12_centroids}
SQL = {"op12_centroids": _sql()}
