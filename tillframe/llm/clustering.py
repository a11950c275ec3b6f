"""Centroid clustering of integer vectors with Elkan's bounds.

Components become integers, so sums, means, distances and ties are exact and a result
does not depend on how rows are dealt out. Every round reads the vectors with what is
known of each (its centroid, an upper bound of the distance to it, a lower bound of the
distance to each centroid) and writes them anew to the shared folder, with the sums of
each cluster that its tasks have made; the last round's table goes. When the centroids
have moved, the bounds give way by as much. By the triangle inequality a distance to a
centroid needs no calculation if the upper bound lies below its lower bound, or below
half the distance between the two centroids. Bounds are rounded outwards and must be
undercut strictly, so a tie is always calculated, in integers. No vector is shuffled;
the driver sees a number for each centroid and component, which parameters bound.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components lie within this, so that squared distances of up to 512 of them are exact in 64 bits.
LARGEST = 1 << 26
#: Relative slack of a bound, some units in the last place.
SLACK = 2.0**-50


def quantized(df: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(key, q): floor(scale * component) as 32-bit integers, of vectors with so many components, none null or non-finite; others are left out."""

    def work(batch: pa.RecordBatch):
        column = batch.column(1)
        ends = np.asarray(column.offsets).astype(np.int64)
        flat = np.asarray(column.values.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
        rows = np.flatnonzero((np.diff(ends) == dimensions) & ~np.asarray(column.is_null()))
        x = flat[ends[rows, None] + np.arange(dimensions)]
        fine = np.isfinite(x).all(1)
        rows, q = rows[fine], np.floor(scale * x[fine])
        if len(q) and np.abs(q).max() > LARGEST:
            raise ValueError(f"a component is over {LARGEST / scale:g}, for which distances are not exact in 64 bits")
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _binary(q.astype("<i4"))], names=["key", "q"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v"))
    return rows.mapInArrow(common.batched(work), common.schema_of(rows, "q binary", ("v",)))


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as byte strings."""
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    offsets = (np.arange(len(data) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The byte strings of a column, all of one length, as rows of a matrix."""
    if not len(column):
        return np.zeros((0, width), kind)
    _, offsets, data = column.buffers()
    begin = int(np.frombuffer(offsets, np.int32, 1, column.offset * 4)[0])
    return np.frombuffer(data, kind, len(column) * width, begin).reshape(len(column), width)


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = q.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def nearest(q: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> int:
    """Bring a, upper and lower up to date with the centroids, in place; a tie goes to the smaller number.

    upper[i] must be at least the distance of q[i] to centroid a[i], lower[i, c] at most
    that to centroid c. Returns how many distances were calculated.
    """
    k = len(centroids)
    half = np.stack([0.5 * (1 - SLACK) * _roots(squared(centroids, c)) for c in centroids])
    apart = np.where(np.eye(k, dtype=bool), np.inf, half).min(1)
    active = np.flatnonzero(~(upper < apart[a]))
    tight, best, n = np.zeros(len(q), bool), np.zeros(len(q), np.int64), 0

    def open_to(c: int, rows: np.ndarray) -> np.ndarray:
        u = upper[rows]
        return rows[(a[rows] != c) & ~(u < lower[rows, c]) & ~(u < half[a[rows], c])]

    for c in range(k):
        rows = open_to(c, active)
        loose = rows[~tight[rows]]
        if len(loose):
            own = a[loose]
            best[loose] = squared(q[loose], centroids[own])
            root = _roots(best[loose])
            upper[loose], lower[loose, own] = root * (1 + SLACK), root * (1 - SLACK)
            tight[loose] = True
            n += len(loose)
            rows = open_to(c, rows)
        if len(rows):
            d = squared(q[rows], centroids[c])
            n += len(rows)
            root = _roots(d)
            lower[rows, c] = root * (1 - SLACK)
            wins = (d < best[rows]) | (d == best[rows]) & (c < a[rows])
            moved = rows[wins]
            a[moved], best[moved], upper[moved] = c, d[wins], root[wins] * (1 + SLACK)
    return n


def give_way(a: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, now: np.ndarray) -> None:
    """Widen bounds, in place, by how far the centroids have moved."""
    moved = _roots(squared(now, before)) * (1 + SLACK)
    upper += moved[a]
    upper *= 1 + SLACK
    lower -= moved
    np.maximum(lower, 0, out=lower)
    lower *= 1 - SLACK


def _round(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The rows of state under the centroids, and for each task and cluster a row with n and sums; before is None in the first round, which knows no bounds."""
    k, dimensions = centroids.shape
    names = ["key", "q", "cluster", "upper", "lower", "n", "sums"]

    def work(batches):
        counts, sums, kind = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64), None
        for batch in batches:
            kind = batch.column(0).type
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1), "<i4", dimensions)
            if before is None:
                a, upper, lower = np.zeros(len(q), np.int32), np.full(len(q), np.inf), np.zeros((len(q), k))
            else:
                a, upper, lower = np.array(batch.column(2)), np.array(batch.column(3)), _matrix(batch.column(4), "<f8", k).copy()
                give_way(a, upper, lower, before, centroids)
            nearest(q, a, upper, lower, centroids)
            for c in range(k):
                own = q[a == c]
                counts[c] += len(own)
                sums[c] += own.sum(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a), pa.array(upper), _binary(lower), pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.list_(pa.int64()))], names=names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.binary()), pa.array(np.arange(k, dtype=np.int32)), pa.nulls(k, pa.float64()), pa.nulls(k, pa.binary()), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=names)

    key = state.schema["key"].dataType.simpleString()
    return state.select(*[c for c in names[:5] if c in state.columns]).mapInArrow(work, f"key {key}, q binary, cluster int, upper double, lower binary, n long, sums array<long>")


def _means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact means, rounded down, of the clusters; a centroid without vectors stays."""
    parts = table.where("n > 0").select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    new = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect():
        new[r.cluster, r["at"]] = r.total // r.n
    return new


def first_centroids(vectors: DataFrame, clusters: int, dimensions: int, seed: int) -> np.ndarray:
    """The vectors with the least sha256("<seed>:<key>"), in this order; rows of one key by their components, those without a key last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = vectors.orderBy(F.asc_nulls_last(order), F.hex("q")).limit(clusters).select("q").collect()
    return np.array([np.frombuffer(r.q, "<i4") for r in rows], np.int64).reshape(len(rows), dimensions)


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row for each vector kept: key, cluster, distance (squared), cluster_inertia, inertia, centroid array<long>.

    Kept are vectors of just so many components, none null or non-finite; a component
    beyond LARGEST / scale is an error. Each row is a vector of its own: repeated rows
    and keys stay, also as first centroids, and a row without a key is clustered like
    others. With fewer vectors than clusters each begins as a centroid; a centroid
    without vectors stays where it is, and ties go to the smaller number. Other columns
    are not read; an empty table gives an empty table. Rounds end early when no centroid
    moves, as the others would change nothing.
    """
    if dimensions * (2 * LARGEST) ** 2 >= 1 << 63:
        raise ValueError(f"{dimensions} components are too many for exact distances in 64 bits")
    spark = df.sparkSession
    state = common.written(quantized(df, key, vector, dimensions, scale), "vectors")
    centroids, before = first_centroids(state, clusters, dimensions, seed), None
    if not len(centroids):
        kind = state.schema["key"].dataType.simpleString()
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        table = common.written(_round(state, centroids, before), "clusters")
        common.discard(state)
        state, before = table, centroids
        state_rows = table.where("n is null")
        state_rows._written_to = table._written_to
        state, centroids = state_rows, _means(table, centroids)
        if (centroids == before).all():
            break
    found = common.written(_distances(state, centroids, before), "distances")
    common.discard(state)
    inertia = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [(c, inertia[c], sum(inertia.values()), centroids[c].tolist()) for c in sorted(inertia)]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(totals), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _distances(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """(key, cluster, distance): the last assignment, with the exact distance to its centroid."""
    k, dimensions = centroids.shape

    def work(batch: pa.RecordBatch):
        q = _matrix(batch.column(1), "<i4", dimensions)
        if before is None:
            a, upper, lower = np.zeros(len(q), np.int32), np.full(len(q), np.inf), np.zeros((len(q), k))
        else:
            a, upper, lower = np.array(batch.column(2)), np.array(batch.column(3)), _matrix(batch.column(4), "<f8", k).copy()
            give_way(a, upper, lower, before, centroids)
        nearest(q, a, upper, lower, centroids)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(squared(q, centroids[a]))], names=["key", "cluster", "distance"])

    kept = state.select(*[c for c in ("key", "q", "cluster", "upper", "lower") if c in state.columns])
    return kept.mapInArrow(common.batched(work), f"key {state.schema['key'].dataType.simpleString()}, cluster int, distance long")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector, of eight after ten rounds."""
    found = cluster(common.read(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql() -> str:
    distance = "list_sum(list_transform(list_zip(q, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} as materialized (select rid, vec_id, q, min_by(c, (d, c)) c, min(d) d from (select rid, vec_id, q, c, {distance} d from v, c{i}) group by all)")
        if i < ROUNDS:
            steps.append(f"s{i} as (select c, j, sum(q[j]) s, count(*) n from a{i}, (select unnest(range(1, {DIMENSIONS + 1})) j) group by all)")
            means = "list(cast((s - ((s % n) + n) % n) // n as bigint) order by j)"
            steps.append(f"c{i + 1} as materialized (select o.c, coalesce(x.m, o.m) m from c{i} o left join (select c, {means} m from s{i} group by c) x on o.c = x.c)")
    last = f"a{ROUNDS}"
    return f"""with w as (
  select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings where len(embedding) = {DIMENSIONS}),
v as materialized (
  select rid, vec_id, list_transform(e, lambda x: cast(floor({SCALE} * x) as bigint)) q from w where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (
  select row_number() over (order by sha256('{SEED}:' || cast(vec_id as varchar)), q) - 1 c, q m from v order by sha256('{SEED}:' || cast(vec_id as varchar)), q limit {CLUSTERS}),
{", ".join(steps)}
select vec_id, cast(a.c as integer) as cluster, cast(d as bigint) distance, cast(sum(d) over (partition by a.c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia,
  sha256(array_to_string(m, ',')) centroid_sha256
from {last} a join c{ROUNDS} k on a.c = k.c"""


OP12_SQL = _sql()
