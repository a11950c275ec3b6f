"""Embedding near-duplicates: an exact metric range join.

On unit vectors, cosine >= t means a Euclidean distance of at most r = sqrt(2 - 2t). Equal
vectors of a label are one point with a multiplicity. A point's code is its projection on
a few orthonormal directions, rounded to bytes; projecting shortens distances and rounding
adds a known bound, so points within r have codes within a known reach.

1. Codes are joined by that reach. Pivots from a bounded sample divide the codes of each
   large label into cells by the nearest pivot. A code goes to a later cell j as well,
   unless the geometry excludes a neighbour there: by the triangle inequality if it is
   further than the cell's radius plus the reach from pivot j, and because a code within
   reach that lies nearer to j requires the border between the two pivots within reach.
   Each pair that can be close thus meets in a cell, and cells join independently, large
   ones in tiles of two blocks.
2. Points whose codes are connected are a family, and only these send their vectors: a
   family is compared in full, over TILE points in tiles of two blocks, so no task holds a
   whole crowded family and no pair leaves a tile. A tile yields, for each point, how many
   vectors it links with and the least point of its part of the tile.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Points that pivots are drawn from at most, over all labels by their sizes; a label gets a
#: pivot for each CELL of its points, as far as the sample goes.
SAMPLE, CELL = 4096, 65536
#: A cell of more codes than two CELL, or a family of more points than TILE, goes in tiles.
TILE = 4096
#: Directions of a code at most, and steps of a byte to the unit.
DIRECTIONS, STEPS = 24, 127
#: Cosines, or distances of codes, held at once.
HELD = 1 << 21

_directions: dict[int, np.ndarray] = {}


def directions(size: int) -> np.ndarray:
    """Orthonormal directions, as columns, that vectors of this size are projected on."""
    if size not in _directions:
        _directions[size] = np.linalg.qr(np.random.default_rng(size).normal(size=(size, min(size, DIRECTIONS))))[0]
    return _directions[size]


def reach_of(threshold: float, width: int) -> float:
    """How far apart codes of so many directions are at most, if the cosine reaches the threshold: each is rounded by half a step a direction."""
    return STEPS * float(np.sqrt(max(0.0, 2 - 2 * threshold))) + float(np.sqrt(width)) + 1e-3


def _scaled(column: pa.Array, skip: np.ndarray) -> list[np.ndarray | None]:
    """Each vector, in doubles, over its largest component; None where it is skipped or links with nothing."""
    ends = np.asarray(column.offsets)
    flat = np.asarray(column.values.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    bad = np.asarray(column.is_null()) | skip
    out = []
    for k in range(len(column)):
        v = flat[ends[k] : ends[k + 1]]
        fine = not bad[k] and len(v) and np.isfinite(v).all() and v.any()
        out.append(v / np.abs(v).max() + 0.0 if fine else None)
    return out


def units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def coded(rows: DataFrame) -> DataFrame:
    """(id, label, size, mark, code) of rows of id, label and v: mark tells vectors apart; it and the code are null where the vector links with nothing."""

    def work(batch: pa.RecordBatch):
        vectors = _scaled(batch.column(2), np.asarray(batch.column(1).is_null()))
        sizes = np.array([0 if v is None else len(v) for v in vectors], np.int32)
        codes: list[bytes | None] = [None] * len(vectors)
        for size in set(sizes[sizes > 0].tolist()):
            at = np.flatnonzero(sizes == size)
            q = np.rint(STEPS * (units(np.stack([vectors[k] for k in at])) @ directions(size))).astype(np.int8)
            for k, code in zip(at.tolist(), q, strict=True):
                codes[k] = code.tobytes()
        marks = [None if v is None else hashlib.md5(v.tobytes()).digest() for v in vectors]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(marks, pa.binary()), pa.array(codes, pa.binary())], names=["id", "label", "size", "mark", "code"])

    return rows.mapInArrow(common.batched(work), f"id long, label {rows.schema['label'].dataType.simpleString()}, size int, mark binary, code binary")


def codes_of(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int8).reshape(len(blobs), -1).astype(np.float64)


def draw_pivots(points: DataFrame) -> dict[tuple, np.ndarray]:
    """Pivots by (label, size of a vector), for labels of more than CELL points."""
    counts = {(r.label, r.size): r.n for r in points.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).orderBy(F.desc("n")).limit(1000).collect()}
    total = sum(counts.values())
    if not total:
        return {}
    rate = min(1.0, SAMPLE / total)
    drawn = points.where((F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1) & F.col("label").isin([k[0] for k in counts])).limit(2 * SAMPLE)
    found: dict[tuple, list[bytes]] = {}
    for r in sorted(drawn.select("label", "size", "rep", "code").collect(), key=lambda r: r.rep):
        found.setdefault((r.label, r["size"]), []).append(bytes(r.code))
    return {k: codes_of(found[k][: -(-n // CELL)]) for k, n in counts.items() if k in found}


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))


def _cells(points: DataFrame, pivots: dict, threshold: float, radii: dict | None) -> DataFrame:
    """points with cell and distance; with radii given, also once for each later cell it may have neighbours in."""
    shared = points.sparkSession.sparkContext.broadcast((pivots, radii))

    def work(batch: pa.RecordBatch):
        pivots, radii = shared.value
        labels, sizes, codes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("label", "size", "code"))
        groups: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(labels, sizes, strict=True)):
            groups.setdefault(key, []).append(k)
        rows, cells, distances = [], [], []
        for key, own in groups.items():
            own = np.array(own)
            p = pivots.get(key)
            if p is None:
                found = [(own, np.zeros(len(own), np.int32), np.zeros(len(own)))]
            else:
                r = reach_of(threshold, p.shape[1])
                d = _apart(codes_of([codes[k] for k in own]), p)
                home = d.argmin(1)
                near = d[np.arange(len(own)), home]
                found = [(own, home, near)]
                if radii is not None:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        border = (d * d - (near * near)[:, None]) / (2 * _apart(p, p)[home])
                    radius = np.array([radii.get((*key, j), -1.0) for j in range(len(p))])
                    may = (np.arange(len(p)) > home[:, None]) & (radius >= 0) & (d <= radius + r + 1e-6) & ~(border > r + 1e-6)
                    at, j = np.nonzero(may)
                    found.append((own[at], j, d[at, j]))
            for some, to in zip((rows, cells, distances), zip(*found, strict=True), strict=True):
                some.extend(to)
        rows, cells, distances = (np.concatenate(x) for x in (rows, cells, distances))
        taken = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells.astype(np.int32)), pa.array(distances)], names=[*batch.schema.names, "cell", "distance"])

    return points.mapInArrow(common.batched(work), common.schema_of(points, "cell int, distance double"))


def _tiled(rows: DataFrame, of: list[str], n_parts: int) -> DataFrame:
    """rows, which have blocks and tag, once for each tile of their block: own, the tile's blocks i and j, its number and part."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("tag"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("tile", F.xxhash64(*of, "i", "j"))
    return rows.withColumn("two", F.col("i") < F.col("j")).withColumn("part", F.pmod("tile", F.lit(n_parts)))


def _blocks(n: str, whole: int) -> F.Column:
    return F.when(F.col(n) <= whole, F.lit(1)).otherwise(F.ceil(F.col(n) / (whole / 2))).cast("int")


def _of_tiles(table: pa.Table):
    """The rows of each tile with more than one."""
    tile = table.column("tile").to_numpy()
    order = np.argsort(tile, kind="stable")
    cuts = np.flatnonzero(np.r_[True, tile[order][1:] != tile[order][:-1]]).tolist()
    for b, e in zip(cuts, [*cuts[1:], len(order)], strict=True):
        if e - b > 1:
            yield order[b:e]


def merged(least: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """least, the place of the least point of each point's class, once the points x and y are of one class."""
    x, y, root = least[x], least[y], np.arange(len(least))
    while True:
        a, b = root[x], root[y]
        more = a != b
        if not more.any():
            return root[least]
        x, y = x[more], y[more]
        np.minimum.at(root, np.maximum(a, b)[more], np.minimum(a, b)[more])
        while (root[root] != root).any():
            root = root[root]


def _sides(block: np.ndarray, two: bool):
    """Rows and columns of a tile to compare, in bounded pieces: its two blocks with each other, or all with those from themselves on."""
    rows, columns = (np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())) if two else (np.arange(len(block)),) * 2
    b = 0
    while b < len(rows) and len(columns):
        to = columns if two else columns[b:]
        e = b + max(16, HELD // len(to))
        yield rows[b:e], to
        b = e


def near_codes(codes: np.ndarray, block: np.ndarray, two: bool, reach: float) -> np.ndarray:
    """For each code of a tile, the place of the least that is connected with it by codes within reach."""
    q = codes.astype(np.float32)
    half = (q * q).sum(1) / 2
    # q x - x x / 2 >= q q / 2 - reach ** 2 / 2; whole and half numbers below 2 ** 24, so exact
    left, right = np.c_[q, -np.ones(len(q), np.float32)], np.c_[q, half]
    least = np.arange(len(q))
    for rows, columns in _sides(block, two):
        x, y = np.nonzero(left[rows] @ right[columns].T >= (half[rows] - np.float32(reach * reach / 2 + 0.5))[:, None])
        x, y = rows[x], columns[y]
        apart = least[x] != least[y]
        least = merged(least, x[apart], y[apart])
    return least


def link_tile(weight: np.ndarray, block: np.ndarray, two: bool, v: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point of a tile: the vectors it links with, and the place of the least point linked over any number of links.

    Points of two blocks are compared across, of one among themselves.
    """
    links, least = np.zeros(len(v), np.int64), np.arange(len(v))
    for rows, columns in _sides(block, two):
        s = v[rows] @ v[columns].T
        x, y = np.nonzero(s >= threshold - 1e-12)
        close = np.flatnonzero(np.abs(s[x, y] - threshold) < 1e-12)
        x, y = rows[x], columns[y]
        keep = x < y if not two else np.ones(len(x), bool)
        keep[close] &= np.array([np.dot(v[x[k]], v[y[k]]) >= threshold for k in close], bool)
        x, y = x[keep], y[keep]
        links += (np.bincount(x, weight[y], len(v)) + np.bincount(y, weight[x], len(v))).astype(np.int64)
        least = merged(least, x, y)
    return links, least


def join(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row for each row of df with a key: key, n_links, component_id, kept.

    Vectors are compared when labels are equal and not null and lengths equal, by cosine
    in double precision; one that is null, empty, zero or holds a null or a non-finite
    component links with nothing. Each row is a vector of its own: rows of one key don't
    link by their key, and each has the component of its own vector. Keys are whole
    numbers, cast to long; rows with a null key are left out; other columns are not read.
    df is read twice, the second time for the vectors of families alone.
    """
    spark = df.sparkSession
    n_parts = 8 * common.shuffle_partitions(spark)
    df = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = common.written(coded(df), "vectors")
    points = rows.where("mark is not null").groupBy("label", "size", "mark", "code").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    # a key can have several vectors, so a point is known by its least key and a hash of what it is
    points = common.written(points.withColumn("tag", F.xxhash64("label", "mark")), "points")
    families = common.components(_near(points, threshold, n_parts), "a", "b", "families")
    families = families.select(F.col("node").alias("tag"), "component_id").join(points.select("tag", "rep", "weight", "label", "size"), "tag")
    # label and size are part of a family's name, as two points could share a tag
    families = common.written(families.select("rep", "tag", "weight", F.xxhash64("component_id", "label", "size").alias("family")), "families")
    wanted = families.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("family", _blocks("n", TILE).alias("blocks"))
    wanted = common.written(families.join(wanted, "family"), "members")
    single = df.schema["v"].dataType.elementType.simpleString() == "float"

    def whole(batch: pa.RecordBatch):
        at = batch.schema.get_field_index
        column = batch.column(at("v"))
        vectors = _scaled(column, np.asarray(batch.column(at("label")).is_null()))
        keep = [k for k, v in enumerate(vectors) if v is not None]
        marks = pa.array([hashlib.md5(vectors[k].tobytes()).digest() for k in keep], pa.binary())
        ends, values = np.asarray(column.offsets), np.asarray(column.values.cast(pa.float64()).fill_null(np.nan))
        blobs = pa.array([values[ends[k] : ends[k + 1]].astype(np.float32 if single else np.float64).tobytes() for k in keep], pa.binary())
        names = ["label", "rep", "tag", "weight", "family", "blocks"]
        return pa.RecordBatch.from_arrays([*(batch.column(at(c)).take(pa.array(keep, pa.int64())) for c in names), marks, blobs], names=[*names, "mark", "vec"])

    held = df.join(common.small(wanted), F.col("id") == F.col("rep")).select("label", "v", "rep", "tag", "weight", "family", "blocks")
    kind = df.schema["label"].dataType.simpleString()
    held = held.mapInArrow(common.batched(whole), f"label {kind}, rep long, tag long, weight long, family long, blocks int, mark binary, vec binary")
    held = held.where(F.xxhash64("label", "mark") == F.col("tag")).select("rep", "tag", "weight", "family", "blocks", "vec")

    def link(table: pa.Table) -> pa.Table:
        rep, tag, weight, own, two = (np.asarray(table.column(c).to_numpy()) for c in ("rep", "tag", "weight", "own", "two"))
        vec = table.column("vec")
        out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        for at in _of_tiles(table):
            at = at[np.lexsort((tag[at], rep[at]))]
            # rows that repeat key and vector are one point
            at = at[np.r_[True, (rep[at][1:] != rep[at][:-1]) | (tag[at][1:] != tag[at][:-1])]]
            v = np.frombuffer(b"".join(vec[int(k)].as_py() for k in at), np.float32 if single else np.float64).reshape(len(at), -1).astype(np.float64)
            links, least = link_tile(weight[at], own[at], bool(two[at[0]]), units(v / np.abs(v).max(1)[:, None] + 0.0), threshold)
            hit = links > 0
            out.append((at[hit], links[hit], at[least[hit]]))
        at, links, least = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"rep": rep[at], "tag": tag[at], "links": links, "to_rep": rep[least], "to_tag": tag[least]})

    tiles = _tiled(held, ["family"], n_parts).select("part", "tile", "own", "two", "rep", "tag", "weight", "vec")
    found = common.written(tiles.groupBy("part").applyInArrow(link, "rep long, tag long, links long, to_rep long, to_tag long"), "links")
    counts = found.groupBy("rep", "tag").agg(F.sum("links").alias("links"))
    edges = found.select(F.struct("rep", "tag").alias("a"), F.struct(F.col("to_rep").alias("rep"), F.col("to_tag").alias("tag")).alias("b"))
    linked = common.components(edges, "a", "b", "linked").select("node.rep", "node.tag", F.col("component_id.rep").alias("least"))
    classes = points.select("label", "mark", "rep", "tag", "weight").join(counts, ["rep", "tag"], "left").join(linked, ["rep", "tag"], "left")
    classes = classes.select("label", "mark", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("least", "rep").alias("least"))
    joined = rows.select("id", "label", "mark").join(classes, ["label", "mark"], "left")
    component = F.coalesce("least", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _near(points: DataFrame, threshold: float, n_parts: int) -> DataFrame:
    """(a, b) tags that connect every pair of points whose codes are within reach."""
    pivots = draw_pivots(points)
    where = ["label", "size", "cell"]
    placed = points.select("label", "size", "rep", "tag", "code")
    radii = {(x.label, x["size"], x.cell): x.radius for x in _cells(placed, pivots, threshold, None).groupBy(*where).agg(F.max("distance").alias("radius")).where(F.col("label").isin([k[0] for k in pivots])).collect()} if pivots else {}
    placed = common.written(_cells(placed, pivots, threshold, radii).select(*where, "tag", "code"), "cells")
    blocks = placed.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).select(*where, _blocks("n", 2 * CELL).alias("blocks"))
    tiles = _tiled(placed.join(blocks, where), where, n_parts).select("part", "tile", "own", "two", "tag", "code")

    def meet(table: pa.Table) -> pa.Table:
        tag, own, two = (np.asarray(table.column(c).to_numpy()) for c in ("tag", "own", "two"))
        code = table.column("code")
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in _of_tiles(table):
            at = at[np.argsort(tag[at], kind="stable")]
            codes = codes_of(code.take(pa.array(at)).to_pylist())
            least = near_codes(codes, own[at], bool(two[at[0]]), reach_of(threshold, codes.shape[1]))
            more = np.flatnonzero(least != np.arange(len(at)))
            a.append(tag[at[more]])
            b.append(tag[at[least[more]]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return tiles.groupBy("part").applyInArrow(meet, "a long, b long")


def op1_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivor of every vector, at cosine 0.98 within a label."""
    return join(common.read(spark, sf_dir, "embeddings"))


OP1_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select vec_id, label, e, sqrt(list_inner_product(e, e)) l from v),
p as (
  select a.vec_id x, b.vec_id y from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.98),
c as (select x, y from p union select c.x, p.y from c join p on c.y = p.x),
m as (select x, min(y) y from c group by x),
k as (select x, count(*) n from p group by x)
select e.vec_id, cast(coalesce(k.n, 0) as bigint) n_links, least(e.vec_id, coalesce(m.y, e.vec_id)) component_id,
  e.vec_id = least(e.vec_id, coalesce(m.y, e.vec_id)) kept
from embeddings e left join k on e.vec_id = k.x left join m on e.vec_id = m.x where e.vec_id is not null
"""
