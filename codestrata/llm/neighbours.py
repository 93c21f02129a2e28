"""Approximate nearest neighbours by collision counting (query-aware hashing).

Each of ``PROJECTIONS`` Gaussian directions is a hash function of its own. A
query centres a window on its own projection in every one; a vector inside
collides with it there. Virtual rehashing widens the windows with the radius. A
vector within the radius collides with probability ``erf(WIDTH / sqrt(2))`` in
each projection, so one that collides in ``SHARE`` of them is verified by its
distance. A query ends when its ``k``-th best distance is within the radius.

A shard's projections are kept as cells of one byte, so that the collisions of
all its vectors with a query are counted by comparing bytes; windows are rounded
outwards, so no collision is lost. Distances are first taken from one matrix
product for a block of queries, and those that can be among the best are
computed anew from the vectors.

Queries are the rows whose id is divisible by ``QUERY_EVERY``; every row is
indexed. Rows are sorted by their first projection (and id, so that equal
vectors spread) and cut to shards. A query is searched in its own shard first,
which bounds its ``k``-th distance. Then it goes to the other shards whose range
in each of the first ``RANGES`` projections it can reach within that bound, in
blocks of about ``QUERY_BLOCK`` queries: each block meets each shard in one task,
where the shard's arrays are built once. Vectors move once for each block of
queries, queries only to shards they can reach.

Defined results: ``k`` rows for each query, or as many as there are other
vectors; ties go to the lower neighbour id. A row is never its own neighbour,
but repeated rows are each other's at distance 0. Rows whose vector is null,
empty, not finite or of another length than the most frequent (the longer on
ties) take no part, and an empty table gives no row. A row with a null
``vec_id`` is indexed, reported as null and sorted first; it is a query only
where all rows are. Only ``vec_id`` and ``embedding`` are read, so other columns
may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

K = 10
PROJECTIONS = 64
#: Half width of a window at radius 1, share of the projections in which a candidate collides, and growth of the radius.
WIDTH, SHARE, GROWTH = 1.0, 0.55, 1.3
#: First radius as a share of the root mean square distance of two vectors of a shard.
FIRST = 0.2
SHARD = 4096
#: Cells of a projection's range in a shard; a window's ends are rounded to whole cells, outwards.
CELLS = 253
#: Ids of the queries, projections in which a query must reach a shard's range, and queries of a block.
QUERY_EVERY, RANGES, QUERY_BLOCK = 50, 8, 65_536
SEED = 7

SHARDS = "shard bigint, ids array<bigint>, vectors binary, low array<double>, high array<double>"
OWN = "query bigint, vec_id bigint, shard bigint, vector binary, reach double, projected array<double>, found array<struct<neighbor: bigint, neighbor_id: bigint, distance: double>>"
PAIRS = "query bigint, vec_id bigint, neighbor bigint, neighbor_id bigint, distance double"
SHAPE = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("neighbor", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.float64())])


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


class Index:
    """The projections of one shard, as cells of a grid that is so fine that a window is a run of them."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)
        self.projected = self.vectors @ directions(vectors.shape[1])
        self.low = self.projected.min(0)
        step = (self.projected.max(0) - self.low) / CELLS
        self.step = np.where(step > 0, step, 1.0)
        self.cells = np.ascontiguousarray(self.cell(self.projected).T)
        self.middle = self.vectors.mean(0)
        self.centred = self.vectors - self.middle
        self.squares = (self.centred**2).sum(1)
        spread = np.sqrt(2 * self.vectors.var(0).sum())
        self.first = FIRST * spread if spread > 0 else 1.0

    def cell(self, projected: np.ndarray) -> np.ndarray:
        """From 1 on; 0 and 255 are outside."""
        return np.clip(np.floor((projected - self.low) / self.step) + 1, 0, 255).astype(np.uint8)

    def search(self, queries: np.ndarray, projected: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and distances of its best ``k`` within ``bound`` (its k-th best elsewhere).

        A query with a bound begins with windows of that radius, as wide as they
        can matter; any other begins with narrow ones.
        """
        need = int(np.ceil(SHARE * PROJECTIONS))
        moved = queries - self.middle
        own = (moved**2).sum(1)
        slack = 1e-9 * (own + self.squares.max(initial=0.0))
        rough = self.squares - 2 * (moved @ self.centred.T) + own[:, None]
        gap, inside = np.empty_like(self.cells), np.empty(self.cells.shape, bool)
        out = []
        for q, (near, kth) in enumerate(zip(rough, bound.tolist())):
            radius = kth if np.isfinite(kth) else self.first
            while True:
                # no window needs to be wider than the k-th best distance
                r = min(radius, kth)
                left, right = self.cell(projected[q] - WIDTH * r), self.cell(projected[q] + WIDTH * r)
                np.subtract(self.cells, left[:, None], out=gap)
                np.less_equal(gap, (right - left)[:, None], out=inside)
                counts = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
                found = np.flatnonzero((counts >= need) & (near <= kth * kth + slack[q]))
                if len(found) > k:
                    found = found[near[found] <= np.partition(near[found], k - 1)[k - 1] + 2 * slack[q]]
                distances = np.sqrt(((self.vectors[found] - queries[q]) ** 2).sum(1))
                top = np.lexsort((found, distances))
                cut = min(kth, distances[top[min(k, len(top)) - 1]]) if len(top) else 0.0
                top = top[distances[top] <= cut]  # with ties at the end, as ids decide later
                if len(top) >= k:
                    kth = min(kth, cut)
                if r >= kth or ((left <= 1) & (right >= CELLS + 1)).all():
                    break
                radius *= GROWTH
            out.append((found[top], distances[top]))
        return out


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id`` and ``v`` of the rows that take part, and their length."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    whole = rows.where("size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    top = whole.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = top.dim if top else 0
    return whole.where(F.size("v") == dim), dim


def shards_of(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """The vectors in shards of at most ``size`` neighbours along the first projection, with the range of each projection; saved."""
    axis = F.array(*(F.lit(float(x)) for x in directions(dim)[:, 0])) if dim else F.array().cast("array<double>")
    place = F.aggregate(F.zip_with("v", axis, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    ordered = rows.withColumn("place", place).repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "ids", "vectors", "low", "high"]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        ids: list = []
        held: list[np.ndarray] = []
        made = 0

        def row(n: int) -> pa.RecordBatch:
            nonlocal made, ids, held
            matrix = np.concatenate(held).reshape(-1, dim)
            own = matrix[:n].astype("<f4")
            projected = own.astype(np.float64) @ directions(dim)
            out = ((TaskContext.get().partitionId() << 20) + made, ids[:n], own.tobytes(), projected.min(0)[:RANGES], projected.max(0)[:RANGES])
            made, ids, held = made + 1, ids[n:], [matrix[n:].reshape(-1)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds)], names=names)

        for batch in batches:
            ids += batch.column(0).to_pylist()
            held.append(batch.column(1).flatten().to_numpy())
            while len(ids) >= size:
                yield row(size)
        if ids:
            yield row(len(ids))

    return save(ordered.select("vec_id", "v").mapInArrow(kernel, SHARDS), "shards")


def uid(shard: int, places: np.ndarray) -> np.ndarray:
    """A row's number: 31 bits of partition, 20 of the shard in it, 12 of the place are enough for any table."""
    return (shard << 12) + places


def search_own(index: Index, which: np.ndarray, k: int) -> list:
    """A shard's vectors ``which`` searched in the shard itself, without each finding itself."""
    best = index.search(index.vectors[which], index.projected[which], np.full(len(which), np.inf), k + 1)
    return [(places[places != q], distances[places != q]) for q, (places, distances) in zip(which.tolist(), best)]


def first_results(shards: DataFrame, dim: int, k: int, every: int) -> DataFrame:
    """Each query with its neighbours in its own shard and the distance within which others can still matter; saved."""
    shape = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("shard", pa.int64()), ("vector", pa.binary()), ("reach", pa.float64()), ("projected", pa.list_(pa.float64())), ("found", pa.list_(pa.struct([("neighbor", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.float64())])))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids, vectors in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                ids, own = ids.as_py(), np.frombuffer(vectors.as_buffer(), "<f4").reshape(-1, dim)
                queries = np.array([i for i, x in enumerate(ids) if every == 1 or x is not None and x % every == 0], np.int64)
                index = Index(own) if len(queries) else None
                for at in range(0, len(queries), 512):
                    which = queries[at : at + 512]
                    out = []
                    for q, (places, distances) in zip(which.tolist(), search_own(index, which, k)):
                        reach = np.sort(distances)[k - 1] if len(distances) >= k else np.inf
                        found = [(n, ids[p], d) for n, p, d in zip(uid(shard, places).tolist(), places.tolist(), distances.tolist())]
                        out.append((int(uid(shard, q)), ids[q], shard, own[q].tobytes(), reach, index.projected[q, :RANGES].tolist(), [dict(zip(("neighbor", "neighbor_id", "distance"), x)) for x in found]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    return save(shards.select("shard", "ids", "vectors").repartition("shard").mapInArrow(kernel, OWN), "own")


def nearest(embeddings: DataFrame, k: int = K, shard: int = SHARD, every: int = 1, block: int = QUERY_BLOCK) -> DataFrame:
    """``vec_id``, ``neighbor_id``, ``rank`` from 1 and ``distance`` of the ``k`` nearest others of every row whose id is divisible by ``every``."""
    if not 0 < shard <= 1 << 12:
        raise ValueError("a shard holds 1 to 4096 vectors")
    rows, dim = usable(embeddings)
    shards = shards_of(rows, dim, shard)
    own = first_results(shards, dim, k, every)
    blocks = max(1, -(-own.count() // block))
    axes = directions(dim)
    norms = np.linalg.norm(axes, axis=0)

    # queries with the shards that they can reach; vectors once for each block of queries
    q, s = own.select("query", "vec_id", F.col("shard").alias("home"), "vector", "reach", "projected"), shards.select("shard", "low", "high")
    near = F.col("home") != F.col("shard")
    for i in range(RANGES):
        slack = F.col("reach") * F.lit(float(norms[i]) * (1 + 1e-6)) + F.lit(1e-9)
        near &= (F.get("projected", F.lit(i)) + slack >= F.get("low", F.lit(i))) & (F.get("projected", F.lit(i)) - slack <= F.get("high", F.lit(i)))
    sent = q.join(s, near).select(F.col("shard").alias("to"), F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"), "query", "vec_id", "vector", "reach")
    copies = shards.select(F.col("shard").alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), "ids", "vectors")

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return SHAPE.empty_table()
        ids, number = vectors.column("ids")[0].as_py(), vectors.column("own")[0].as_py()
        index = Index(np.frombuffer(vectors.column("vectors")[0].as_buffer(), "<f4").reshape(-1, dim))
        points = np.frombuffer(b"".join(queries.column("vector").to_pylist()), "<f4").reshape(-1, dim).astype(np.float64)
        bounds, names, owners = (queries.column(c).to_pylist() for c in ("reach", "query", "vec_id"))
        bounds, projected, out = np.array(bounds), points @ axes, [[], [], [], [], []]
        for at in range(0, len(points), 512):
            cut = slice(at, at + 512)
            for i, (places, distances) in enumerate(index.search(points[cut], projected[cut], bounds[cut], k), at):
                for column, values in zip(out, ([names[i]] * len(places), [owners[i]] * len(places), uid(number, places).tolist(), [ids[p] for p in places.tolist()], distances.tolist())):
                    column.extend(values)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, SHAPE)], schema=SHAPE)

    rest = sent.groupBy("to", "block").cogroup(copies.groupBy("own", "block")).applyInArrow(search, PAIRS)
    home = own.select("query", "vec_id", F.explode("found").alias("f")).select("query", "vec_id", "f.neighbor", "f.neighbor_id", "f.distance")
    order = Window.partitionBy("query").orderBy("distance", F.col("neighbor_id").asc_nulls_first(), "neighbor")
    ranked = home.unionAll(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("vec_id", "neighbor_id", "rank", "distance")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=QUERY_EVERY)
