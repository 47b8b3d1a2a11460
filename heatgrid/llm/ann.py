"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

A vector is projected on K Gaussian directions, shifted and cut into steps of width W; the K step numbers name its
bucket, in each of several tables. The projections of a neighbour at distance r differ from the query's by N(0, r^2)
(p-stability), so the chance that it lies in a bucket is a product of K normal probabilities; a query visits buckets in
falling order of that chance. All rows of visited buckets are compared by their exact inner product.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2), where M is the largest norm among vectors of
about the same norm (a band, one factor of two wide; norms are kept as a number and a power of two, so that none over- or underflows); queries are scaled to M and visit the buckets of every band.

W, r and the number of probes are fitted on a bounded sample so that the sample's recall reaches `target`; every
row is indexed. Large buckets are split into blocks, each block is one unit of work, and per block and query only the
k best leave a task. A query that finds fewer than k rows is compared with all rows, in blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite values take no part, nor do vectors
of another length than the most common one; rows that share an id are one item with the best of their scores; equal
scores are ranked by id; a score that overflows is infinite (of either sign where its products overflow both ways); with fewer than k candidates all are returned; an empty table gives no rows. Only the id and
vector columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from heatgrid.llm.common import mix64, written

TABLES = 4
SAMPLE = 4096
BLOCK_ROWS = 20_000
MOST_HOT = 100_000  # buckets named to every task; beyond it blocks grow instead


@dataclass
class Hashing:
    dim: int
    bands: list[tuple[int, float]]  # band number and its largest norm, in units of 2^band
    directions: np.ndarray  # (dim + 1, tables x K)
    shifts: np.ndarray
    width: float
    radius: float
    probes: int
    k: int

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, K) in units of the width."""
        return ((x @ self.directions + self.shifts) / self.width).reshape(len(x), TABLES, self.k)


def bands_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band, norm / 2^band) of each row. Rows are scaled by a power of two near their largest component before they are
    squared, so no finite norm is lost to overflow or underflow; the scaled norm lies between 2^-0.5 and 2^0.5."""
    scale = np.frexp(np.abs(x).max(axis=1))[1].astype(np.int64)
    norm = np.linalg.norm(scaled(x, scale), axis=1)
    more = np.rint(np.log2(norm)).astype(np.int64)
    return scale + more, np.ldexp(norm, -more)


def scaled(x: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Rows times 2^-band; in two steps, as 2^-band itself may be beyond the range of doubles."""
    half = band >> 1
    return np.ldexp(np.ldexp(x, -half[:, None]), -(band - half)[:, None])


def lifted(x: np.ndarray, norm: np.ndarray, band: np.ndarray, to: int, most: float) -> np.ndarray:
    """Rows in units of the largest norm, `most` * 2^to, with the coordinate that makes them unit vectors."""
    y = scaled(x, np.full(len(x), to)) / most
    length = np.ldexp(norm, np.maximum(band - to, -2000)) / most
    return np.concatenate([y, np.sqrt(np.maximum(0.0, 1.0 - length**2))[:, None]], axis=1)


def bucket_keys(cells: np.ndarray, table: int, band: int) -> np.ndarray:
    """One 64-bit key for each row of step numbers."""
    key = np.full(len(cells), (table * 0x9E3779B97F4A7C15 + (band & 0xFFFF) * 0xC2B2AE3D27D4EB4F) % (1 << 64), np.uint64)
    for j in range(cells.shape[1]):
        key = mix64(key * np.uint64(0xD1342543DE82EF95) + cells[:, j].astype(np.int64).view(np.uint64))
    return key.view(np.int64)


_erf = np.vectorize(math.erf, otypes=[float])


def probe_cells(projected: np.ndarray, width: float, radius: float, probes: int, reach: int = 3) -> np.ndarray:
    """The `probes` likeliest rows of step numbers for one query's K projections, likeliest first.

    Every coordinate's steps are sorted by chance; a heap then yields combinations in order of their product.
    """
    k = len(projected)
    home = np.floor(projected).astype(np.int64)
    moves = np.arange(-reach, reach + 1)
    edge = (moves[None, :] - (projected - home)[:, None]) * (width / (radius * math.sqrt(2)))
    chance = 0.5 * (_erf(edge + width / (radius * math.sqrt(2))) - _erf(edge))
    cost = -np.log(np.maximum(chance, 1e-300))
    by = np.argsort(cost, axis=1, kind="stable")
    cost = np.take_along_axis(cost, by, 1)
    step = moves[by]
    extra = (cost - cost[:, :1]).tolist()
    order = sorted(range(k), key=lambda c: extra[c][1])
    out = np.empty((probes, k), np.int64)
    out[:] = home + step[:, 0]
    found, heap = 0, [(0.0, ())]
    while heap and found < probes:
        total, chosen = heapq.heappop(heap)
        for place, level in chosen:
            c = order[place]
            out[found, c] = home[c] + step[c, level]
        found += 1
        if chosen:
            place, level = chosen[-1]
            c = order[place]
            if level < 2 * reach:
                heapq.heappush(heap, (total - extra[c][level] + extra[c][level + 1], (*chosen[:-1], (place, level + 1))))
            if place + 1 < k:
                following = extra[order[place + 1]][1]
                heapq.heappush(heap, (total + following, (*chosen, (place + 1, 1))))
                if level == 1:
                    heapq.heappush(heap, (total - extra[c][1] + following, (*chosen[:-1], (place + 1, 1))))
        else:
            heapq.heappush(heap, (extra[order[0]][1], ((0, 1),)))
    return out[:found]


def valid_vectors(df: DataFrame, id_col: str, vector: str, asks: str) -> DataFrame:
    """(id, v, asks, band, norm) of the rows that take part; the norm is in units of 2^band."""
    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & usable).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.col(asks).alias("asks"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                band, norm = bands_of(_matrix(part.column(1), size))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(band), pa.array(norm)], ["id", "v", "asks", "band", "norm"])

    return rows.mapInArrow(measure, "id bigint, v array<double>, asks boolean, band bigint, norm double")


def fit_hashing(vectors: DataFrame, k: int, target: float = 0.95, sample: int = SAMPLE, most_probes: int = 256, seed: int = 11) -> tuple[Hashing | None, int]:
    """Hashing for (id, v, band, norm) rows and their number. Counts and largest norms come from all rows, width and probes from the
    `sample` rows with the smallest hash: in it, the k * sample / rows nearest of 256 rows must be found."""
    sized = vectors.select("id", "v", F.size("v").alias("dim"), "band", "norm")
    stats = sized.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).collect()
    if not stats:
        return None, 0
    by_dim: dict[int, int] = {}
    for row in stats:
        by_dim[row["dim"]] = by_dim.get(row["dim"], 0) + row["n"]
    dim = max(by_dim, key=lambda d: (by_dim[d], d))
    n = by_dim[dim]
    bands = sorted((int(r["band"]), float(r["most"])) for r in stats if r["dim"] == dim)
    drawn = sized.where(F.col("dim") == dim).select(F.xxhash64(F.lit(seed), "id").alias("h"), "v").orderBy("h").limit(sample).collect()
    x = np.array([r["v"] for r in drawn], float)
    band, norms = bands_of(x)
    rng = np.random.default_rng(seed)
    dims = min(16, max(2, round(math.log2(n) / 2)))
    points = lifted(x, norms, band, *bands[-1])
    asked = np.arange(min(256, len(x)))
    queries = np.concatenate([scaled(x[asked], band[asked]) / norms[asked, None], np.zeros((len(asked), 1))], axis=1)
    near = max(1, min(len(x) - 1, round(k * len(x) / n))) if len(x) > 1 else 0
    scores = queries[:, :-1] @ points[:, :-1].T
    scores[asked, asked] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :near]
    apart = np.linalg.norm(queries[:, None, :] - points[best], axis=2) if near else np.ones((1, 1))
    radius = float(np.sqrt((apart**2).mean())) or 1.0
    model = Hashing(dim, bands, rng.normal(size=(dim + 1, TABLES * dims)), rng.uniform(0, 1, TABLES * dims), 2.0 * radius, radius, 1, dims)
    unit = model.shifts
    while True:
        model.shifts = unit * model.width
        at, home = model.project(queries), np.floor(model.project(points)).astype(np.int64)
        rank = np.full((len(asked), near), most_probes)
        for i in range(len(asked)):
            for t in range(TABLES):
                cells = probe_cells(at[i, t], model.width, radius, most_probes)
                same = (cells[:, None, :] == home[best[i], t][None, :, :]).all(axis=2)
                rank[i] = np.minimum(rank[i], np.where(same.any(axis=0), same.argmax(axis=0), most_probes))
        recall = [float((rank < p).mean()) if near else 1.0 for p in range(1, most_probes + 1)]
        enough = [p for p, r in enumerate(recall, 1) if r >= target and p & (p - 1) == 0]
        if enough:
            model.probes = enough[0]
            return model, n
        model.width *= 1.2


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search_block(probes: pa.Table, rows: pa.Table, dim: int, k: int) -> pa.Table:
    """The k best rows of each query among the buckets it visits in this block; ties go to the smaller id."""
    names = ["query_id", "id", "score"]
    cells = rows.column("cell").to_numpy()
    order = np.argsort(cells, kind="stable")
    cells, ids, v = cells[order], rows.column("id").to_numpy()[order], _matrix(rows.column("v"), dim)[order]
    query_ids, q = probes.column("query_id").to_numpy(), _matrix(probes.column("v"), dim)
    lists = probes.column("cells").combine_chunks()
    visits = np.repeat(np.arange(len(query_ids)), np.diff(lists.offsets.to_numpy()))
    wanted = lists.flatten().to_numpy()
    out: list[pa.Table] = []
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(cells) != 0)), len(cells))
    for low in range(0, len(query_ids), 512):  # a bounded number of queries at a time
        mine = (visits >= low) & (visits < low + 512)
        by = np.argsort(wanted[mine], kind="stable")
        cell_of, query_of = wanted[mine][by], visits[mine][by]
        a, b = np.searchsorted(cell_of, cells[bounds[:-1]], "left"), np.searchsorted(cell_of, cells[bounds[:-1]], "right")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for c in np.flatnonzero(b > a).tolist():
            asking, at, end = query_of[a[c]: b[c]], bounds[c], bounds[c + 1]
            with np.errstate(over="ignore", invalid="ignore"):
                score = q[asking] @ v[at:end].T
            score[np.isnan(score)] = -np.inf  # infinite products of both signs
            own = query_ids[asking][:, None] == ids[at:end][None, :]
            score[own] = -np.inf
            if end - at > k:
                edge = np.partition(score, end - at - k, axis=1)[:, end - at - k]
                i, j = np.nonzero((score >= edge[:, None]) & ~own)
            else:
                i, j = np.nonzero(~own)
            found.append((asking[i], ids[at + j], score[i, j]))
        if found:
            who, what, score = (np.concatenate(x) for x in zip(*found))
            by = np.lexsort((what, -score, who))
            who, what, score = who[by], what[by], score[by]
            first = np.flatnonzero(np.append(True, np.diff(who) != 0))
            place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            keep = place < k
            out.append(pa.table([query_ids[who[keep]], what[keep], score[keep]], names=names))
    empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    return pa.concat_tables(out) if out else empty


FOUND = "query_id bigint, id bigint, score double"


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", target: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for every row that `is_query` selects, its k nearest found among all other rows."""
    spark = df.sparkSession
    vectors = written(valid_vectors(df.withColumn("_asks", F.coalesce(is_query, F.lit(False))), id_col, vector, "_asks"))
    model, n = fit_hashing(vectors, k, target)
    empty = spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    if model is None:
        return empty
    vectors = vectors.where(F.size("v") == model.dim)
    dim = model.dim
    shared = spark.sparkContext.broadcast(model)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            band, norm = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for number, most in m.bands:
                rows = np.flatnonzero(band == number)
                if not len(rows):
                    continue
                cells = np.floor(m.project(lifted(x[rows], norm[rows], band[rows], number, most))).astype(np.int64)
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(cells[:, t], t, number)), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], ["cell", "id", "v"])

    indexed = vectors.select("id", "v", "band", "norm").mapInArrow(index, "cell bigint, id bigint, v array<double>")
    sizes = indexed.groupBy("cell").count()
    limit = block_rows
    while (hot_rows := sizes.where(F.col("count") > limit).limit(MOST_HOT + 1).collect()) and len(hot_rows) > MOST_HOT:
        limit *= 2
    hot = spark.sparkContext.broadcast({int(r["cell"]): -(-int(r["count"]) // limit) for r in hot_rows})
    parts = max(1, -(-n * TABLES // block_rows))

    def deal(cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (mix64(cell.view(np.uint64) + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in index(batches):
            cell, salt = batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int64)
            if hot.value:
                split = np.array([hot.value.get(c, 1) for c in cell.tolist()])
                salt = (mix64(batch.column(1).to_numpy().view(np.uint64)) % split.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(deal(cell, salt)), *batch.columns], ["part", "cell", "id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            unit = np.concatenate([scaled(x, batch.column(2).to_numpy()) / batch.column(3).to_numpy()[:, None], np.zeros((len(x), 1))], axis=1)
            projected = m.project(unit)
            part, row, lists = [], [], []
            for i in range(len(x)):
                keys = [bucket_keys(cells, t, number) for t in range(TABLES) for cells in (probe_cells(projected[i, t], m.width, m.radius, m.probes),) for number, _ in m.bands]
                cell = np.concatenate(keys)
                split = np.array([hot.value.get(c, 1) for c in cell.tolist()]) if hot.value else np.ones(len(cell), np.int64)
                salt = np.arange(int(split.sum())) - np.repeat(np.cumsum(split) - split, split)
                cell = np.repeat(cell, split)
                to = deal(cell, salt)
                by = np.argsort(to, kind="stable")
                for group in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
                    part.append(int(to[group[0]]))
                    row.append(i)
                    lists.append(np.unique(cell[group]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(lists, pa.list_(pa.int64()))],
                ["part", "query_id", "v", "cells"],
            )

    placed = vectors.select("id", "v", "band", "norm").mapInArrow(place, "part int, cell bigint, id bigint, v array<double>")
    asked = vectors.where("asks").select("id", "v", "band", "norm").mapInArrow(ask, "part int, query_id bigint, v array<double>, cells array<bigint>")
    search = lambda left, right: _search_block(left, right, dim, k)
    found = asked.groupBy("part").cogroup(placed.groupBy("part")).applyInArrow(search, FOUND)
    best = written(_best(found, k))
    asking = vectors.where("asks").select(F.col("id").alias("query_id"), "v")
    enough = best.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1))
    short = written(asking.join(enough, "query_id", "left_anti"))
    if not short.isEmpty():  # compared with all rows, block by block
        blocks = max(1, -(-n // block_rows))
        all_rows = vectors.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("part"), F.lit(0).cast("long").alias("cell"), "id", "v")
        every = short.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), "query_id", "v", F.array(F.lit(0).cast("long")).alias("cells"))
        exact = every.groupBy("part").cogroup(all_rows.groupBy("part")).applyInArrow(search, FOUND)
        best = _best(best.select("query_id", "id", "score").unionByName(exact), k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
