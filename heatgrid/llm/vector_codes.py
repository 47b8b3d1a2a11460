"""Vector codes: product quantisation in whole numbers, nearest codebook entries found by a GNAT.

A component x becomes floor(scale * x); vectors are cut into equal consecutive parts, each with a codebook of its own. The codebooks start as the
parts of the rows with the smallest ids; each round assigns every part to its nearest entry and replaces an entry by the
floor of its parts' mean (unused entries stay). The code of a vector lists its parts' nearest entries.

Nearest entries. A codebook is a geometric near-neighbour access tree: a node holds split points, every other entry of the node
belongs to its nearest split point, and for each pair (split point, subtree) the node stores between which distances from
the split point the subtree's entries lie. A query measures its distance d to a split point, r is the best distance so far: subtrees
whose range lies wholly outside [d - r, d + r] go, with all their entries. The test is strict and the square roots are rounded to
the safe side, so no entry that is as near as the best is lost; distances themselves are compared as exact whole numbers,
and ties go to the smaller index. Many queries walk the tree side by side, each with the subtrees left to it.

On a cluster. Codebooks are `entries` x length numbers, so they travel with the tasks; a round is one pass in which each task sums its
own parts (one row per entry in use) and one aggregation of those sums. Nothing else reaches the driver.

Defined results: rows whose vector is null or holds null or non-finite components are left out; the length is the most common one
that can be cut into the parts (the larger one of several), rows of other lengths have no code and no error and take no part;
rows that share an id are coded each, in the starting codebook they follow each other in the order of their vectors, null ids come last; with fewer rows than
entries the codebooks are smaller; components too large for 64-bit sums are computed as Python integers, an error beyond 64 bits is
null, and so is its label's; an empty table gives no rows. Only the id, vector and label columns are read, others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from heatgrid.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
DEGREE, LEAF, BATCH = 8, 6, 4096
SAFE = float(1 << 26)  # components below this are summed in 64 bits
_UP, _DOWN = 1.0 + 2.0**-48, 1.0 - 2.0**-48  # wider than all roundings of a square root and a sum


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis, of whole numbers."""
    d = a - b
    return (d * d).sum(axis=-1)


def _roots(d2: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        try:
            return np.sqrt(d2.astype(np.float64))
        except OverflowError:  # an integer beyond the doubles
            return np.array([np.sqrt(float(x)) if x < 1 << 1023 else np.inf for x in d2.ravel().tolist()]).reshape(d2.shape)


@dataclass
class Node:
    points: np.ndarray  # entry numbers: the split points, or all entries of a leaf
    children: list[Node | None] = field(default_factory=list)
    low: np.ndarray | None = None  # (split point, subtree): the least distance, rounded down
    high: np.ndarray | None = None  # the largest one, rounded up


class Gnat:
    """Exact nearest entries among a few (n, d) rows of whole numbers."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.entries, self.degree, self.leaf = entries, degree, leaf
        self.looked = 0  # distances measured so far
        self.root = self._build(np.arange(len(entries)))

    def _build(self, points: np.ndarray) -> Node | None:
        if not len(points):
            return None
        if len(points) <= self.leaf:
            return Node(points)
        chosen = [int(points[0])]
        apart = squared(self.entries[points], self.entries[chosen[0]])
        while len(chosen) < self.degree:  # the farthest entry from the split points so far
            far = int(np.argmax(apart))
            if not apart[far] > 0:
                break
            chosen.append(int(points[far]))
            apart = np.minimum(apart, squared(self.entries[points], self.entries[chosen[-1]]))
        if len(chosen) < 2:
            return Node(points)
        splits = np.array(chosen)
        rest = points[~np.isin(points, splits)]
        distance = squared(self.entries[splits][:, None, :], self.entries[rest][None, :, :])
        home = np.argmin(distance, axis=0) if len(rest) else np.zeros(0, np.int64)
        between = squared(self.entries[splits][:, None, :], self.entries[splits][None, :, :])
        k = len(splits)
        low, high = np.zeros((k, k)), np.zeros((k, k))
        for j in range(k):
            for i in range(k):
                inside = distance[i, home == j].tolist() + ([between[i, j]] if i != j else [])
                root = _roots(np.array([min(inside, default=0), max(inside, default=0)]))
                low[i, j], high[i, j] = root[0] * _DOWN, root[1] * _UP
        return Node(splits, [self._build(rest[home == j]) for j in range(k)], low, high)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each query."""
        m = len(queries)
        best = np.full(m, -1, np.int64)
        least = np.zeros(m, queries.dtype)
        if m:
            self._visit(self.root, queries, np.arange(m), best, least)
        return best, least

    def _offer(self, rows: np.ndarray, entry: int, d2: np.ndarray, best: np.ndarray, least: np.ndarray) -> None:
        self.looked += len(rows)
        better = (best[rows] < 0) | (d2 < least[rows]) | ((d2 == least[rows]) & (entry < best[rows]))
        won = rows[better]
        best[won], least[won] = entry, d2[better]

    def _visit(self, node: Node | None, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, least: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        if node.low is None:
            for entry in node.points.tolist():
                self._offer(rows, entry, squared(queries[rows], self.entries[entry]), best, least)
            return
        k = len(node.points)
        alive = np.ones((len(rows), k), bool)
        measured = np.full((len(rows), k), np.nan)

        def eliminate(i: int, at: np.ndarray) -> None:
            d = measured[at, i]
            r = _roots(least[rows[at]]) * _UP
            far = (d * _DOWN)[:, None] > ((node.high[i][None, :] + r[:, None]) * _UP)
            near = ((d * _UP + r) * _UP)[:, None] < node.low[i][None, :]
            alive[at] &= ~(far | near)

        for i, entry in enumerate(node.points.tolist()):
            at = np.flatnonzero(alive[:, i])
            if not len(at):
                continue
            d2 = squared(queries[rows[at]], self.entries[entry])
            self._offer(rows[at], entry, d2, best, least)
            measured[at, i] = _roots(d2)
            eliminate(i, at)
        home = np.argmin(np.where(np.isnan(measured), np.inf, measured), axis=1)
        for j in range(k):
            self._visit(node.children[j], queries, rows[alive[:, j] & (home == j)], best, least)
        for i in range(k):  # once more, with the distances found at home
            at = np.flatnonzero(~np.isnan(measured[:, i]))
            if len(at):
                eliminate(i, at)
        for j in range(k):
            self._visit(node.children[j], queries, rows[alive[:, j] & (home != j)], best, least)


@dataclass
class Codebooks:
    entries: np.ndarray  # (parts, entries, part length), int64 or Python integers

    @property
    def wide(self) -> bool:
        return self.entries.dtype == object

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_numbers(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x), exactly."""
    if not wide:
        return np.floor(x * scale).astype(np.int64)
    exact = lambda v: int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale))
    out = np.empty(x.shape, object)
    out.ravel()[:] = [exact(v) for v in x.ravel().tolist()]
    return out


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


class Coder:
    """Assigns batches of vectors to codebooks; the trees are built once in each task."""

    def __init__(self, books: Codebooks, scale: int):
        self.books, self.scale = books, scale
        self.trees = [Gnat(b) for b in books.entries]

    def assign(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(whole numbers by part, entries, squared distances) of a bounded number of vectors at a time."""
        parts, _, width = self.books.entries.shape
        for low in range(0, len(vectors), BATCH):
            q = whole_numbers(vectors[low: low + BATCH], self.scale, self.books.wide).reshape(-1, parts, width)
            found = [tree.nearest(q[:, p]) for p, tree in enumerate(self.trees)]
            yield q, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(books: Codebooks, scale: int, length: int):
    """Each task's sums: (part, entry, n, sums of the components as decimal numbers), one row for each entry in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books, scale)
        parts, entries, width = books.entries.shape
        total = np.zeros((parts, entries, width), books.entries.dtype)
        n = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for q, entry, _ in coder.assign(_matrix(batch.column(0), length)):
                for p in range(parts):
                    np.add.at(total[p], entry[:, p], q[:, p])
                    n[p] += np.bincount(entry[:, p], minlength=entries)
        p, e = np.nonzero(n)
        if len(p):
            text = pa.array([list(map(str, total[i, j].tolist())) for i, j in zip(p, e)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), text], ["part", "entry", "n", "sums"])

    return run


def _total(keys: tuple, rows: pa.Table) -> pa.Table:
    """The tasks' sums of one entry, added up."""
    total = [sum(map(int, column)) for column in zip(*rows.column("sums").to_pylist())]
    n = sum(rows.column("n").to_pylist())
    return pa.table({"part": pa.array([keys[0].as_py()], pa.int32()), "entry": pa.array([keys[1].as_py()], pa.int32()), "means": pa.array([[str(t // n) for t in total]])})


def refine(vectors: DataFrame, books: Codebooks, scale: int = SCALE) -> Codebooks:
    """One round over (v) rows: assignment, then the floors of the means."""
    parts, entries, width = books.entries.shape
    sums = vectors.select("v").mapInArrow(_sums(books, scale, parts * width), "part int, entry int, n bigint, sums array<string>")
    if books.wide:
        means = sums.groupBy("part", "entry").applyInArrow(_total, "part int, entry int, means array<string>").collect()
        value = {(r["part"], r["entry"]): list(map(int, r["means"])) for r in means}
    else:
        each = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        added = each.groupBy("part", "entry", "at").agg(F.sum(F.col("s").cast("bigint")).alias("s"), F.sum("n").alias("n")).collect()
        value = {}
        for r in added:
            value.setdefault((r["part"], r["entry"]), [0] * width)[r["at"]] = r["s"] // r["n"]
    out = books.entries.copy()
    for (p, e), mean in value.items():
        out[p, e] = mean
    return Codebooks(out)


def fit_codebooks(vectors: DataFrame, length: int, wide: bool, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of (id, v) rows of one length, after `rounds` passes."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = whole_numbers(np.array([r["v"] for r in first], np.float64).reshape(len(first), length), scale, wide)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, length // parts).transpose(1, 0, 2)))
    for _ in range(rounds):
        books = refine(vectors, books, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """(id, label, code, error) of (id, label, v) rows."""
    parts, _, width = books.entries.shape
    kinds = [T.StructField(c, vectors.schema[c].dataType) for c in ("id", "label")]
    own = T.StructType([*kinds, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    most = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books, scale)
        for batch in batches:
            code, error = [], []
            for _, entry, d2 in coder.assign(_matrix(batch.column(2), parts * width)):
                raw = entry.astype(np.uint8).tobytes().hex()
                code += [raw[2 * parts * i: 2 * parts * (i + 1)] for i in range(len(entry))]
                error += [e if e <= most else None for e in d2.sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return vectors.select("id", "label", "v").mapInArrow(run, own)


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row whose vector is whole; two hex digits for each part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = written(df.where(v.isNotNull() & finite).select(F.col(id_col).alias("id"), F.col(label).alias("label"), v.alias("v")))
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    sizes = [r for r in kept.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), largest.alias("most")).collect() if r["size"] and r["size"] % parts == 0]
    schema = df.select(F.col(id_col)).schema
    if not sizes:
        none = lambda t: F.lit(None).cast(t)
        return kept.select(F.col("id").alias(schema[0].name), none("string").alias("code"), none("bigint").alias("error"), none("bigint").alias("label_error"), none("string").alias("codebooks_sha256"))
    size = max(sizes, key=lambda r: (r["n"], r["size"]))
    wide = size["most"] * scale >= SAFE
    vectors = kept.where(F.size("v") == size["size"])
    books = fit_codebooks(vectors, size["size"], wide, parts, entries, rounds, scale)
    coded = encode(vectors, books, scale)
    others = kept.where(F.size("v") != size["size"]).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    rows = written(coded.unionByName(others))
    lost = F.max(F.col("code").isNotNull() & F.col("error").isNull())
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.when(~lost, F.try_sum("error")).alias("label_error"))
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(schema[0].name), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
