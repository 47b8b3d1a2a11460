"""Means of a tree's score over all pixels under every package, without pairs of pixels and packages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from heatgrid import schema as S
from heatgrid.operators.interventions import slot_packages

MOST_LEAVES = 4096
CHUNK = 4096  # pixels whose places under a threshold are kept as rows of bits
BATCH = 256  # packages that go through a chunk at once
SLICE = 16_384  # packages whose thresholds are searched at once

#: A leaf's value, or (feature, threshold, left, right): a row goes left where its feature is not above the threshold.
Tree = float | tuple


@dataclass
class TreeScore:
    """A fitted tree's score as a function of a table. Its splits are open, so that means over many changed cities can be told
    from how many pixels reach a leaf."""

    score: Callable[[DataFrame], DataFrame]
    tree: Tree

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.score(df)

    def features(self) -> list[str]:
        """The features of the splits."""
        return list(dict.fromkeys(f for f, _ in _splits(self.tree)))

    def n_leaves(self) -> int:
        return len(list(_splits(self.tree))) + 1


def _splits(tree: Tree) -> Iterator[tuple[str, float]]:
    if isinstance(tree, tuple):
        yield tree[:2]
        yield from _splits(tree[2])
        yield from _splits(tree[3])


def _boxes(tree: Tree, box: Mapping[str, tuple] | None = None) -> Iterator[tuple[float, dict[str, tuple]]]:
    """(value, {feature: (threshold that it is above, threshold that it is not above)}) of every leaf that a row can reach; None is no threshold."""
    box = box or {}
    if not isinstance(tree, tuple):
        yield tree, dict(box)
        return
    f, at, left, right = tree
    low, high = box.get(f, (None, None))
    if low is None or low < at:
        yield from _boxes(left, {**box, f: (low, at if high is None else min(at, high))})
    if high is None or at < high:
        yield from _boxes(right, {**box, f: (at if low is None else max(at, low), high)})


def tree_changes(
    ready: DataFrame, packages: DataFrame, effects: DataFrame, predict: TreeScore, *, package_id: str = "package_id",
    pixel_rows: int = 1 << 20, package_rows: int = 1 << 17,
) -> tuple[DataFrame | None, DataFrame | None]:
    """(package_id, _change): the change of a tree's mean score over all pixels, and the packages that this does not settle (None: none).

    A package's steps on a feature never put a larger value below a smaller one, so the pixels that go left at a split are the first
    ones in the feature's order; how many is found by bisection with the very steps that a pixel would take. A leaf with one feature that
    the packages move is counted by running counts over that order, among the pixels that its other splits let through: work that grows
    with the sum of pixels and packages. For leaves with several such features the pixels are rows of bits, which are combined and counted
    64 at a time. Blocks of pixels and packages meet in one task each. Packages with steps that are missing, turn the order round or are not
    finite, and all packages where a pixel's feature is not finite, have to meet every pixel. Runs a few jobs.
    """
    spark, used = packages.sparkSession, predict.features()
    if not used or predict.n_leaves() > MOST_LEAVES:
        return None, packages
    pixels = ready.select(*[F.col(f).cast("double").alias(f) for f in used])
    wide = [F.coalesce(F.max(F.abs(f)), F.lit(float("inf"))).alias(f"m_{f}") for f in used]
    n, *largest = pixels.agg(F.count(F.lit(1)), *wide).first()
    if not n or not all(x < float("inf") for x in largest):
        return None, packages
    steps, slots = slot_packages(packages, effects, used, package_id=package_id)

    def usual(f: str) -> list:
        finite = lambda c: F.abs(c) < float("inf")  # noqa: E731  (not so for NaN)
        ends = [f"_{c}_{f}_{j}" for j in range(slots[f]) for c in ("scale", "shift")] if slots[f] else [f"_scale_{f}", f"_shift_{f}"]
        known = [F.col(c).isNotNull() & ~F.isnan(c) for c in ((f"_low_{f}", f"_high_{f}") if not slots[f] else ())]
        return [finite(F.col(c)) for c in ends] + [F.col(c) >= 0 for c in ends if c.startswith("_scale_")] + known

    fine = F.lit(True)
    for condition in (c for f in used for c in usual(f)):
        fine = fine & condition
    steps = steps.withColumn("_settled", F.coalesce(fine, F.lit(False)))
    total, settled = steps.agg(F.count(F.lit(1)), F.count(F.when(F.col("_settled"), 1))).first()
    rest = packages.join(steps.where("NOT _settled").select(package_id), package_id, "left_semi") if settled < total else None
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = -(-n // pixel_rows)
    blocks = max(1, -(-settled // package_rows), min(-(-tasks // parts), settled))
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = pixels.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).withColumn("_block", numbers(blocks))
    right = steps.where("_settled").drop("_settled").withColumn("_block", F.pmod(F.xxhash64(package_id), F.lit(blocks)).cast("int")).withColumn("_part", numbers(parts))
    key = T.StructField(package_id, steps.schema[package_id].dataType)
    found = T.StructType([key, T.StructField("_sum", T.DoubleType()), T.StructField("_n", T.LongType())])
    sums = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(_leaf_sums(predict.tree, slots, package_id), found)
    return sums.groupBy(package_id).agg((F.sum("_sum") / F.sum("_n")).alias("_change")), rest


def _leaf_sums(tree: Tree, slots: Mapping[str, int], package_id: str):
    """(package id, change of the sum of scores, pixels) of a block of pixels and one of packages."""

    def run(pixels: pa.Table, packages: pa.Table) -> pa.Table:
        if not pixels.num_rows or not packages.num_rows:
            change, n = np.zeros(0), 0
            packages = packages.slice(0, 0)
        else:
            change, n = block_changes(tree, {f: _numbers(pixels, f) for f in slots}, _moves(packages, slots), packages.num_rows), pixels.num_rows
        ids = packages.column(package_id)
        return pa.table([ids, pa.array(change), pa.array(np.full(len(change), n, np.int64))], [package_id, "_sum", "_n"])

    return run


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([c.to_numpy(zero_copy_only=False) for c in table.column(name).chunks])


def _moves(packages: pa.Table, slots: Mapping[str, int]) -> dict[str, Callable[[np.ndarray, slice], np.ndarray]]:
    """feature -> the feature's value under each package of a slice, from one value per package; as `apply_slots` finds it."""

    def merged(f: str):
        scale, shift, low, high = (_numbers(packages, f"_{c}_{f}") for c in ("scale", "shift", "low", "high"))
        return lambda x, at: np.maximum(np.minimum(x * scale[at] + shift[at], high[at]), low[at])

    def slotted(f: str):
        size, (low, high) = _numbers(packages, f"_n_{f}"), S.EFFECT_BOUNDS.get(f, (None, None))
        steps = [[_numbers(packages, f"_{c}_{f}_{j}") for c in ("scale", "shift", "raise")] for j in range(slots[f])]

        def move(x: np.ndarray, at: slice) -> np.ndarray:
            for j, (scale, shift, raises) in enumerate(steps):
                new = x * scale[at] + shift[at]
                new = np.where(raises[at].astype(bool), np.maximum(x, new), new)
                new = new if high is None else np.minimum(new, float(high))
                new = new if low is None else np.maximum(new, float(low))
                x = np.where(size[at] > j, new, x)
            return x

        return move

    return {f: slotted(f) if slots[f] else merged(f) for f in slots}


def block_changes(tree: Tree, values: Mapping[str, np.ndarray], moves: Mapping[str, Callable], n_packages: int) -> np.ndarray:
    """The change of the sum of scores of all pixels under each package."""
    boxes = list(_boxes(tree))
    n = len(next(iter(values.values())))
    order = {f: np.argsort(x, kind="stable").astype(np.int32) for f, x in values.items()}
    ranked = {f: x[order[f]] for f, x in values.items()}
    base = {(f, t): int(np.searchsorted(ranked[f], t, side="right")) for f, t in _splits(tree)}
    first = {s: np.concatenate([_first_places(ranked[s[0]], s[1], moves[s[0]], at) for at in _slices(n_packages, SLICE)]) for s in base}
    moved = {f: np.zeros(n_packages, bool) for f in values}
    for (f, t), places in first.items():
        moved[f] |= places != base[f, t]
    names, change = list(values), np.zeros(n_packages)
    several = lambda moving: any(len(set(moving) & set(box)) > 1 for _, box in boxes)
    kinds = [(slice(None), [f for f in names if moved[f].any()])]
    if several(kinds[0][1]):  # packages that move the same features together: most move few
        code = sum(moved[f].astype(np.int64) << i for i, f in enumerate(names))
        kinds = [(np.flatnonzero(code == c), [f for i, f in enumerate(names) if c >> i & 1]) for c in np.unique(code).tolist()]
    for rows, moving in kinds:
        change[rows] = _one_feature(boxes, values, order, base, {s: p[rows] for s, p in first.items()}, moving, n, len(change[rows]))
    if kinds := [(rows, moving) for rows, moving in kinds if several(moving)]:
        change += _several_features(tree, values, order, base, first, kinds, n, n_packages)
    return change


def _slices(n: int, size: int) -> Iterator[slice]:
    return (slice(k, min(k + size, n)) for k in range(0, n, size))


def _first_places(ranked: np.ndarray, threshold: float, move: Callable, at: slice) -> np.ndarray:
    """How many of the sorted values each package leaves at or below a threshold."""
    low = np.zeros(at.stop - at.start, np.int32)
    high = np.full(len(low), len(ranked), np.int32)
    for _ in range(len(ranked).bit_length()):
        middle = (low + high) >> 1
        open_ = low < high
        under = move(ranked[np.minimum(middle, len(ranked) - 1)], at) <= threshold
        low, high = np.where(open_ & under, middle + 1, low), np.where(open_ & ~under, middle, high)
    return low


def _one_feature(boxes, values, order, base, first, moving, n: int, n_packages: int) -> np.ndarray:
    """From leaves with one moving feature: running counts over its order of the pixels that the other splits let through."""
    change = np.zeros(n_packages)
    for value, box in boxes:
        found = [f for f in moving if f in box]
        if len(found) != 1:
            continue
        f, (low, high) = found[0], box[found[0]]
        upto = np.zeros(n + 1, np.int32)
        np.cumsum(_inside(values, {g: b for g, b in box.items() if g != f}, n)[order[f]], out=upto[1:])
        count = lambda places: (upto[places[f, high]] if high is not None else upto[n]) - (
            upto[places[f, low]] if low is not None else 0)  # noqa: B023
        # Where the steps are flat both ends may fall on one place, never in the wrong order.
        change += value * (count(first) - count(base)).astype(np.float64)
    return change


def _inside(values: Mapping[str, np.ndarray], box: Mapping[str, tuple], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for f, (low, high) in box.items():
        if low is not None:
            out &= values[f] > low
        if high is not None:
            out &= values[f] <= high
    return out


def _several_features(tree: Tree, values, order, base, first, kinds, n: int, n_packages: int) -> np.ndarray:
    """From leaves with several moving features: bits of the pixels, chunk by chunk, combined along the branches."""
    change, moving = np.zeros(n_packages), sorted({f for _, names in kinds for f in names})

    def needed(node: Tree, names: Sequence[str], seen: frozenset = frozenset()) -> Tree | None:
        """The tree without the branches whose leaves have at most one moving feature."""
        if not isinstance(node, tuple):
            return node if len(seen) > 1 else None
        f, t, *sides = node
        sides = [needed(s, names, seen | ({f} & set(names))) for s in sides]
        return None if sides == [None, None] else (f, t, *sides)

    def total(node: Tree | None, mask: np.ndarray, bits: Callable) -> np.ndarray | float:
        if node is None:
            return 0.0
        if not isinstance(node, tuple):
            return node * np.bitwise_count(mask).sum(axis=-1, dtype=np.int64).astype(np.float64)
        left = bits(node[:2])
        return total(node[2], mask & left, bits) + total(node[3], mask & ~left, bits)

    branches = [(rows, set(names), needed(tree, names)) for rows, names in kinds]
    place = {f: np.argsort(order[f]).astype(np.int32) for f in moving}
    for chunk in _slices(n, CHUNK):
        size = chunk.stop - chunk.start
        words = -(-size // 64)
        valid = _bits(np.ones(size, bool), words)
        local, under = {}, {}  # places within the chunk; the bits of so many first pixels
        for f in moving:
            here = np.zeros(n + 1, np.int16)
            here[place[f][chunk] + 1] = 1
            local[f] = np.cumsum(here, out=here)
            table = np.zeros((size + 1, words), np.uint64)
            at = np.argsort(place[f][chunk])
            table[np.arange(1, size + 1), at >> 6] = np.uint64(1) << (at & 63).astype(np.uint64)
            under[f] = np.bitwise_or.accumulate(table, axis=0)
        fixed = {s: _bits(values[s[0]][chunk] <= s[1], words) for s in base}
        for rows, names, branch in branches:
            usual = total(branch, valid, fixed.__getitem__)
            for part in _slices(len(rows), BATCH):
                mine = rows[part]
                bits = lambda s: under[s[0]][local[s[0]][first[s][mine]]] if s[0] in names else fixed[s][None, :]  # noqa: B023, E731
                change[mine] += total(branch, valid[None, :], bits) - usual
    return change


def _bits(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, bool)
    padded[:len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)
