"""Pareto fronts and front numbers over a grid of objective values. All objectives are to be minimised.

Every objective is cut at (approximate) quantiles; the cuts make cells, and a row's cell numbers grow with its values. So a row can be
dominated by rows of cells that are nowhere higher only, of which

* cells lower in every objective dominate it with all their rows: one number per cell stands for them;
* cells that share a slab with its own have to be looked at row by row;
* all other cells never meet.

Equal rows are one vector, so copies never multiply the work. Where the cells stay larger than `block` (ties in all but one objective,
or more than MOST_CELLS cells) results are the same and tasks are larger. Rows in which an objective is null or NaN neither
dominate nor are dominated. What the driver holds is one number per cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from heatgrid.operators.support import checkpointed

OBJECTIVES = ["obj_reduction", "obj_cost", "obj_feasibility", "obj_cobenefits"]
BLOCK = 2048
CUTS = 1024  # quantiles that cuts are taken from
MOST_CELLS = 1 << 20
CHUNK = 512  # rows compared at a time


@dataclass
class Grid:
    """Cut values of each objective, and the number of vectors in every cell."""

    cuts: list[np.ndarray]
    counts: np.ndarray

    @property
    def shape(self) -> tuple[int, ...]:
        return self.counts.shape

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers of rows of objective values."""
        return np.ravel_multi_index([np.searchsorted(c, x[:, d], side="right") for d, c in enumerate(self.cuts)], self.shape)

    def places(self, cells: np.ndarray) -> np.ndarray:
        """(cells, objectives): the slab numbers of cells."""
        return np.stack(np.unravel_index(cells, self.shape), axis=1)

    def below(self, values: np.ndarray, empty: int) -> np.ndarray:
        """For every cell the largest of `values` over the cells lower in every objective, else `empty`."""
        best = values
        for d in range(values.ndim):
            best = np.maximum.accumulate(best, axis=d)
        out = np.full(self.shape, empty, values.dtype)
        out[tuple(slice(1, None) for _ in self.shape)] = best[tuple(slice(None, -1) for _ in self.shape)]
        return out


def meets(source: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Which target cells (rows of slab numbers) hold rows that some, but perhaps not all, of a source cell's rows dominate."""
    over = (targets >= source).all(axis=1)
    shared = (targets == source).any(axis=1)
    return over & shared & ~(targets == source).all(axis=1)


def dominated(x: np.ndarray, rivals: np.ndarray) -> np.ndarray:
    """(rivals, rows): whether a rival is nowhere worse and somewhere better."""
    no_worse = np.ones((len(rivals), len(x)), bool)
    better = np.zeros((len(rivals), len(x)), bool)
    for d in range(x.shape[1]):
        a, b = rivals[:, d, None], x[None, :, d]
        no_worse &= a <= b
        better |= a < b
    return no_worse & better


def vectors_of(df: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Each different row of objectives once, as doubles, where all are numbers."""
    values = [F.col(o).cast("double").alias(o) for o in objectives]
    return df.select(*values).where(complete(objectives)).distinct()


def complete(objectives: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(o).isNotNull() & ~F.isnan(F.col(o).cast("double")) for o in objectives])


def fit_grid(vectors: DataFrame, objectives: Sequence[str], block: int) -> Grid:
    """A grid with at most `block` vectors in a cell, as far as cuts can do that; the cuts double until it is reached."""
    n = vectors.count()
    bins = max(1, int(np.ceil((n / block) ** (1 / len(objectives)))))
    if n <= block:
        return Grid([np.zeros(0)] * len(objectives), np.full((1,) * len(objectives), n))
    at = [i / CUTS for i in range(1, CUTS)]
    fine = vectors.agg(*[F.percentile_approx(o, at, 100 * CUTS).alias(o) for o in objectives]).first()
    while True:
        # n // bins-th cuts of the fine ones; the lowest value is no cut, as nothing lies below it
        cuts = [np.unique(np.array(fine[o])[np.unique(np.linspace(0, CUTS - 1, min(bins, CUTS) + 1)[1:-1].astype(int))]) if bins > 1 else np.zeros(0) for o in objectives]
        shape = tuple(len(c) + 1 for c in cuts)
        grid = Grid(cuts, np.zeros(shape, np.int64))
        for row in with_cells(vectors, objectives, grid).groupBy("_cell").count().toLocalIterator():
            grid.counts.ravel()[row["_cell"]] = row["count"]
        following = 2 ** len(objectives) * grid.counts.size
        if grid.counts.max() <= block or bins >= CUTS or following > MOST_CELLS:
            return grid
        bins *= 2


def with_cells(df: DataFrame, objectives: Sequence[str], grid: Grid) -> DataFrame:
    """df with its cell number `_cell`."""
    names = list(objectives)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(_cell=grid.cells(rows[names].to_numpy(dtype=np.float64)))

    return df.mapInPandas(run, _ddl(df) + ", _cell bigint")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _sent(grid: Grid, targets: np.ndarray, wanted: Callable[[int], np.ndarray] | None = None):
    """Rows with their `_cell` go to every cell of `targets` that they may reach; `wanted(cell)` narrows the targets down further."""
    places = grid.places(targets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for rows in batches:
            cells = rows["_cell"].to_numpy()
            for cell in np.unique(cells).tolist():
                if cell not in known:
                    reached = meets(grid.places(np.array([cell]))[0], places)
                    known[cell] = targets[reached if wanted is None else reached & wanted(cell)]
                to = known[cell]
                mine = rows[cells == cell]
                for low in range(0, len(to), 64):
                    part = to[low: low + 64]
                    out = mine.loc[mine.index.repeat(len(part))]
                    yield out.assign(_cell=np.tile(part, len(mine)))

    return run


# --- the front ---------------------------------------------------------------------------------------

def _cell_front(objectives: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[objectives].to_numpy(dtype=np.float64)
        order = np.lexsort(x.T[::-1])  # whoever dominates comes earlier
        x, rows = x[order], rows.iloc[order]
        alive = np.ones(len(x), bool)
        for low in range(0, len(x), CHUNK):
            part = np.flatnonzero(alive[low: low + CHUNK]) + low
            alive[part] = ~dominated(x[part], x[part]).any(axis=0)
            left = np.flatnonzero(alive[low + CHUNK:]) + low + CHUNK
            for some in np.array_split(left, -(-len(left) // (8 * CHUNK)) or 1):
                alive[some] = ~dominated(x[some], x[part[alive[part]]]).any(axis=0)
        return rows[alive]

    return run


def _undominated(objectives: list[str]):
    def run(targets: pd.DataFrame, rivals: pd.DataFrame) -> pd.DataFrame:
        x, y = targets[objectives].to_numpy(dtype=np.float64), rivals[objectives].to_numpy(dtype=np.float64)
        left = np.arange(len(x))
        for low in range(0, len(y), CHUNK):
            left = left[~dominated(x[left], y[low: low + CHUNK]).any(axis=0)]
        return targets.iloc[left]

    return run


def _cell_fronts(df: DataFrame, objectives: list[str], block: int) -> tuple[Grid, np.ndarray, DataFrame]:
    """The grid, its cells that no lower cell dominates as a whole, and the vectors of these that are in the front of their own cell."""
    vectors = checkpointed(vectors_of(df, objectives))
    grid = fit_grid(vectors, objectives, block)
    filled = grid.counts > 0
    open_ = filled & ~grid.below(filled, False)
    placed = with_cells(vectors, objectives, grid)
    flags = open_.ravel()

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[flags[rows["_cell"].to_numpy()]]

    fronts = placed.mapInPandas(kept, _ddl(placed)).groupBy("_cell").applyInPandas(_cell_front(objectives), _ddl(placed))
    return grid, np.flatnonzero(flags), checkpointed(fronts)


def pareto_front(df: DataFrame, objectives: Sequence[str] = tuple(OBJECTIVES), *, block: int = BLOCK) -> DataFrame:
    """Rows that no other row dominates; equal rows all stay, and so do rows in which an objective is null or NaN.

    Cells with a filled cell below them in every objective are dropped before rows meet; the others keep their own fronts, whose rows go to
    the cells they share a slab with. Runs a few jobs, whose number does not depend on the data.
    """
    objectives = list(objectives)
    grid, cells, fronts = _cell_fronts(df, objectives, block)
    rivals = fronts.mapInPandas(_sent(grid, cells), _ddl(fronts))
    front = fronts.groupBy("_cell").cogroup(rivals.groupBy("_cell")).applyInPandas(_undominated(objectives), _ddl(fronts))
    names = {o: f"_{i}" for i, o in enumerate(objectives)}
    same = reduce(lambda a, b: a & b, [F.col(o).cast("double") == F.col(names[o]) for o in objectives])
    whole = df.where(complete(objectives)).join(front.select(*[F.col(o).alias(names[o]) for o in objectives]), same, "left_semi")
    return whole.unionByName(df.where(~complete(objectives)))


def front_comparisons(df: DataFrame, objectives: Sequence[str] = tuple(OBJECTIVES), *, block: int = BLOCK) -> int:
    """How many pairs of rows of different cells `pareto_front` compares at most."""
    grid, cells, fronts = _cell_fronts(df, list(objectives), block)
    counts = np.zeros(grid.counts.size, np.int64)
    for row in fronts.groupBy("_cell").count().toLocalIterator():
        counts[row["_cell"]] = row["count"]
    places = grid.places(cells)
    return int(sum(counts[c] * counts[cells[meets(p, places)]].sum() for c, p in zip(cells.tolist(), places)))


# --- numbers of all fronts ---------------------------------------------------------------------------

def _ranked(objectives: list[str], floors: np.ndarray):
    """Ranks of one cell's rows: at least its floor, above every dominating row sent to it, and above those inside."""

    def run(targets: pd.DataFrame, rivals: pd.DataFrame) -> pd.DataFrame:
        if not len(targets):
            return targets.assign(_rank=np.zeros(0, np.int32))
        x = targets[objectives].to_numpy(dtype=np.float64)
        order = np.lexsort(x.T[::-1])
        x = x[order]
        rank = np.full(len(x), floors[targets["_cell"].iloc[0]], np.int32)
        deepest = np.argsort(-rivals["_rank"].to_numpy(), kind="stable")
        y, above = rivals[objectives].to_numpy(dtype=np.float64)[deepest], rivals["_rank"].to_numpy()[deepest]
        left = np.arange(len(x))
        for low in range(0, len(y), CHUNK):  # the deepest first, so a row is done when one dominates it
            if not len(left) or above[low] < rank[left].min():
                break
            beats = dominated(x[left], y[low: low + CHUNK])
            hit = beats.any(axis=0)
            found = above[low: low + CHUNK][beats.argmax(axis=0)] + 1
            rank[left[hit]] = np.maximum(rank[left[hit]], found[hit])
            left = left[~hit]
        for i in range(1, len(x)):  # whoever dominates comes earlier
            beats = (x[:i] <= x[i]).all(axis=1) & (x[:i] < x[i]).any(axis=1)
            if beats.any():
                rank[i] = max(rank[i], rank[:i][beats].max() + 1)
        return targets.iloc[order].assign(_rank=rank)

    return run


def nondominated_rank(df: DataFrame, objectives: Sequence[str] = tuple(OBJECTIVES), *, out: str = "front", block: int = BLOCK) -> DataFrame:
    """Front number from 0 for every row: the length of the longest chain of rows that dominate it; 0 in rows in which an objective is null or NaN.

    Cells with the same sum of slab numbers never dominate each other, so all cells of a sum are ranked at once, after those of smaller
    sums. A cell's floor is one more than the deepest rank in the cells below it in every objective; only rows at least that deep are sent to
    it. So there are as many rounds as filled sums, about (n / block)^(1 / objectives) times the number of objectives where the
    objectives differ, and up to n / block where they all agree (where the rank itself reaches n). Each round runs two jobs.
    """
    objectives = list(objectives)
    vectors = checkpointed(vectors_of(df, objectives))
    grid = fit_grid(vectors, objectives, block)
    placed = checkpointed(with_cells(vectors, objectives, grid))
    kind = _ddl(placed) + ", _rank int"
    cells = np.flatnonzero(grid.counts.ravel())
    sums = grid.places(cells).sum(axis=1)
    deepest = np.full(grid.shape, -1, np.int32)  # of every cell ranked so far
    parts: list[tuple[DataFrame, int]] = []
    for number in np.unique(sums).tolist():
        targets = cells[sums == number]
        floors = grid.below(deepest, -1).ravel() + 1
        ranks = deepest.ravel().copy()
        useful = [part for part, most in parts if most >= floors[targets].min()]
        wanted = lambda cell, ranks=ranks, floors=floors, targets=targets: ranks[cell] >= floors[targets]
        low, high = int(targets.min()), int(targets.max())
        mine = set(targets.tolist())
        current = placed.where(F.col("_cell").between(low, high)).where(F.col("_cell").isin(*mine) if len(mine) <= 256 else _in_level(grid, number))
        rivals = reduce(DataFrame.unionByName, useful) if useful else placed.withColumn("_rank", F.lit(0)).limit(0)
        rivals = rivals.mapInPandas(_sent(grid, targets, wanted), kind) if useful else rivals
        ranked = checkpointed(current.groupBy("_cell").cogroup(rivals.groupBy("_cell")).applyInPandas(_ranked(objectives, floors), kind))
        most = -1
        for row in ranked.groupBy("_cell").agg(F.max("_rank").alias("r")).toLocalIterator():
            deepest.ravel()[row["_cell"]] = row["r"]
            most = max(most, row["r"])
        parts.append((ranked, most))
        if len(parts) % 32 == 0:  # few tables to name in a plan
            parts = [(checkpointed(reduce(DataFrame.unionByName, [p for p, _ in parts])), max(m for _, m in parts))]
    names = {o: f"_{i}" for i, o in enumerate(objectives)}
    if not parts:
        return df.withColumn(out, F.lit(0))
    ranks = reduce(DataFrame.unionByName, [p for p, _ in parts]).select(*[F.col(o).alias(names[o]) for o in objectives], F.col("_rank").alias(out))
    same = reduce(lambda a, b: a & b, [F.col(o).cast("double") == F.col(names[o]) for o in objectives])
    return df.join(ranks, same, "left").drop(*names.values()).withColumn(out, F.coalesce(out, F.lit(0)))


def _in_level(grid: Grid, number: int) -> Column:
    """Whether a cell's slab numbers have this sum."""
    left, total = F.col("_cell"), F.lit(0)
    for size in reversed(grid.shape):
        total = total + left % size
        left = F.floor(left / size)
    return total == number
