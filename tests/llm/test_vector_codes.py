"""Vector codes against comparing everything."""

import brute
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from heatgrid.llm import vector_codes

KIND = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("size,width,spread", [(1, 4, 9), (2, 3, 2), (64, 4, 300), (64, 2, 3), (64, 1, 40), (200, 5, 10**6), (64, 4, 0)])
def test_tree_finds_nearest_entries_and_ties(size, width, spread):
    rng = np.random.default_rng(size + width)
    entries, queries = rng.integers(-spread, spread + 1, (size, width)), rng.integers(-spread, spread + 1, (3000, width))
    d2 = ((queries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    for kind in (np.int64, object):
        tree = vector_codes.Gnat(entries.astype(kind))
        best, least = tree.nearest(queries[: 3000 if kind is np.int64 else 200].astype(kind))
        assert (best == d2.argmin(axis=1)[: len(best)]).all() and (least == d2.min(axis=1)[: len(best)]).all()
    if size == 200:
        assert tree.looked < 0.8 * size * 200


def test_subtrees_are_eliminated_where_entries_are_apart():
    rng = np.random.default_rng(3)
    centers = rng.integers(-50_000, 50_000, (8, 4))
    entries = np.concatenate([c + rng.integers(-50, 51, (8, 4)) for c in centers])
    queries = entries[rng.integers(0, 64, 4000)] + rng.integers(-9, 10, (4000, 4))
    tree = vector_codes.Gnat(entries)
    best, _ = tree.nearest(queries)
    assert (best == ((queries[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)).all() and tree.looked < 0.3 * 64 * 4000


@pytest.mark.parametrize("n,factor", [(400, 1.0), (30, 1.0), (90, 1e30), (80, 1e160)])
def test_codes_of_a_table(spark, n, factor):
    rng = np.random.default_rng(n)
    data = [(int(i), (factor * rng.normal(size=32)).tolist(), [0, 1, None][i % 3]) for i in rng.permutation(n)]
    if factor == 1.0:
        data += [(n + i, data[0][1], 0) for i in range(n // 2)]  # a third of the rows is one vector
    df = spark.createDataFrame(data, KIND).repartition(4)
    want, digest = brute.vector_codes([(i, v) for i, v, _ in data])
    label = {i: x for i, _, x in data}
    total = {x: sum(e for i, (_, e) in want.items() if label[i] == x) for x in (0, 1, None)}
    fits = lambda e: e if e < 1 << 63 else None
    got = rows(vector_codes.compress_vectors(df))
    assert got == sorted(((i, c, fits(e), fits(total[label[i]]), digest) for i, (c, e) in want.items()), key=repr)


def test_odd_vectors(spark):
    x = [float(i) / 7 for i in range(16)]
    data = [(1, x, 0), (2, None, 0), (3, [], 0), (4, x[:15] + [None], 0), (5, x[:15] + [float("nan")], 0), (6, x[:15] + [float("inf")], 0), (7, x[:5], 0), (8, x[::-1], None),
            (1, x, None), (None, x, 1), (9, x * 2, 1)]
    df = spark.createDataFrame(data, KIND).withColumn("code", F.lit("x")).withColumn("v", F.lit(1)).withColumn("id", F.lit(1))
    got = rows(vector_codes.compress_vectors(df).drop("codebooks_sha256"))
    own, back = "00" * 16, "02" * 16
    assert [r for r in got if r[0] in (3, 7, 9)] == [(3, None, None, 0), (7, None, None, 0), (9, None, None, 0)]
    assert sorted(r[1:3] for r in got if r[0] in (1, None)) == [(own, 0)] * 3 and [r[2:] for r in got if r[0] == 8] == [(0, 0)] and back
    assert vector_codes.compress_vectors(df.limit(0)).count() == 0
    assert rows(vector_codes.compress_vectors(df.where("vec_id = 7")).drop("codebooks_sha256")) == [(7, None, None, None)]
