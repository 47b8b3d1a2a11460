"""Words made to collide, vectors near the ends of the range of doubles, texts of very many characters."""

import brute
import pytest
from conftest import rows
from pyspark.sql import functions as F

from heatgrid.llm import ann, decontam, minhash, substring


def thue_morse(n):
    """Two different words that agree in every polynomial hash modulo 2^64, whatever its base."""
    word, other = "a", "b"
    while len(word) < n:
        word, other = word + other, other + word
    return word, other


@pytest.fixture(scope="module")
def pair():
    return thue_morse(1024)


def test_words_of_equal_polynomial_hash_in_decontamination(spark, pair):
    words = [f"w{i}" for i in range(30)]
    item = " ".join([*words[:15], pair[0], *words[15:]])
    docs = [(1, item), (2, item.replace(pair[0], pair[1]))]
    found = decontam.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    got = rows(found.select("doc_id", "n_words", "n_hit", F.size("items"), decontam.items_digest(F.col("items")), F.col("n_hit") > 0))
    assert got == sorted(brute.contamination(docs, [(7, item)]), key=repr) and {r[2] for r in got} == {31, 30}


def test_words_of_equal_polynomial_hash_in_substrings(spark, pair):
    words = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join([*words[:20], pair[0], *words[20:]])), (2, " ".join([*words[:20], pair[1], *words[20:]]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = substring.remove_repeats(df).select("k1", "k2", "n_words", "n_removed", F.sha2("kept", 256).alias("h"))
    got = rows(substring.per_document(df, found, [F.col("doc_id")]).select("row.doc_id", "n_words", "n_removed", "h"))
    assert got == sorted(brute.repeats(docs, 35), key=repr) and {r[2] for r in got} == {0}


def test_words_of_equal_polynomial_hash_in_near_duplicates(spark, pair):
    docs = [(1, f"one two three {pair[0]}"), (2, f"one two three {pair[1]}"), (3, f"one two three {pair[0].upper()}")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_neighbours_of_huge_and_tiny_vectors(spark):
    v = {0: [1.0, 0.0], 1: [1e200, 0.0], 2: [1e160, 1e160], 3: [1e-170, 0.0], 4: [0.5, 0.0], 5: [-1e300, 1e300], 6: [5e-324, 0.0], 20: [1e300, 1e300], 7: [1.7e308, -1.7e308]}
    df = spark.createDataFrame([(i, x) for i, x in v.items()], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for q, _, i, s in sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0).collect())):
        got.setdefault(q, []).append((i, s))
    assert got[0] == [(7, 1.7e308), (20, 1e300), (1, 1e200), (2, 1e160), (4, 0.5), (3, 1e-170), (6, 5e-324), (5, -1e300)]
    infinite = [i for i, s in got[20] if abs(s) == float("inf")]
    assert sorted(infinite) == [1, 2, 5, 7] and [x for x in got[20] if x[0] not in infinite] == [(0, 1e300), (4, 5e299), (3, 1e130), (6, 5e-324 * 1e300)]
