"""Quality, language, neighbours, near-duplicates and the pipeline."""

import random

import brute
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from heatgrid.llm import ann, langid, minhash, quality, substring
from heatgrid.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = QUERIES["op6_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out and quality is not null").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.9
    assert (got.predicted == got.quality).mean() > 0.9


def test_quality_of_odd_texts(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (9, 0), (10, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.fit_quality(odd, labels, label="quality")
    out = quality.score_quality(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert {round(r["score"], 9) for r in out if r["doc_id"] in (1, 2)} == {round(model.prior, 9)}
    one = quality.fit_quality(odd, labels.where("quality = 1"), label="quality")
    assert len({r["score"] for r in quality.score_quality(odd, one).collect()}) == 1
    assert quality.score_quality(empty, model).count() == 0
    assert quality.fit_quality(empty, labels.limit(0), label="quality").prior == 0.5


def test_language_on_held_out_rows(spark):
    got = QUERIES["op7_language"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97


def test_language_of_odd_texts(spark, odd, empty):
    docs = table(spark, SF, "documents").limit(200)
    model = langid.fit_language(docs, sample_per_language=30)
    out = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in langid.predict_language(odd, model).collect()}
    assert {(1, True, True), (2, True, True), (3, True, True), (12, True, True), (4, False, False), (6, False, False)} <= out
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    untaught = langid.fit_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict_language(odd, untaught).collect()} == {"und"}
    assert langid.predict_language(empty, model).count() == 0


def test_language_sample_takes_each_text_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train_network", lambda x, y, languages: seen.append((len({r.tobytes() for r in x}), len(x))))
    texts = [(f"text number {i}", "xx") for i in range(30)] + [(f"text number {i}", "xx") for i in range(5) for _ in range(50)]
    langid.fit_language(spark.createDataFrame(texts, "text string, lang string").repartition(4), sample_per_language=20)
    assert seen == [(20, 20)]


def test_long_texts_are_read_to_the_end(spark):
    """The mean over all windows changes with what stands at the end."""
    model = langid.fit_language(table(spark, SF, "documents").limit(300), sample_per_language=60)
    x = "the of and that with " * 30_000
    df = spark.createDataFrame([(1, x), (2, x + "être déçu où près même " * 30_000)], "doc_id long, text string")
    scores = [r["score"] for r in langid.predict_language(df, model).collect()]
    assert scores[0] != scores[1]


def _exact(vectors, queries, k):
    out = []
    for q in queries:
        s = sorted(((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q))[:k]
        out += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return out


def _recall(got, want):
    pairs = {(q, i) for q, _, i, _ in want}
    return len(pairs & {(q, i) for q, _, i, _ in got}) / len(pairs)


@pytest.mark.parametrize("block_rows", [20_000, 150])
def test_neighbours(spark, block_rows):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 24))
    x = centers[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 24)) * rng.uniform(0.2, 1.0, (3000, 1))
    x[:900] = x[0]  # a third of the rows is one vector
    vectors = dict(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>").repartition(5)
    got = rows(ann.nearest(df, F.col("vec_id") % 20 == 0, k=20, block_rows=block_rows))
    want = _exact(vectors, range(0, 3000, 20), 20)
    assert len(got) == len(want)
    by_score = {(q, r): s for q, r, _, s in want}
    close = np.mean([abs(s - by_score[q, r]) < 1e-9 for q, r, _, s in got])
    assert close >= 0.9
    assert all(abs(s - np.dot(vectors[q], vectors[i])) < 1e-9 for q, _, i, s in got)


def test_neighbours_of_odd_vectors(spark):
    v = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]),
         (8, [1.0, 1.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (40, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("score", F.lit(1))
    got = rows(ann.nearest(df, F.col("vec_id") % 20 == 0))
    assert got == [(0, 1, 8, 1.0), (0, 2, 9, 1.0), (0, 3, 20, 0.0), (20, 1, 8, 2.0), (20, 2, 9, 2.0), (20, 3, 0, 0.0)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_neighbour_recall_on_the_table(spark):
    e = table(spark, SF, "embeddings").toPandas()
    want = _exact({i: np.array(v, float) for i, v in zip(e.vec_id, e.embedding)}, [i for i in e.vec_id if i % 20 == 0], 20)
    assert _recall(rows(QUERIES["op3_neighbours"](spark, SF)), want) >= 0.9


def test_signatures_estimate_weighted_jaccard():
    """Unbiased: the mean over many register sets meets the true similarity, also where only the counts differ."""
    a, b = {1: 3, 2: 40, 3: 1, 4: 7}, {1: 9, 2: 25, 3: 1, 5: 2}
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    same = []
    for seed in range(60):
        doc = np.array([0] * len(a) + [1] * len(b))
        keys = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found = minhash.signatures(doc, keys, np.array([*a.values(), *b.values()]), 2, 96, seed)
        assert (found > 0).all()
        same.append((found[0] == found[1]).mean())
    assert abs(np.mean(same) - true) < 0.02


def _near(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 40))
    docs = []
    for g in range(6):
        base = [word() for _ in range(80)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            docs.append((len(docs), " ".join(copy)))
    chain = [word() for _ in range(120)]
    for _ in range(15):  # neighbours are similar, ends are not
        docs.append((len(docs), " ".join(chain)))
        chain = chain[5:] + [word() for _ in range(5)]
    return docs


@pytest.mark.parametrize("block_rows", [20_000, 5])
def test_near_duplicate_classes(spark, odd_texts, block_rows):
    docs = _near(3) + [(1000 + (d or 0), t if t is None or len(t) < 50_000 else t[:20_000]) for d, t in odd_texts]
    docs += [(2000, "A b, C d"), (2001, "a B c D!"), (2002, "a b c"), (2003, "ha " * 5000 + "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows(minhash.classes(df, block_rows=block_rows)) == sorted(brute.near_classes(docs), key=repr)


def test_keep_first(odd, empty):
    out = minhash.keep_first(odd)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 4, 5, 6, 8, 9, 10, 12, None, 13, 14, 15}
    assert minhash.classes(empty).count() == 0


def test_keep_first_keeps_one_row_of_each_class(spark, odd):
    """Row counts: repeated rows and near copies without an id are in one class, rows without words in none."""
    kept = [r["doc_id"] for r in minhash.keep_first(odd).collect()]
    assert sorted(kept, key=repr) == sorted([1, 2, 3, 4, 5, 6, 8, 9, 10, 12, None, 13, 14, 15], key=repr)
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    docs = [(1, long, "a"), (1, long, "b"), (1, long, "a"), (1, long + " end", "a"), (2, long, "a"), (2, other, "b"), (None, other, "a"), (None, other + " x", "c")]
    docs += [(None, "no id at all", "a"), (None, "no id at all", "b"), (3, "", "a"), (3, "", "a"), (None, None, "a"), (None, None, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    out = minhash.keep_first(df)
    assert out.columns == df.columns
    got = rows(out)
    assert sorted((repr(d) for d, *_ in got)) == sorted(map(repr, [1, 2, None, 3, 3, None, None]))
    assert {(d, t) for d, t, _ in got if d == 2 or t == "no id at all"} == {(2, other), (None, "no id at all")} and set(got) <= set(docs)
    once = substring.drop_repeats(out)
    assert {d for d, *_ in rows(once)} == {1, 2, 3, None}


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns = docs.columns
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language"](spark, docs, SF)
    assert kept.columns == columns and kept.count() > 0.99 * len(texts)
    once = steps["near_duplicates"](spark, docs, SF)
    labels = {d: t for d, t in texts}
    from heatgrid.llm.common import written

    once = written(once)
    classes = dict(minhash.classes(docs).collect())
    assert sorted(r["doc_id"] for r in once.collect()) == sorted({*classes.values()} & {*labels})
    shorter = written(steps["repeated_passages"](spark, once, SF))
    want = {d: (n, gone) for d, n, gone, _ in brute.repeats([(r["doc_id"], r["text"]) for r in once.collect()])}
    assert {r["doc_id"] for r in shorter.collect()} == {d for d, (n, gone) in want.items() if gone < n or not n}
    assert all(len(brute.SPACES.findall(r["text"])) == want[r["doc_id"]][0] - want[r["doc_id"]][1] and r["n_chars"] == len(r["text"]) for r in shorter.collect())
    clean = steps["benchmark_passages"](spark, shorter, SF)
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    hits = {d for d, *_, hit in brute.contamination([(r["doc_id"], r["text"]) for r in shorter.collect()], items) if hit}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in shorter.collect()} - hits
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} <= {d for d, _ in texts}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    """Nulls, repeated rows, texts without letters, clashing columns, an item that is one whole document; then no documents and no items."""
    import corpus_pipeline

    docs = odd.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint"))
    items = spark.createDataFrame([(1, "No id, at all!"), (2, None)], "item_id long, text string")
    for name, some in (("odd", True), ("empty", False)):
        folder = f"{tmp_path}/{name}"
        (docs if some else docs.limit(0)).write.parquet(f"{folder}/documents.parquet")
        (items if some else items.limit(0)).write.parquet(f"{folder}/benchmark.parquet")
        pieces = corpus_pipeline.run(spark, folder).collect()
        # 7, 11 and one row of 10 are copies, 14 is one repeated word, 1 to 3 and 12 have no letter, the row without an id is the item
        assert {r["doc_id"] for r in pieces} == ({4, 5, 6, 8, 9, 10, 13, 15} if some else set())
        assert len([r for r in pieces if r["doc_id"] == 10]) == (1 if some else 0)
