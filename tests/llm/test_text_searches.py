"""License scans, decontamination and substring removal against plain versions."""

import random

import brute
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from heatgrid.llm import decontam, license_scan, substring
from heatgrid.llm.common import text_key

BASE = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def test_license_phrases_on_odd_texts(odd, odd_texts):
    got = rows(license_scan.scan_licenses(odd).select(*BASE))
    assert got == sorted(((d, *brute.licenses(t, license_scan.PHRASES)) for d, t in odd_texts), key=repr)


def test_license_phrases_end_with_their_document(spark):
    df = spark.createDataFrame([(1, "the mit"), (2, "license mit license"), (3, "cc by cc, BY")], "doc_id long, text string").coalesce(1)
    assert rows(license_scan.scan_licenses(df).select(*BASE)) == [(1, 2, 0, None, None, ""), (2, 3, 1, 1, 1, "mit"), (3, 4, 2, 0, 2, "cc-by")]


@pytest.mark.parametrize("edits", [0, 1, 2, 3, 4])
def test_notice_with_errors_is_found_and_reported(spark, edits):
    notice = "licensed under the apache license, version 2.0"
    rng = random.Random(edits)
    texts = []
    for i in range(20):
        letters = list(notice)
        for at in rng.sample(range(1, len(notice) - 1), edits):
            letters[at] = rng.choice(["", "#", letters[at] + "#"])
        texts.append((i, "Some words before. " + "".join(letters) + " and after"))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for r in license_scan.scan_licenses(df).collect():
        assert "apache-2.0" in r["labels"].split(",")
        spans = [n for n in r["notices"] if n["label"] == "apache-2.0"]
        assert len(spans) == 1 and spans[0]["edits"] <= edits
        assert 0 < r["score"] <= 1


def test_notice_with_too_many_errors_is_no_match(spark):
    df = spark.createDataFrame([(1, "lixxnsed unxxr the apaxxe licxxse, verxxon 2.x"), (2, "an apache and a license")], "doc_id long, text string")
    assert {r["labels"] for r in license_scan.scan_licenses(df).collect()} == {""}


def _labels(text):
    return [f[0] for f in license_scan.NoticeSearch(license_scan.NOTICES, 10).find(text)]


def test_worse_notices_before_the_best_are_found():
    first, last = "licensxd undxr the gnu general public license, version 3", "licensed under the gnu general public license, version 2"
    assert _labels(f"{first} or {last}") == ["gpl-3.0", "gpl-2.0"]
    assert _labels(f"{first} or {first} or {last} or {first}") == ["gpl-3.0", "gpl-3.0", "gpl-2.0", "gpl-3.0"]


@pytest.mark.parametrize("text", ["released under the bsd license", "released under the gpl license", "released under the isc license", "licensed under cc by 3.0",
                                  "licensed under cc by-nd 4.0", "licensed under the apache license, version 1.0", "licensed under the apache license, version 2.1",
                                  "licensed under the apache license, version 22.0", "licensed under the gnu general public license, version 4"])
def test_other_licenses_and_versions_are_no_match(text):
    assert _labels(text) == []


@pytest.mark.parametrize("label,text", [("mit", "relesed undr the mlt license"), ("apache-2.0", "licensed under the apachee licence, version #.0"), ("cc-by-4.0", "licenced under cc by 4.O"),
                                        ("gpl-2.0", "licensed undr the gnu genral public license, version 2"), *license_scan.NOTICES])
def test_damaged_names_are_found(label, text):
    assert _labels(text) == [label]


def _digest(found):
    return rows(found.select("doc_id", "n_words", "n_hit", F.size("items"), decontam.items_digest(F.col("items")), F.col("n_hit") > 0))


@pytest.mark.parametrize("pass_bytes", [1 << 30, 40])
def test_decontamination(spark, odd, odd_texts, pass_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "de", "é"])
    items = [("i1", "The GNU general public license gnu"), ("i2", "same"), ("i3", None), ("i4", ""), ("i5", "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10"), ("i2", "here")]
    items += [(f"r{i}", " ".join(word() for _ in range(rng.randint(1, 14)))) for i in range(30)]
    docs = odd_texts + [(100 + i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert _digest(decontam.find_items(df, bench, pass_bytes=pass_bytes)) == sorted(brute.contamination(docs, items), key=repr)


def test_decontamination_without_items_and_documents(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_items(odd, none).where("n_hit > 0").count() == 0
    assert decontam.find_items(empty, none).count() == 0
    assert decontam.remove_contaminated(odd, none).columns == odd.columns
    assert decontam.remove_contaminated(odd, none).count() == odd.count()


def _removed(df, length, **options):
    found = substring.remove_repeats(df, length=length, **options).select("k1", "k2", "n_words", "n_removed", F.sha2("kept", 256).alias("h"))
    return rows(substring.per_document(df, found, [F.col("doc_id")]).select("row.doc_id", "n_words", "n_removed", "h"))


@pytest.mark.parametrize("length,group_rows", [(35, 20_000), (35, 3), (7, 3), (1, 20_000)])
def test_repeated_passages(spark, odd_texts, length, group_rows):
    rng = random.Random(8)
    word = lambda: rng.choice(["aa", "b", "the", "ññ", "X."])
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(d, t if t is None or len(t) < 20_000 else t[:9000]) for d, t in odd_texts]
    docs += [(50 + i, " ".join(word() for _ in range(rng.randint(0, 90)))) for i in range(30)]
    docs += [(200 + i, f"x{i} y{i} {passage}\tz{i}") for i in range(40)]
    docs += [(300, " ".join(f"u{i}" for i in range(34))), (301, " ".join(f"u{i}" for i in range(35)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert _removed(df, length, group_rows=group_rows) == sorted(brute.repeats(docs, length), key=repr)


def test_suffixes_come_in_order_with_their_common_prefixes():
    rng = random.Random(2)
    for length in (1, 2, 4):
        rows_ = [[rng.randint(0, 2) for _ in range(rng.randint(0, 12))] for _ in range(6)]
        first = np.cumsum([0] + [len(r) for r in rows_])
        forest = substring.SuffixForest.build(np.array(sum(rows_, []), np.int64), first, length)
        flat = {int(first[k]) + i: r[i:] for k, r in enumerate(rows_) for i in range(len(r) - length + 1)}
        assert sorted(forest.starts.tolist()) == sorted(flat)
        shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert forest.common.tolist() == [shared(flat[a], flat[b]) for a, b in zip(forest.starts.tolist(), forest.starts[1:].tolist())]
        want = {}  # the words of every internal node, with the places below it
        for a in flat:
            for b in flat:
                d = shared(flat[a], flat[b])
                if a != b and d >= length:
                    want[tuple(flat[a][:d])] = {c for c in flat if flat[c][:d] == flat[a][:d]}
        got = {tuple(flat[int(forest.starts[x])][:d]): set(forest.starts[x:y].tolist()) for d, x, y in forest.nodes(length)}
        assert got == want


def test_maximal_repeats(spark):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([f"x{i}"] * (i % 3) + passage[i % 5:] + [f"y{i}", "the", "end"] * (i % 2)) for i in range(8)]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    length = 7
    found = substring.maximal_repeats(df, length=length)
    keys = {(r["k1"], r["k2"]): r["doc_id"] for r in df.select("doc_id", *[k.alias(n) for k, n in zip(text_key(F.col("text")), ("k1", "k2"))]).collect()}
    split, at = [t.split() for t in texts], {}
    for r in found.collect():
        at.setdefault(tuple(r["words"].split()), set()).add((keys[r["k1"], r["k2"]], r["low"]))
    windows = {}
    for d, w in enumerate(split):
        for i in range(len(w) - length + 1):
            windows.setdefault(tuple(w[i: i + length]), []).append((d, i))
    for words, places in at.items():
        assert len(words) >= length and len(places) > 1 and all(split[d][i: i + len(words)] == list(words) for d, i in places)
    covered = {(d, i) for words, places in at.items() for d, low in places for i in range(low, low + len(words) - length + 1)}
    assert covered == {p for places in windows.values() if len(places) > 1 for p in places}


def test_drop_repeats_keeps_columns_and_clean_texts(odd, odd_texts, empty):
    out = substring.drop_repeats(odd.where("doc_id < 6 or doc_id in (9, 12)"))
    assert out.columns == odd.columns
    assert rows(out.select("doc_id", "text")) == sorted(((d, t) for d, t in odd_texts if d is not None and (d < 6 or d in (9, 12))), key=repr)
    assert substring.drop_repeats(empty).count() == 0


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_drop_repeats_shuffles_texts_twice(spark, group_rows):
    """Once to the search and once to the repeated starts; the texts without them are not shuffled again."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"x{i}  y{i} {passage}\tz{i}", "a") for i in range(40)] + [(50, passage, "b"), (51, "clean  text", "c"), (None, None, "d"), (52, "same " * 40, "e"), (52, "same " * 40, "e")]
    out = substring.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string, row string").repartition(4), group_rows=group_rows)
    want = [(i, f"x{i} y{i} z{i}", "a") for i in range(40)] + [(51, "clean  text", "c"), (None, None, "d")]
    assert rows(out) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("first(text") == (1 if group_rows > 3 else 0) and "n_removed" not in plan


def _edit_distance_ends(pattern, text):
    """Fewest edits of the pattern against any stretch that ends at each place of a text (edit-distance table)."""
    row = list(range(len(pattern) + 1))
    out = [row[-1]]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
        out.append(row[-1])
    return out


def test_notices_are_within_their_bound_by_an_edit_distance_table():
    """Every reported span has the edits it says, and where the whole table allows no match of a label none is reported."""
    rng = random.Random(9)
    search = license_scan.NoticeSearch(license_scan.NOTICES, 10)
    for _ in range(60):
        label, notice = rng.choice(license_scan.NOTICES)
        letters = list(notice)
        for at in rng.sample(range(len(letters)), rng.randint(0, len(letters) // 6)):
            letters[at] = rng.choice(["", "x", letters[at] + "e"])
        text = "some words before " + "".join(letters) + " and some behind"
        for found, start, end, edits, length in search.find(text):
            texts = [t for l, t in license_scan.NOTICES if l == found and len(t) == length]
            assert any(_edit_distance_ends(t, text[start:end])[-1] <= edits for t in texts) and edits <= max(1, length // 10)
        best = {l: min(min(_edit_distance_ends(t, text)) / max(1, len(t) // 10) for k, t in license_scan.NOTICES if k == l) for l, _ in license_scan.NOTICES}
        assert all(best[f[0]] <= 1 for f in search.find(text))
        if "".join(letters) == notice:
            assert label in {f[0] for f in search.find(text)}


def test_long_rows_of_notices_cost_in_proportion():
    notice = license_scan.NOTICES[0][1]
    search = license_scan.NoticeSearch(license_scan.NOTICES, 10)
    for n in (3, 200):
        found = search.find(f"{notice} " * n)
        assert len(found) == n and len({f[1] for f in found}) == n and all(f[3] == 0 for f in found)
