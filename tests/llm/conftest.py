import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, very long, tied, repeated and non-Latin texts; ids repeat and may be null."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "The GNU General Public License, gnu general public LICENSE"), (6, long), (7, long), (8, "é" * 300),
        (9, "中文 字符 😀 test"), (10, "same text here"), (10, "same text here"), (11, "same text here"), (12, "!!! ???"), (None, "no id at all"), (13, "\x00a\x00 b\x7f"),
        (14, "ha " * 5000), (15, "<|endoftext|> <s> </s>"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The same as a table, with columns named like the operators' own."""
    extra = "id bigint, row string, key int, score double, words string, part int, piece int, spans string, k1 string, node string, label string"
    names = [c.split()[0] for c in extra.split(", ")]
    data = [(d, t, *([None] * len(names))) for d, t in odd_texts]
    return spark.createDataFrame(data, f"doc_id bigint, text string, {extra}").repartition(4)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
