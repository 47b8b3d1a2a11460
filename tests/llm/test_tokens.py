"""Token counts, packing and token output against the tokenizer libraries."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import rows
from tokenizers import Tokenizer

from heatgrid.llm import packing, token_count, token_output
from heatgrid.llm.common import shared_folder
from heatgrid.llm.tokens import Encoder

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _mixed(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b'", "'s", " ", "\n", "  ", "é", "1", ".", ",", "ab", "The", "!", "\t", "ingly", "中", "😀", "<|endoftext|>", "İ", "▁", " ", "ß"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_transducer_counts_like_the_library(odd_texts, monkeypatch):
    monkeypatch.setattr(token_count, "CHUNK", 7)  # heads and tails of many chunks
    machine, library = token_count.Transducer(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for _, t in odd_texts] + _mixed(500, 1) + ["a" * 300, " " * 300, "x" + " " * 90 + "y"]
    assert machine.count(texts).tolist() == [len(x) for x in library.encode(texts)]
    monkeypatch.setattr(token_count, "TABLE_BYTES", 1)  # tables start anew
    assert machine.count(texts[:30]).tolist() == [len(x) for x in library.encode(texts[:30])]


def test_token_counts(odd, odd_texts, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    n = {t: len(library.encode(t or "")) for _, t in odd_texts}
    want = sorted(((d, len((t or "").encode()), n[t], n[t] > 4096) for d, t in odd_texts), key=repr)
    assert rows(token_count.count_tokens(odd, PIECES)) == want
    assert token_count.count_tokens(empty, PIECES).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_librarys_ids(odd_texts, name):
    path = public_tokenizers.path(name)
    encoder, library = Encoder(path, most_words=50), Tokenizer.from_file(path)
    for text in [t or "" for _, t in odd_texts] + _mixed(1500, 2) + ["don't I'm 'LL", "\n a", " \na", "a\n\n\nb", "Σ aΣ", "x²"]:
        assert np.frombuffer(encoder.ids(text), encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tasks_of_a_worker_share_one_encoder(name):
    from heatgrid.llm.tokens import encoder_of

    path = public_tokenizers.path(name)
    encoder, library = encoder_of(path), Tokenizer.from_file(path)
    assert encoder_of(path) is encoder
    for text in ["Was", "a\nWas b", "\nÄrger, ja", "Wort.\nÉté. x", "a\nx1 y\n1x"]:
        assert np.frombuffer(encoder.ids(text), encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def _ids(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("per_partition", [40_000, 10])
def test_packing(odd, odd_texts, per_partition):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.piece_documents(odd, path)
    want = []
    for d, t in odd_texts:
        ids = _ids(library, t)
        want += [(d, i // 2048, i, len(ids[i: i + 2048]), ids[i: i + 2048].tobytes()) for i in range(0, len(ids), 2048)]
    got = [(d, p, s, n, bytes(b)) for d, p, s, n, b in map(tuple, pieces.collect())]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    packed = packing.pack(pieces.drop("token_ids"), per_partition=per_partition).collect()
    assert sorted(((r["doc_id"], r["piece"], r["length"]) for r in packed), key=repr) == sorted(((w[0], w[1], w[3]) for w in want), key=repr)
    filled = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    assert len(filled) == packing.lower_bound(np.array([r["length"] for r in packed]), 2048)


def test_packing_rounds_reach_the_bound(spark):
    """Small partitions that exchange documents pack as well as one partition with all of them."""
    rng = np.random.default_rng(4)
    sizes = rng.choice([1100, 700, 500, 400, 90, 20], 900).tolist()
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, length long").repartition(6)
    packed = packing.pack(df, per_partition=40)
    assert packed.count() == len(sizes)
    alone = packing.best_fit(np.array(sizes), 2048)[2]
    assert packing.lower_bound(np.array(sizes), 2048) <= packed.select("sequence_id").distinct().count() <= len(alone)


def test_lower_bound_is_one():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = rng.integers(1, 101, rng.integers(1, 40))
        bins, offsets, fill = packing.best_fit(sizes, 100)
        assert fill.max() <= 100 and fill.sum() == sizes.sum()
        assert -(-sizes.sum() // 100) <= packing.lower_bound(sizes, 100) <= len(fill)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 7), 100) == 4  # three of them never share a bin


def test_sequences_hold_the_tokens(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = odd.where("doc_id < 6")
    pieces = packing.piece_documents(docs, path)
    packed = packing.pack(pieces.drop("token_ids"))
    out = packing.sequences(packed, pieces).collect()
    assert sum(r["n_tokens"] for r in out) == sum(r["length"] for r in pieces.collect()) and all(len(r["token_ids"]) == 4 * r["n_tokens"] <= 8192 for r in out)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for gaps in ([], [5], [1] * 300, rng.integers(1, 2000, 1000).tolist(), [1] * 200 + [10**6] + [1] * 200, [0, 0, 7]):
        values = np.cumsum(np.array(gaps, np.int64))
        code = token_output.EliasFano.encode(values)
        assert code.all().tolist() == values.tolist()
        assert [code.select(i) for i in range(len(values))] == values.tolist()
        if len(values) > 500:
            assert (code.low.nbytes + code.high.nbytes) * 8 <= len(values) * (3 + np.log2(values[-1] / len(values)))


@pytest.mark.parametrize("shard_ids", [1 << 22, 500])
def test_token_files(spark, odd, odd_texts, shard_ids):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    token_output.write_token_ids(odd, path, folder, shard_ids=shard_ids)
    back = sorted((r["start"], r["doc_id"], r["n_tokens"], zlib.crc32(bytes(r["token_ids"]))) for r in token_output.read_token_ids(spark, folder).collect())
    assert [d is None for _, d, _, _ in back].index(True) == 0  # null ids come first
    assert [d for _, d, _, _ in back[1:]] == sorted(d for d, _ in odd_texts if d is not None)
    assert [s for s, _, _, _ in back] == np.cumsum([0, *[n for _, _, n, _ in back[:-1]]]).tolist()
    want = sorted(((d, len(i), zlib.crc32(i.tobytes())) for d, t in odd_texts for i in (_ids(library, t),)), key=repr)
    assert sorted((b[1:] for b in back), key=repr) == want
    shard = spark.read.parquet(folder).orderBy("part", "shard").first()
    assert token_output.document_ids(bytes(shard["payload"]), 0)[-1] == 0


def test_token_files_of_nothing(spark, empty):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    token_output.write_token_ids(empty, public_tokenizers.path("byte_bpe_50k.json"), folder)
    assert token_output.read_token_ids(spark, folder).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_many_scripts_keep_the_tables_small(pieces):
    """Twenty thousand different characters, then Latin texts, then a text without blanks: tables stay within their budget."""
    rng = random.Random(3)
    texts = ["".join(map(chr, rng.sample(range(0x4E00, 0x9FFF), 20_000))), "".join(map(chr, range(0x3040, 0x30FF))) * 20, "😀é中\n" * 500]
    texts += [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(300)) for _ in range(60)]
    texts += ["".join(rng.choices("abcdefgh", k=60_000)), "x" * 5000, " " * 700, "a " * 3000, ""]
    machine = token_count.Transducer(PIECES)
    for i in range(0, len(texts), 8):
        assert machine.count(texts[i: i + 8]).tolist() == [len(pieces.encode(t, num_threads=1)) for t in texts[i: i + 8]]
        assert machine.bytes() < 1.2 * token_count.TABLE_BYTES


def test_tables_are_emptied_inside_a_text(pieces, monkeypatch):
    monkeypatch.setattr(token_count, "TABLE_BYTES", 1 << 20)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijkl é", [9] * 12 + [1, 1], k=9000)) for _ in range(12)] + ["".join(rng.choices("etaoin", k=30_000))]
    machine, seen = token_count.Transducer(PIECES), []
    plain = machine.compact
    monkeypatch.setattr(machine, "compact", lambda: (seen.append(1), plain()))
    assert machine.count(texts).tolist() == [len(pieces.encode(t, num_threads=1)) for t in texts]
    assert seen and not machine.held


def test_marked_words_are_known_from_both_generations():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library, merged = Encoder(path, most_words=2), Tokenizer.from_file(path), []
    merge = encoder._merge
    encoder._merge = lambda piece: merged.append(piece) or merge(piece)
    texts = [" uno", " due", " tre", " uno.", " Äpfel,", " Äpfel", " Äpfel."] + [f" a{chr(c)}b {chr(c)} {chr(c)}a, a{chr(c)}." for c in range(0xA1, 0x234)]
    for i, text in enumerate(texts):
        assert np.frombuffer(encoder.ids(text), encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text
        if i == 3:
            assert merged == [" uno", " due", " tre"]


def test_words_before_any_marks_are_merged_once():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library, merged, whole = Encoder(path), Tokenizer.from_file(path), [], []
    merge, ask = encoder._merge, encoder._library
    encoder._merge = lambda piece: merged.append(piece) or merge(piece)
    encoder._library = lambda text: whole.append(text) or ask(text)
    for text in [" uno$$$", " uno", " uno,***", " uno.", " due!", " due$$$ 4310082329322593", " uno$$$ due"]:
        assert np.frombuffer(encoder.ids(text), encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert merged == [" uno", " due", " 4310082329322593"]
    assert whole == ["$$$", ",***", "!"]  # marks alone
    for head in ("a", "ÄRGER", "x²", "¼", "ª", "µm", "Ǆ", "a1", "7", "don't", "a_b", "_", "a\xad"):
        for tail in ("", "_", "\\\\", "'s", "!'s", "[]^`", "{|}~", "!¡", "§", "a!", "1!", "!1", "!²", "\n!", "!\n"):
            for text in (f" {head}{tail}", f"x {head}{tail} {head}{tail}", f"{head}{tail}\n{head}{tail}"):
                assert np.frombuffer(encoder.ids(text), encoder.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text
