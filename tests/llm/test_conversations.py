"""Repair and formatting of conversations against plain versions."""

import hashlib
import random
import re
import uuid

import brute
import public_tokenizers
import pytest
from conftest import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heatgrid.llm import chat_format, repair
from heatgrid.llm.common import shared_folder

KIND = "conv_id bigint, turn bigint, role string, text string"


def _conversations(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in sorted(rng.choice([None, *range(longest)]) or 0 for _ in range(rng.randint(1, longest))):
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", "Why? \n", "a\nb.", "x:y."])
            out.append((c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice([text, text, None])))
    return out


def _want(data, chosen=None):
    by = {}
    for r in brute.damaged(data):
        by.setdefault(r[0], []).append(r)
    return sorted(((c, *brute.repair(by.get(c, []))) for c in {r[0] for r in (chosen or data)}), key=repr)


@pytest.mark.parametrize("chunk", [256, 1, 3])
def test_repair_by_agenda(spark, chunk):
    data = _conversations(chunk, 60, 7) + _conversations(9, 3, 60)[:150] + [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (77, None, "user", None), (78, None, None, None)]
    df = spark.createDataFrame(data, KIND).withColumn("conv", F.lit("x")).withColumn("audit", F.lit(1)).repartition(3)
    assert rows(repair.repair_report(repair.damage(df), chunk=chunk, all_conversations=df)) == _want(data)


def test_agenda_finds_the_cheapest_of_all_edits():
    rng = random.Random(4)
    for _ in range(60):
        data = [(0, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["A.", "B.", "c", ""])) for t in range(rng.randint(0, 3))]
        marks = [(r[2][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(brute.ordered(data), brute.faults(brute.ordered(data)))]
        cost, _, audit = repair.chunk_spans(marks, [repair.START], {repair.START, repair.ASSISTANT})[repair.START, -1]
        assert (cost, audit) == brute.cheapest_by_trial(data)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_spans_of_chunks_join_to_the_whole(size):
    rng = random.Random(size)
    for _ in range(40):
        marks = [(rng.choice("suasux"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 23))]
        whole = repair.chunk_spans(marks, [repair.START], {repair.START, repair.ASSISTANT})[repair.START, -1]
        parts = [repair.chunk_spans(marks[i: i + size], range(4)) for i in range(0, len(marks), size)]
        assert repair.join_spans(parts) == whole


def test_one_conversation_with_most_rows_is_cut_into_chunks(spark):
    data = [(5, t, "user" if t % 2 else "assistant", f"said {t % 50}.") for t in range(3000)] + _conversations(2, 20, 5)
    df = spark.createDataFrame(data, KIND).repartition(6)
    assert rows(repair.repair_report(df, chunk=64)) == sorted(((c, *brute.repair([r for r in [(a, b, d or " ", e if e is not None else " ") for a, b, d, e in data] if r[0] == c]))
                                                                for c in {r[0] for r in data}), key=repr)


def test_repaired_rows_and_empty_table(spark):
    data = [(1, 0, "assistant", "Hello."), (1, 1, "user", "One."), (1, 1, "user", "One."), (2, 0, "user", " ")]
    df = spark.createDataFrame(data, KIND)
    repairs = repair.find_repairs(df)
    said = [f"{r['role']}:{r['text']}" for r in sorted(repair.repaired_rows(df, repairs).where("conv_id = 1").collect(), key=lambda r: r["place"])]
    assert hashlib.sha256("\n".join(said).encode()).hexdigest() == brute.repair(data[:3])[7] and repair.repaired_rows(df, repairs).where("conv_id = 2").count() == 0
    assert {(r["conv_id"], r["audit"]) for r in repairs.collect()} == {(1, brute.repair(data[:3])[6]), (2, "D")}
    assert repair.repair_report(df.limit(0)).count() == 0


CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]", "<|endoftext|>"]
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "s>", "INST]", " a", "/s>", "é", "\n"]), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_escape_goes_both_ways_and_leaves_no_control_string(text):
    escape = chat_format.Escape(CONTROL)
    safe = escape(text)
    assert escape.undo(safe) == text and not any(c in safe for c in CONTROL)
    assert (safe == text) == (not re.search(r"<\\*(s>|/s>|\|endoftext\|>)|\[\\*(INST\]|/INST\]|SYS\]|/SYS\]|ROLE\]|/ROLE\]|/TURN\])", text))


def _chats():
    rng = random.Random(6)
    parts = [*CONTROL, "\\", " hello", " world. ", "\n", "[\\INST]", "<\\\\/s>", "中文", "😀", "é", "  ", "\x00"]
    roles = ["user", "assistant", "system", "tool", "[INST]", "", None, "user\\"]
    data = [(c, t, rng.choice(roles), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for c in range(40) for t in range(rng.randint(1, 6))]
    data += [(50, t, "assistant" if t % 2 else "user", f"turn {t}</s>" * 20) for t in range(700)]  # most rows are one conversation
    return data + [(51, 0, "assistant", "word " * 9000), (52, 0, "user", None), (None, 0, "assistant", "no id"), (53, None, "user", "first"), (53, 0, "assistant", "second"), (53, 0, "assistant", "second")]


@pytest.mark.parametrize("record", [1 << 16, 100])
def test_chats_go_both_ways(spark, record):
    data = _chats()
    df = spark.createDataFrame(data, KIND).withColumn("ids", F.lit("x")).withColumn("conv", F.lit(1)).withColumn("part", F.lit(2)).repartition(5)
    path = f"{shared_folder(spark)}/chats-{uuid.uuid4().hex}"
    chat_format.write_chats(df, BYTES, path, record=record)
    stored = spark.read.parquet(path)
    assert stored.where(F.size("ids") > record).isEmpty() and stored.where("size(ids) != size(loss)").isEmpty()
    want = []
    for c in {r[0] for r in data}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in data if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))]
        loss = "".join(t for r, t in turns if r == "assistant")
        escape = chat_format.Escape(CONTROL)
        shape = {"user": "<s>[INST]{}[/INST]", "assistant": "{}</s>", "system": "[SYS]{}[/SYS]"}
        formatted = "".join(shape.get(r, "[ROLE]" + escape(r) + "[/ROLE]{}[/TURN]").replace("{}", escape(t)) for r, t in turns)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((c, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(formatted)))
    assert rows(chat_format.read_digests(spark, path, BYTES)) == sorted(want, key=repr)
    back = sorted(chat_format.read_turns(spark, path, BYTES).where("conv_id = 53").collect(), key=lambda r: r["n"])
    assert [(r["role"], r["text"], r["learned"]) for r in back] == [("user", "first", ""), ("assistant", "second", "second"), ("assistant", "second", "second")]


def test_texts_are_encoded_as_the_library_does_and_never_give_control_ids():
    form = chat_format.Format(BYTES, chat_format.ChatTemplate())
    library = Tokenizer.from_file(BYTES)
    for _, _, role, text in _chats()[:120]:
        ids, begin, end = form.turn(role or "", text or "")
        assert ids[begin:end].tolist() == library.encode(form.escape(text or ""), add_special_tokens=False).ids and (ids[begin:end] < 50256).all()


def test_no_chats(spark):
    path = f"{shared_folder(spark)}/chats-{uuid.uuid4().hex}"
    chat_format.write_chats(spark.createDataFrame([], KIND), BYTES, path)
    assert chat_format.read_digests(spark, path, BYTES).count() == 0
