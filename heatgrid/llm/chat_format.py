"""Chat formatting at the level of tokens, with loss masks, and the way back.

A template marks turns by control strings. They are never tokenised: every control string has an id of its own behind the
tokenizer's vocabulary. Texts are encoded each for itself and the reserved ids are spliced in between, so no token crosses a
turn's edge and no text can produce a control id. A control string (or special string of the tokenizer) inside a text
gets a backslash behind its first character, and one that already has backslashes there gets one more, so the way back
takes exactly one away. The loss mask is the running sum of +1 where a learned text begins and -1 where it ends.

On a cluster. Rows are range-sorted by (conversation, turn), so a conversation may be spread over tasks. Each task encodes the turns it
meets, appends them to records of at most `RECORD` tokens and writes them. Reading back,
conversations of one record are decoded where they lie, the records of longer ones are brought together in order and
decoded one after the other; a task holds one turn's text.

Defined results: null texts and roles are empty; rows of one turn are ordered by role and by a hash of the text, null turns come
first; roles other than user, assistant and system are written out between control ids; repeated rows are turns of
their own; null conversation ids are one conversation; an empty table gives no records. Only the four columns are read, others cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from heatgrid.llm.tokens import Encoder

RECORD = 1 << 16
WORDS = 20_000  # a task remembers the ids of that many words


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings before and behind a turn's text, by role; `learned` roles are under the loss mask."""

    marks: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=lambda: {"user": (("<s>", "[INST]"), "[/INST]"), "assistant": ((), "</s>"), "system": (("[SYS]",), "[/SYS]")})
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")  # before and behind another role's name, behind its text
    learned: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        """All control strings; their places are their ids, counted from the end of the vocabulary."""
        return list(dict.fromkeys([*(c for opens, close in self.marks.values() for c in (*opens, close)), *self.named]))


class Escape:
    """Reversible escaping of strings in texts, by one more backslash behind their first character."""

    def __init__(self, strings: list[str]):
        first = {s[0] for s in strings}
        if any(c in s[1:] or c == "\\" for s in strings for c in first) or any(s[1:2] in ("", "\\") for s in strings):
            raise ValueError("a control string must not hold a first character of another one, nor begin with a backslash")
        places = "|".join(f"{re.escape(c)}(?=\\\\*(?:{'|'.join(re.escape(s[1:]) for s in strings if s[0] == c)}))" for c in sorted(first))
        self._add = re.compile(f"({places})")
        self._take = re.compile(f"({places})\\\\")

    def __call__(self, text: str) -> str:
        return self._add.sub(r"\1\\", text)

    def undo(self, text: str) -> str:
        return self._take.sub(r"\1", text)


class Format:
    """Turns to ids and back, for one tokenizer and template."""

    def __init__(self, path: str, template: ChatTemplate):
        self.encoder, self.template = Encoder(path, WORDS), template
        controls = template.controls()
        base = self.encoder.tokenizer.get_vocab_size()
        self.base, self.strings = base, controls
        self.number = {c: base + k for k, c in enumerate(controls)}
        self.kind = np.dtype("<u4")
        self.escape = Escape(controls + self.encoder.special)
        letters = {c: b for b, c in self.encoder.letters.items()}
        self.bytes = [b""] * base
        for piece, k in self.encoder.tokenizer.get_vocab().items():
            self.bytes[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        # what an opening id says: a role, or that a role's name follows
        self.opens = {self.number[opens[-1]]: role for role, (opens, _) in template.marks.items() if opens}
        self.silent = next((role for role, (opens, _) in template.marks.items() if not opens), None)
        self.closes = {self.number[close] for _, close in template.marks.values()} | {self.number[template.named[2]]}

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.ids(self.escape(text)), self.encoder.kind).astype(self.kind)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """The turn's ids, and where its text begins and ends in them."""
        said = self._ids(text)
        if role in self.template.marks:
            opens, close = self.template.marks[role]
            before = np.array([self.number[c] for c in opens], self.kind)
        else:
            open_, middle, close = self.template.named
            before = np.concatenate([np.array([self.number[open_]], self.kind), self._ids(role), np.array([self.number[middle]], self.kind)])
        ids = np.concatenate([before, said, np.array([self.number[close]], self.kind)])
        return ids, len(before), len(before) + len(said)


_formats: dict[tuple[str, str], Format] = {}


def format_of(path: str, template: ChatTemplate) -> Format:
    """One for all tasks of a worker process."""
    key = (path, repr(template))
    if key not in _formats:
        _formats.clear()
        _formats[key] = Format(path, template)
    return _formats[key]


class Reader:
    """Decodes one conversation's records in order; `turns` yields (role, text, learned text, characters of the formatted text)."""

    def __init__(self, form: Format):
        self.form, self.role, self.name, self.held, self.learned, self.chars = form, None, False, [], [], 0

    def turns(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
        form, table = self.form, self.form.bytes
        cuts = np.flatnonzero(ids >= form.base)
        at = 0
        for cut in [*cuts.tolist(), len(ids)]:
            if cut > at:
                if self.role is None and not self.name:
                    self.role = form.silent
                span, under = ids[at:cut].tolist(), mask[at:cut]
                self.held.append(b"".join([table[i] for i in span]))
                if under.any():
                    self.learned.append(self.held[-1] if under.all() else b"".join([table[i] for i, m in zip(span, under.tolist()) if m]))
            if cut == len(ids):
                break
            control = int(ids[cut])
            self.chars += len(form.strings[control - form.base])
            if mask[cut]:
                self.learned.append(form.strings[control - form.base].encode())
            if control in form.opens:
                self.role = form.opens[control]
            elif control == form.number[form.template.named[0]]:
                self.name = True
            elif control == form.number[form.template.named[1]]:
                self.role, self.name = self._text(self.held), False
                self.held = []
            elif control in form.closes:
                role = form.silent if self.role is None else self.role
                text = self._text(self.held)
                yield role, text, form.escape.undo(b"".join(self.learned).decode()), self.chars
                self.role, self.held, self.learned, self.chars = None, [], [], 0
            at = cut + 1

    def _text(self, parts: list[bytes]) -> str:
        text = b"".join(parts).decode()
        self.chars += len(text)
        return self.form.escape.undo(text)


class _Records:
    """Rows of the output, gathered into batches."""

    def __init__(self, conv_type: pa.DataType, part: int):
        self.schema = pa.schema([("conv", conv_type), ("part", pa.int32()), ("place", pa.int64()), ("whole", pa.bool_()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])
        self.part, self.place, self.rows, self.size = part, 0, [], 0

    def add(self, conv, whole: bool, ids: np.ndarray, mask: np.ndarray) -> None:
        self.rows.append((conv, whole, ids, mask, self.place))
        self.place += 1
        self.size += len(ids)

    def take(self) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in self.rows])]).astype(np.int32)
        ids, mask = np.concatenate([r[2] for r in self.rows]).astype(np.int32), np.concatenate([r[3] for r in self.rows])
        n = len(self.rows)
        batch = pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in self.rows], self.schema.field("conv").type), pa.array(np.full(n, self.part, np.int32)), pa.array([r[4] for r in self.rows], pa.int64()),
            pa.array([r[1] for r in self.rows]), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(mask)),
        ], schema=self.schema)
        self.rows, self.size = [], 0
        return batch


def _assembling(tokenizer_file: str, template: ChatTemplate, record: int, conv_type: pa.DataType):
    """Sorted turns to records of one conversation each, at most `record` tokens long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = format_of(tokenizer_file, template)
        out = _Records(conv_type, TaskContext.get().partitionId())
        conv, started, inside, pieces, held, size = None, False, False, False, [], 0

        def flush(ended: bool) -> None:
            """The turns held become records; with `ended` the conversation's last ones, else only full ones."""
            nonlocal held, size, pieces
            if not held:
                return
            ids = np.concatenate([h[0] for h in held])
            offset = np.cumsum([0] + [len(h[0]) for h in held])[:-1]
            change = np.zeros(len(ids) + 1, np.int32)
            for at, (_, begin, end, learned) in zip(offset.tolist(), held):
                if learned:
                    change[at + begin] += 1
                    change[at + end] -= 1
            mask = np.cumsum(change)[:-1] > 0
            for at in range(0, len(ids), record):
                last = at + record >= len(ids)
                out.add(conv, ended and last and inside and not pieces, ids[at: at + record], mask[at: at + record])
                pieces = True
            held, size = [], 0

        for batch in batches:
            for c, role, text in zip(*[batch.column(k).to_pylist() for k in ("conv", "role", "text")]):
                if not started or c != conv:
                    if started:
                        flush(True)
                    conv, inside, pieces, started = c, started, False, True
                turn, begin, end = form.turn(role, text)
                if size and size + len(turn) > record:
                    flush(False)
                held.append((turn, begin, end, role in template.learned))
                size += len(turn)
                if out.size > 1 << 19:
                    yield out.take()
        if started:
            inside = False  # it may go on in the next task
            flush(True)
        if out.rows:
            yield out.take()

    return run


def assemble(df: DataFrame, tokenizer_file: str, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             record: int = RECORD) -> DataFrame:
    """(conv, part, place, whole, ids, loss): token ids and loss mask of all conversations, one or more records each, in the order of
    (part, place). `tokenizer_file` is a path that exists on every executor."""
    from pyspark.sql.pandas.types import to_arrow_type

    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    order = ["conv", "turn", "role", "tie"]
    placed = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text")
    kind = rows.schema["conv"].dataType
    out = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL("part int, place bigint, whole boolean, ids array<int>, loss array<boolean>").fields])
    return placed.mapInArrow(_assembling(tokenizer_file, template, record, to_arrow_type(kind)), out).withColumnRenamed("conv", conv)


def write_chats(df: DataFrame, tokenizer_file: str, path: str, **options) -> None:
    """Writes the assembled records as a Parquet table."""
    assemble(df, tokenizer_file, **options).write.mode("error").parquet(path)


def _reading(tokenizer_file: str, template: ChatTemplate, emit, schema: pa.Schema):
    """`emit(conv, turns)` for the turns of each conversation, from records in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = format_of(tokenizer_file, template)

        def turns() -> Iterator[tuple]:
            conv, reader = None, None
            for batch in batches:
                ids, loss = batch.column("ids"), batch.column("loss")
                bounds = ids.offsets.to_numpy() - (ids.offsets[0].as_py() if len(ids) else 0)
                all_ids, all_loss = ids.flatten().to_numpy(), loss.flatten().to_numpy(zero_copy_only=False)
                for i, c in enumerate(batch.column("conv").to_pylist()):
                    if reader is None or c != conv:
                        if reader is not None:
                            yield conv, None
                        conv, reader = c, Reader(form)
                    for found in reader.turns(all_ids[bounds[i]: bounds[i + 1]], all_loss[bounds[i]: bounds[i + 1]]):
                        yield conv, found
            if reader is not None:
                yield conv, None

        rows = []
        for row in emit(turns()):
            rows.append(row)
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _read(spark: SparkSession, path: str, tokenizer_file: str, template: ChatTemplate, emit, columns: str, conv: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    records = spark.read.parquet(path).withColumnRenamed(conv, "conv")
    schema = T.StructType([records.schema["conv"], *T.StructType.fromDDL(columns).fields])
    work = _reading(tokenizer_file, template, emit, to_arrow_schema(schema))
    whole = records.where("whole").select("conv", "ids", "loss").mapInArrow(work, schema)
    parts = records.where("NOT whole").repartition("conv").sortWithinPartitions("conv", "part", "place")
    return whole.unionByName(parts.select("conv", "ids", "loss").mapInArrow(work, schema)).withColumnRenamed("conv", conv)


def read_turns(spark: SparkSession, path: str, tokenizer_file: str, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id") -> DataFrame:
    """(conv, n, role, text, learned): the turns back from the records, `learned` is what the loss mask covers."""

    def emit(found: Iterator[tuple]) -> Iterator[dict]:
        n = 0
        for c, turn in found:
            if turn is None:
                n = 0
            else:
                yield {"conv": c, "n": n, "role": turn[0], "text": turn[1], "learned": turn[2]}
                n += 1

    return _read(spark, path, tokenizer_file, template, emit, "n bigint, role string, text string, learned string", conv)


def read_digests(spark: SparkSession, path: str, tokenizer_file: str, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from the records."""

    def emit(found: Iterator[tuple]) -> Iterator[dict]:
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        held = fresh()
        for c, turn in found:
            if turn is None:
                yield {"conv": c, "n_turns": held[0], "turns_sha256": held[1].hexdigest(), "loss_chars": held[2], "loss_sha256": held[3].hexdigest(), "formatted_chars": held[4]}
                held = fresh()
                continue
            role, text, learned, chars = turn
            held[0] += 1
            held[1].update(f"{role}\n{text}\n".encode())
            held[2] += len(learned)
            held[3].update(learned.encode())
            held[4] += chars

    return _read(spark, path, tokenizer_file, template, emit, "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint", conv)
