"""Token counts by a compiled finite-state transducer.

Byte-pair encoding of a growing text is decided by its last token: among the vocabulary pieces that end at a place,
exactly one may follow the encoding of what stands before it, and whether it may depends only on the token before it
and itself. So the encoder is a deterministic transducer. A state holds, for every start at which a piece may still
be open, the place in the piece trie, the token before that start and the tokens emitted since; a transition on a
character says by how much the token count changes. Transitions are compiled when a text first needs them and kept in one hash table of
(state, character class); characters without a piece share one class for each length in bytes. Table and states together stay
within `TABLE_BYTES`: beyond it only the states that a running text is in are kept, in the middle of a text as well.

A text is cut into chunks that run side by side. No piece goes on past a space into a new word, so a chunk's state map
is constant behind its first new word: (tokens and exit state from there on) plus the head before it, which depends
on the state that enters. The scan composes the maps for all chunks at once: every head runs from the exit state of the chunk before it
as known so far, and again where that state has changed, until none does. Runs from different states soon meet in one, so this takes a few rounds
even where a text has no blanks, and never more than there are chunks.

Defined results: null and empty texts have 0 bytes and 0 tokens; characters without a piece count one token per UTF-8
byte; repeated rows are counted each on their own; an empty table gives no rows. Only the id and text columns are
read, other columns cannot clash. A text of any length takes memory in proportion to its own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from heatgrid.llm.common import SLICE_BYTES, map_texts, slices, text_bytes

SPACE = 0x2581  # stands for a blank in pieces
CHUNK = 512
TABLE_BYTES = 96 << 20
STATE_BYTES = 600  # of a state and its number, about
CLASS_BITS = 21
_UNKNOWN = -2  # "the token before" is bytes of a character without a piece
_START = -1  # nothing before matters: a word begins here


class Transducer:
    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank: dict[str, int] = {}
        self.text: list[str] = []
        order = []
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                order.append((-model.get_score(i), i, model.id_to_piece(i)))
        for rank, (_, _, piece) in enumerate(sorted(order)):
            self.rank[piece] = rank
            self.text.append(piece)
        blank = chr(SPACE)
        if any(blank in p.lstrip(blank) for p in self.text):
            raise ValueError("pieces that go on past a blank are not supported")
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[int] = [-1]
        for piece, rank in self.rank.items():
            if self._encode(piece) != [rank]:
                continue  # never the outcome of merging, so never a token
            node = 0
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.piece.append(-1)
                node = self.children[node][c]
            self.piece[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.class_of = np.full(0x110000, -1, np.int32)
        self.chars: list[str] = []
        self.known = {c for children in self.children for c in children}
        self.plain: dict[int, int] = {}  # bytes of a character without a piece -> class
        self.held: list[np.ndarray] = []  # arrays of state numbers in use
        self.reset_tables()

    def _encode(self, text: str) -> list[int]:
        """Merging by rank, leftmost first, for the short strings that the compilation asks about."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return [self.rank.get(p, _UNKNOWN) for p in parts]
            i = best[1]
            parts[i: i + 2] = [parts[i] + parts[i + 1]]

    def _may_follow(self, before: int, token: int) -> bool:
        if before < 0:
            return True
        known = self.pairs.get((before, token))
        if known is None:
            known = self.pairs[before, token] = self._encode(self.text[before] + self.text[token]) == [before, token]
        return known

    def reset_tables(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.bits, self.filled = 14, 0
        self._empty_table()
        blank = self.children[0].get(chr(SPACE))
        opened = [(blank, _START, -1)] if blank is not None else []
        self.word_start = self._number(tuple([*opened, (0, self.piece[blank] if blank is not None else _UNKNOWN, 0)]))
        if len(self.pairs) > 500_000:
            self.pairs.clear()

    def _empty_table(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        self.change = np.zeros(1 << self.bits, np.int8)

    def bytes(self) -> int:
        return len(self.states) * STATE_BYTES + 13 * len(self.keys)

    def compact(self) -> None:
        """Forgets all states but those in use, which get new numbers."""
        used = np.unique(np.concatenate([[-1], *self.held]))[1:]  # -1 stands for no state
        kept = [self.states[n] for n in used.tolist()]
        self.reset_tables()
        numbers = np.array([-1, *[self._number(s) for s in kept]], np.int64)
        for array in self.held:
            array[:] = numbers[np.searchsorted(used, array, side="right")]

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, key: int, to: int, change: int) -> None:
        if self.filled * 3 >= len(self.keys):
            old = self.keys >= 0
            keys, to_, change_ = self.keys[old], self.next[old], self.change[old]
            self.bits += 1
            self._empty_table()
            slot, left = self._slots(keys), np.arange(len(keys))
            while len(left):
                _, first = np.unique(slot[left], return_index=True)
                takes = np.zeros(len(left), bool)
                takes[first] = True
                takes &= self.keys[slot[left]] < 0
                own = left[takes]
                self.keys[slot[own]], self.next[slot[own]], self.change[slot[own]] = keys[own], to_[own], change_[own]
                left = left[~takes]
                slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        slot = ((key * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> 64 - self.bits
        while self.keys[slot] >= 0:
            slot = (slot + 1) & (len(self.keys) - 1)
        self.keys[slot], self.next[slot], self.change[slot] = key, to, change
        self.filled += 1

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys, and which keys are not in the table."""
        slot = self._slots(keys)
        there = self.keys[slot]
        left = np.flatnonzero(there != keys)
        missing = []
        while len(left):
            gone = self.keys[slot[left]] < 0
            missing.append(left[gone])
            left = left[~gone]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            left = left[self.keys[slot[left]] != keys[left]]
        return slot, np.concatenate(missing) if missing else left

    def classes(self, codes: np.ndarray) -> np.ndarray:
        found = self.class_of[codes]
        if (found < 0).any():
            for code in np.unique(codes[found < 0]).tolist():
                c = chr(code)
                own = self.plain.get(len(c.encode())) if c not in self.known else None
                if own is None:
                    own = len(self.chars)
                    self.chars.append(c)
                    if c not in self.known:
                        self.plain[len(c.encode())] = own
                self.class_of[code] = own
            found = self.class_of[codes]
        return found

    def _compile(self, number: int, kind: int) -> None:
        c, state = self.chars[kind], self.states[number]
        alive, token, change = [], None, 0
        for node, before, since in state:  # `since`: the count at that start, less the count now
            child = self.children[node].get(c)
            if child is not None:
                if ord(c) == SPACE and node == 0:
                    if all(n == 0 or self.piece[n] < 0 or self.text[self.piece[n]].strip(chr(SPACE)) for n, _, _ in state):
                        before = _START  # a new word: what stands before no longer matters
                alive.append((child, before, since))
                piece = self.piece[child]
                if token is None and piece >= 0 and self._may_follow(before, piece):
                    token, change = piece, since + 1
        if token is None:
            alive, token, change = [], _UNKNOWN, len(c.encode())
        after = tuple([*((n, b, s - change) for n, b, s in alive if self.children[n]), (0, token, 0)])
        fresh = ord(c) == SPACE and len(alive) == 1 and alive[0][1] == _START
        self._put(number << CLASS_BITS | kind, self.word_start if fresh else self._number(after), change)

    def run(self, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lanes side by side: lane i reads `lengths[i]` classes from `starts[i]` on. Tokens and exit states."""
        order = np.argsort(-lengths, kind="stable")
        at, state = starts[order], states[order].astype(np.int64)
        sizes = lengths[order]
        count = np.zeros(len(order), np.int64)
        self.held.append(state)
        active = len(order) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), side="right")
        for step, n in enumerate(active.tolist()):
            kind = classes[at[:n] + step]
            key = state[:n] << CLASS_BITS | kind
            slot, missing = self._find(key)
            while len(missing):
                if self.bytes() > TABLE_BYTES and len(self.states) > 4 * sum(map(len, self.held)):
                    self.compact()
                    key = state[:n] << CLASS_BITS | kind
                    slot, missing = self._find(key)
                for absent in np.unique(key[missing]).tolist():
                    self._compile(absent >> CLASS_BITS, absent & (1 << CLASS_BITS) - 1)
                slot, missing = self._find(key)
            count[:n] += self.change[slot]
            state[:n] = self.next[slot]
        self.held.pop()
        tokens, out = np.empty_like(count), np.empty_like(state)
        tokens[order], out[order] = count, state
        return tokens, out

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if self.bytes() > TABLE_BYTES:
            self.reset_tables()
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(t) for t in texts], np.int64)
        total = np.zeros(len(texts), np.int64)
        if not len(codes):
            return total
        codes = np.where(codes == 0x20, np.uint32(SPACE), codes)
        begin = np.cumsum(length) - length
        classes = self.classes(codes)
        blank = codes == SPACE
        fresh = blank.copy()
        fresh[1:] &= ~blank[:-1]
        fresh[begin[length > 0]] = False  # the blank put before every text makes this a second one
        words = np.append(np.flatnonzero(fresh), len(codes))
        each = -(-length // CHUNK)
        doc = np.repeat(np.arange(len(texts)), each)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
        start = begin[doc] + number * CHUNK
        end = np.minimum(start + CHUNK, begin[doc] + length[doc])
        word = words[np.searchsorted(words, start)]
        whole_head = (word >= end) & (number > 0)
        head_end = np.where(number == 0, start, np.minimum(word, end))
        tail = np.where(number == 0, start, np.minimum(head_end + 1, end))
        first = np.full(len(doc), self.word_start)
        behind, exits = self.run(classes, tail, end - tail, first)  # a chunk that is head alone has no tail yet
        behind += ~whole_head  # the blank at the start of the tail
        self.held.append(exits)
        headed = np.flatnonzero((number > 0) & (head_end > start))
        alone = np.flatnonzero(whole_head)
        _, exits[alone] = self.run(classes, start[alone], (head_end - start)[alone], np.full(len(alone), self.word_start))  # a first guess
        ahead = np.zeros(len(doc), np.int64)
        entered = np.full(len(doc), -1)
        self.held.append(entered)
        while len(todo := headed[exits[headed - 1] != entered[headed]]):
            entered[todo] = exits[todo - 1]
            tokens, after = self.run(classes, start[todo], (head_end - start)[todo], entered[todo])
            ahead[todo] = tokens
            full = whole_head[todo]
            exits[todo[full]] = after[full]
        del self.held[-2:]
        count = behind + ahead
        np.add.at(total, doc, count)
        return total


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, without begin or end tokens.

    `model_file` is a path that exists on every executor; only the path travels with the task.
    """
    kept: dict[str, Transducer] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "it" not in kept:
            kept["it"] = Transducer(model_file)
        data, offsets = text_bytes(batch.column(1))
        raw = data.tobytes()
        tokens = []
        for a, b in slices(offsets, SLICE_BYTES):
            tokens.append(kept["it"].count([raw[offsets[i]: offsets[i + 1]].decode() for i in range(a, b)]))
        n = np.concatenate(tokens)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = map_texts(docs, {"id": F.col(id_col)}, F.col(text), work,
                    [("id", docs.schema[id_col].dataType), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")])
    return out.withColumnRenamed("id", id_col)
