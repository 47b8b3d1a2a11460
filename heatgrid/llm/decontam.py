"""Benchmark decontamination: Wu-Manber search for many word windows at once.

The symbols are words. All windows of one length m are searched together: a table over blocks of two words says how
far the search may jump (m - 1 words where a block stands in no window), a block that ends a window sends the search to
the bucket of windows with that suffix, and a window counts only after its words were compared one by one. The search
runs over many stretches of text side by side, each in its own lane.

Windows of an item: every run of `window` consecutive words; a shorter item is one window; an item without words has
none. Each window length is a search of its own, as the jump is bounded by the shortest window of a search.

The windows are held by every task, in groups of bounded size: the words of a group's items, and numbers of places in them. If the benchmark is
larger than one group, the documents are read once per group, each pass is written before the next group is compiled, and the passes' hits are
merged, so no item is ever left out and the driver holds one group at a time.

Defined results: null and empty texts have no words and no hits; items with null text have no windows; repeated item
rows count once in n_items; repeated document rows are judged each on their own; an empty benchmark contaminates
nothing; an empty table gives no rows. Only the named columns are read, other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from heatgrid.llm.common import LETTER_WORDS, LOWER, SAME, Words, equal_words, mix64, slices, text_bytes, word_numbers, written

WINDOW = 10
LANE = 256
PASS_BYTES = 4 << 20  # of item texts in one pass


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


class _Table:
    """A map from 64-bit keys to small numbers, as an open hash table that looks many keys up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int):
        self.bits = max(10, int(len(keys) * 4 - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, default, np.int32)
        self.used = np.zeros(1 << self.bits, bool)
        self.default, self.probes = default, 1
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = ~self.used[slot[left]]
            _, first = np.unique(slot[left], return_index=True)
            takes = np.zeros(len(left), bool)
            takes[first] = True
            takes &= free
            own = left[takes]
            self.keys[slot[own]], self.values[slot[own]], self.used[slot[own]] = keys[own], values[own], True
            left = left[~takes]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        same = self.used[slot] & (self.keys[slot] == keys)
        found = np.where(same, self.values[slot], self.default)
        left = np.flatnonzero(self.used[slot] & ~same)
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            same = self.used[slot[left]] & (self.keys[slot[left]] == keys[left])
            found[left[same]] = self.values[slot[left[same]]]
            left = left[~same & self.used[slot[left]]]
        return found


@dataclass
class Items:
    """The words of a group of items, and the ids that item numbers stand for."""

    data: np.ndarray  # folded bytes
    words: Words
    ids: list


@dataclass
class WindowSearch:
    """The different windows of m words: where each stands in the items' words, the items it stands in, and the tables of the search."""

    m: int
    group: Items
    at: np.ndarray  # first word of each window
    item_starts: np.ndarray  # window w stands in the items item_numbers[item_starts[w]:item_starts[w + 1]]
    item_numbers: np.ndarray
    shift: _Table | None  # block -> jump
    bucket: _Table  # suffix block (m > 1) or word -> bucket
    starts: np.ndarray  # bucket b holds the windows order[starts[b]:starts[b + 1]]
    order: np.ndarray

    @classmethod
    def compile(cls, m: int, group: Items, numbers: np.ndarray, at: np.ndarray, owner: np.ndarray) -> WindowSearch:
        """Windows that begin at the words `at` of the items `owner`; `numbers` tell words apart."""
        heads = at[np.append(True, np.diff(at) != 1)]  # the first window of each item
        window = numbers[at]
        for j in range(1, m):
            window = np.unique(window * np.int64(len(numbers) + 1) + numbers[at + j], return_inverse=True)[1]
        _, first, window = np.unique(window, return_index=True, return_inverse=True)
        pairs = np.unique(window * np.int64(len(group.ids)) + owner)
        item_starts = np.searchsorted(pairs // len(group.ids), np.arange(len(first) + 1))
        at, h = at[first], group.words.hash
        shift = None
        if m > 1:
            # a block ends the window that begins m - 1 words before; near the start of an item it stands in its first window only
            blocks = np.concatenate([_block(h[at + m - 2], h[at + m - 1]), *[_block(h[heads + j - 1], h[heads + j]) for j in range(1, m - 1)]])
            jump = np.concatenate([np.zeros(len(at), np.int32), np.repeat(m - 1 - np.arange(1, m - 1), len(heads)).astype(np.int32)])
            order = np.lexsort((jump, blocks))
            keep = np.append(True, np.diff(blocks[order]) != 0)
            shift = _Table(blocks[order][keep], jump[order][keep], m - 1)
            suffix = _block(h[at + m - 2], h[at + m - 1])
        else:
            suffix = h[at]
        keys, number = np.unique(suffix, return_inverse=True)
        order = np.argsort(number, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(keys)))])
        return cls(m, group, at, item_starts, (pairs % len(group.ids)).astype(np.int32), shift, _Table(keys, np.arange(len(keys), dtype=np.int32), -1), starts, order)

    def items(self, window: int) -> np.ndarray:
        return self.item_numbers[self.item_starts[window]: self.item_starts[window + 1]]

    def find(self, words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, window) of every occurrence in a row of words of (folded) data."""
        h = words.hash
        n, m = len(h), self.m
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if m == 1:
            ends = np.flatnonzero(self.bucket[h] >= 0)
        else:
            at = np.arange(m - 1, n, LANE)  # each lane owns the window ends of its stretch
            stop = np.minimum(at + LANE, n)
            found = []
            while len(at):
                jump = self.shift[_block(h[at - 1], h[at])]
                found.append(at[jump == 0])
                at = at + np.maximum(jump, 1)
                inside = at < stop
                at, stop = at[inside], stop[inside]
            ends = np.concatenate(found)
        bucket = self.bucket[_block(h[ends - 1], h[ends]) if m > 1 else h[ends]]
        ends, bucket = ends[bucket >= 0], bucket[bucket >= 0]
        each = self.starts[bucket + 1] - self.starts[bucket]
        rank = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        window = self.order[np.repeat(self.starts[bucket], each) + rank]
        place = np.repeat(ends, each) - (m - 1)
        own = self.group.words
        for j in range(m):  # direct comparison
            same = h[place + j] == own.hash[self.at[window] + j]
            place, window = place[same], window[same]
        for j in range(m):
            same = equal_words(words, data, place + j, own, self.group.data, self.at[window] + j)
            place, window = place[same], window[same]
        return place, window


def compile_windows(items: list[tuple[object, str]], window: int = WINDOW) -> tuple[list[WindowSearch], list]:
    """The searches of all window lengths, and the item ids that their item numbers stand for."""
    ids = list(dict.fromkeys(i for i, t in items if t))
    number = {i: k for k, i in enumerate(ids)}
    items = [(i, t) for i, t in items if t]
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
    data = LOWER[data]
    group = Items(data, Words(data, offsets, LETTER_WORDS, SAME), ids)
    numbers, first = word_numbers(group.words, data), group.words.first
    size = np.diff(first)
    length = np.minimum(size, window)
    owner = np.array([number[i] for i, _ in items], np.int64)
    out = []
    for m in np.unique(length[length > 0]).tolist():
        mine = np.flatnonzero(length == m)
        each = size[mine] - m + 1
        at = np.repeat(first[mine], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        out.append(WindowSearch.compile(m, group, numbers, at, np.repeat(owner[mine], each)))
    return out, ids


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans): the item ids with a window in the document, and the hit words as ranges
    (from, to) of word numbers."""
    spark = docs.sparkSession
    parts = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where(F.length("t") > 0)
    item_kind = parts.schema["i"].dataType
    rows = parts.toLocalIterator()

    def groups() -> Iterator:
        """Compiled groups, each of a bounded part of the benchmark, and whether more follow."""
        held, size, more = [], 0, True
        while more:
            row = next(rows, None)
            more = row is not None
            if more and size >= pass_bytes:
                yield spark.sparkContext.broadcast(compile_windows(held, window)), True
                held, size = [], 0
            if more:
                held.append((row[0], row[1]))
                size += len(row[1].encode())
        yield spark.sparkContext.broadcast(compile_windows(held, window)), False

    key = F.lit(0).cast("long").alias("key")
    base = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), key)
    out = T.StructType([
        T.StructField("id", base.schema["id"].dataType), T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("items", T.ArrayType(item_kind)), T.StructField("spans", T.ArrayType(T.StructType.fromDDL("`from` bigint, `to` bigint"))),
    ])
    span = pa.struct([("from", pa.int64()), ("to", pa.int64())])

    def searching(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches, ids = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                data, offsets = text_bytes(batch.column(1))
                n_words, items, spans = [], [], []
                for a, b in slices(offsets):
                    part = LOWER[data[offsets[a]: offsets[b]]]
                    words = Words(part, offsets[a: b + 1] - offsets[a], LETTER_WORDS, SAME)
                    n_words += np.diff(words.first).tolist()
                    found: dict[int, set[int]] = {}
                    cover: dict[int, list[tuple[int, int]]] = {}
                    for search in searches:
                        place, which = search.find(words, part)
                        doc = np.searchsorted(words.first, place, side="right") - 1
                        inside = place + search.m <= words.first[doc + 1]
                        for p, w, d in zip(place[inside].tolist(), which[inside].tolist(), doc[inside].tolist()):
                            found.setdefault(d, set()).update(search.items(w).tolist())
                            p -= int(words.first[d])
                            cover.setdefault(d, []).append((p, p + search.m))
                    for d in range(b - a):
                        items.append([ids[k] for k in sorted(found.get(d, ()))])
                        spans.append([{"from": x, "to": y} for x, y in _union(cover.get(d, []))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(items, item_type), pa.array(spans, pa.list_(span))],
                    ["id", "key", "n_words", "items", "spans"],
                )

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = pa.list_(to_arrow_type(item_kind))
    found = None
    for shared, more in groups():
        if more and found is None:  # several passes: rows get a number that all passes share
            base = written(base.withColumn("key", F.monotonically_increasing_id()))
        one = base.mapInArrow(searching(shared), out)
        if not more and found is None:
            found = one
            break
        one = written(one)
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    if found is not one:
        found = found.groupBy("key").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
                                         F.flatten(F.collect_list("spans")).alias("spans"))
        found = found.withColumn("spans", _union_column("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "items", "spans")


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _union_column(name: str):
    """The same for an array column: sorted ranges are folded into the last one they touch."""
    empty = F.array().cast("array<struct<`from`:bigint,`to`:bigint>>")

    def fold(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to"))))
        return F.when((F.size(done) > 0) & (s["from"] <= F.try_element_at(done, F.lit(-1))["to"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(name), empty, fold)


def items_digest(items) -> object:
    """Lowercase hex SHA-256 of the item ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", most_share: float = 0.0, **options) -> DataFrame:
    """The documents (all their columns) of whose words at most `most_share` are hit."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = find_items(marked, benchmark, "row", "text", **options)
    return found.where((F.col("n_hit") == 0) | (F.col("n_hit") <= F.col("n_words") * most_share)).select("row.*")
