"""Removal of long repeated passages, by suffix trees over groups of suffixes.

Every run of `length` consecutive words (a window) that also starts anywhere else is a repeat; the words under repeats
are removed. A window is the prefix of the suffix that starts with it, and two suffixes share it exactly if they
meet in an internal node of a suffix tree at that depth or deeper. The suffixes are split into groups that fit into memory, by a gram of GRAM
words inside their first `length` words: the one with the smallest hash, so equal windows fall into the same group.

1. Each text yields its suffixes as runs of starts with the same gram. Groups with one run cannot hold a repeat and are
   dropped: rows of a batch are compared there, the remaining ones meet sorted by gram, read as a stream.
2. The texts with runs left cut them out (the words of all their windows), and send them to their groups.
3. A group builds its subtree: the suffixes in order with the common prefix of each and the next one. Internal nodes at depth `length`
   or more (intervals of neighbours with a common prefix that long) hold the repeats, their leaves are the repeated starts. Words are told
   apart by their bytes. Groups with very many runs are split; windows found once in a part, which is the longest prefix that matters, meet again
   by their hash, with one marker for each window the part has already found to repeat.
4. Ranges of repeated starts go back to their texts.

`maximal_repeats` reports the deep internal nodes themselves: the words, and every place where they stand.

Texts are told apart by 128 bits of hash and each different text is searched once; a text that occurs in several rows
is repeated from end to end.

Defined results: null and empty texts have no words; texts with fewer words than the window keep all; rows with the same id are
judged each on their own; with all words removed the kept text is empty; an empty table gives no rows. Other columns
are kept by `drop_repeats` and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from heatgrid.llm.common import SAME, SPACE_WORDS, Words, gram_hash, mix64, slices, text_bytes, text_key, word_numbers, written

LENGTH = 35
GRAM = 8
GROUP_ROWS = 5_000
MOST_HOT = 100_000
TREE_BYTES = 1 << 21

_RUNS = "gram bigint, k1 bigint, k2 bigint, low int, high int"


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the leftmost smallest value among each `size` consecutive ones."""
    place, best, done = np.arange(len(values)), values, 1
    while done < size:
        step = min(done, size - done)
        n = len(best) - step
        right = best[step: step + n] < best[:n]
        place = np.where(right, place[step: step + n], place[:n])
        best = np.where(right, best[step: step + n], best[:n])
        done += step
    return place


def runs_of(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, document, first start, last start) of all runs; starts are word numbers within the document."""
    n = len(words) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none, none, none
    size = min(GRAM, length)
    grams = gram_hash(words.hash, size)
    place = _least(grams, length - size + 1)[:n]
    doc = words.docs()
    starts = np.flatnonzero(doc[:n] == doc[length - 1:])
    if not len(starts):
        return none.view(np.uint64), none, none, none
    opens = np.append(True, (np.diff(starts) != 1) | (np.diff(place[starts]) != 0) | (np.diff(doc[starts]) != 0))
    low = starts[opens]
    high = starts[np.append(np.flatnonzero(opens)[1:] - 1, len(starts) - 1)]
    owner = doc[low]
    return grams[place[low]], owner, low - words.first[owner], high - words.first[owner]


def _emit_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(batch.column(2))
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for a, b in slices(offsets):
                words = Words(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], SPACE_WORDS, SAME)
                gram, doc, low, high = runs_of(words, length)
                if not len(gram):
                    continue
                _, inverse, count = np.unique(gram, return_inverse=True, return_counts=True)
                known = count[inverse] > 1
                marks = np.unique(gram[known])
                rows = len(gram) + len(marks)
                mark = np.arange(rows) >= len(gram)
                pad = lambda x, fill=0: np.concatenate([x, np.full(len(marks), fill, x.dtype)])  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([gram, marks]).view(np.int64)), pa.array(pad(keys[0][a + doc]), mask=mark), pa.array(pad(keys[1][a + doc]), mask=mark),
                        pa.array(pad(low).astype(np.int32)), pa.array(pad(high).astype(np.int32)), pa.array(pad(known, False)),
                    ],
                    ["gram", "k1", "k2", "low", "high", "known"],
                )

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose gram occurs again, from a stream sorted by gram; one row is held back, however large a group is."""
    held, flagged = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        gram = table.column("gram").to_numpy()
        same = gram[1:] == gram[:-1]
        again = np.zeros(len(gram), bool)
        again[1:] |= same
        again[:-1] |= same
        again[0] |= flagged
        held, flagged = table.slice(len(gram) - 1).to_batches()[0], bool(again[-1])
        again[-1] = False
        yield from table.filter(pa.array(again & table.column("k1").is_valid().to_numpy())).to_batches()
    if held is not None and flagged and held.column("k1").is_valid()[0].as_py():
        yield held


def _cut_runs(length: int, hot):
    """Texts with their runs: one row per run with its words, to be sent to its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(batch.column(2))
            lists = batch.column(3)
            begin = lists.offsets.to_numpy()
            fields = lists.flatten()
            gram, low, high = (fields.field(i).to_numpy() for i in range(3))
            begin = begin - begin[0]
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for a, b in slices(offsets):
                part = data[offsets[a]: offsets[b]]
                words = Words(part, offsets[a: b + 1] - offsets[a], SPACE_WORDS, SAME)
                mine = slice(begin[a], begin[b])
                doc = np.repeat(np.arange(b - a), np.diff(begin[a: b + 1]))
                first = words.first[doc]
                start, end = words.starts[first + low[mine]], words.ends[first + high[mine] + length - 1]
                sizes = end - start
                salt = np.zeros(len(doc), np.int32)
                parts = np.ones(len(doc), np.int32)
                if hot.value:
                    parts = np.array([hot.value.get(g, 1) for g in gram[mine].tolist()], np.int32)
                    mixed = mix64(keys[0][a + doc].view(np.uint64) + low[mine].astype(np.uint64))
                    salt = (mixed % parts.astype(np.uint64)).astype(np.int32)
                at = 0
                while at < len(doc):
                    to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), TREE_BYTES)) + at)
                    span = slice(at, to)
                    where = np.concatenate([[0], np.cumsum(sizes[span])])
                    index = np.arange(where[-1]) + np.repeat(start[span] - where[:-1], sizes[span])
                    text = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(part[index])])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram[mine][span]), pa.array(salt[span]), pa.array(parts[span] > 1), pa.array(keys[0][a + doc[span]]), pa.array(keys[1][a + doc[span]]),
                         pa.array(low[mine][span]), text.cast(pa.binary())],
                        ["gram", "salt", "hot", "k1", "k2", "low", "words"],
                    )
                    at = to

    return run


@dataclass
class SuffixForest:
    """The suffixes (of at least `length` words) of some rows in order, as word numbers, each with the common prefix of it and the next one."""

    starts: np.ndarray
    common: np.ndarray  # in words, one fewer than starts

    @classmethod
    def build(cls, numbers: np.ndarray, first: np.ndarray, length: int) -> SuffixForest:
        """Ranks of the words from every place double in depth until they differ everywhere or the rows end. Behind each row
        stands a word of its own, so no prefix goes on into the next row."""
        rows = np.diff(first)
        row = np.repeat(np.arange(len(rows)), rows)
        own = int(numbers.max(initial=0)) + 1
        sequence = np.insert(numbers, first[1:], own + np.arange(len(rows)))
        levels, depth = [np.unique(sequence, return_inverse=True)[1]], 1
        while depth < rows.max(initial=0):
            rank = levels[-1]
            after = np.concatenate([rank[depth:] + 1, np.zeros(min(depth, len(rank)), rank.dtype)])
            levels.append(np.unique(rank * np.int64(len(sequence) + 1) + after, return_inverse=True)[1])
            depth *= 2
        left = first[row + 1] - np.arange(len(numbers)) if len(numbers) else np.zeros(0, np.int64)
        starts = np.flatnonzero(left >= length)
        at = starts + row[starts]  # one separator for each row before
        order = np.argsort(levels[-1][at], kind="stable")
        at = at[order]
        common = np.zeros(max(len(at) - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            a, b = at[:-1] + common, at[1:] + common
            common += np.where(levels[k][a] == levels[k][b], 1 << k, 0)
        return cls(starts[order], common)

    def repeated(self, length: int) -> np.ndarray:
        """The leaves below internal nodes of at least that depth."""
        deep = self.common >= length
        below = np.append(deep, False)
        below[1:] |= deep
        return self.starts[below[: len(self.starts)]]

    def nodes(self, length: int) -> Iterator[tuple[int, int, int]]:
        """(depth, from, to) of the internal nodes of at least that depth: their leaves are starts[from:to]. The open ones stand on a
        stack, deeper ones above; a shorter common prefix closes those that are deeper."""
        stack: list[list[int]] = []
        for i, depth in enumerate(np.append(self.common, 0).tolist()):
            begin = i
            while stack and stack[-1][0] > depth:
                deeper, begin = stack.pop()
                yield deeper, begin, i + 1
            if depth >= length and not (stack and stack[-1][0] == depth):
                stack.append([depth, begin])


def _search_trees(length: int, report: bool = False):
    """With `report` the maximal repeats, else repeated starts of each group, from rows sorted by group: `gram` null and a range of starts; for split groups also the
    windows that stay open, by hash."""

    def work(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(tables).combine_chunks()
        data, offsets = text_bytes(_as_text(table.column("words")))
        words = Words(data, offsets, SPACE_WORDS, SAME)
        forest = SuffixForest.build(word_numbers(words, data), words.first, length)
        starts = np.sort(forest.starts)
        if not len(starts):
            return
        row = words.docs()[starts]
        place = starts - words.first[row] + table.column("low").to_numpy()[row]
        k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
        if report:
            yield from _maximal(forest, words, data, length, k1, k2, table.column("low").to_numpy())
            return
        # the same suffix twice in one batch is one leaf: runs of a text never overlap, so rows differ in text or place
        again = np.isin(starts, forest.repeated(length))
        r, p = row[again], place[again]
        if len(r):
            opens = np.append(True, (np.diff(r) != 0) | (np.diff(p) != 1))
            low, last = p[opens], p[np.append(np.flatnonzero(opens)[1:] - 1, len(p) - 1)]
            owner = r[opens]
            yield _ranges(np.zeros(len(low), np.int64), np.ones(len(low), bool), k1[owner], k2[owner], np.zeros(len(low), bool), low, last)
        hot = table.column("hot").to_numpy(zero_copy_only=False)[row]
        if hot.any():
            window = gram_hash(words.hash, length)[starts].view(np.int64)
            alone = hot & ~again
            marks = np.unique(window[hot & again])
            none = np.zeros(len(marks), np.int64)
            yield _ranges(
                np.concatenate([window[alone], marks]), np.zeros(int(alone.sum()) + len(marks), bool), np.concatenate([k1[row[alone]], none]), np.concatenate([k2[row[alone]], none]),
                np.arange(int(alone.sum()) + len(marks)) >= alone.sum(), np.concatenate([place[alone], none]), np.concatenate([place[alone], none]),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            if not batch.num_rows:
                continue
            gram, salt = batch.column("gram").to_numpy(), batch.column("salt").to_numpy()
            ends = np.append(np.flatnonzero((np.diff(gram) != 0) | (np.diff(salt) != 0)) + 1, batch.num_rows)
            bytes_to = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column("words"))))])
            if held and size >= TREE_BYTES and (held[-1].column("gram")[-1].as_py(), held[-1].column("salt")[-1].as_py()) != (int(gram[0]), int(salt[0])):
                yield from work(held)
                held, size = [], 0
            for end in ends.tolist():
                if size + bytes_to[end] - bytes_to[at] >= TREE_BYTES and end < batch.num_rows:
                    held.append(batch.slice(at, end - at))
                    yield from work(held)
                    held, size, at = [], 0, end
            held.append(batch.slice(at))
            size += int(bytes_to[-1] - bytes_to[at])
        if held:
            yield from work(held)

    return run


_REPEATS = "words string, n_words int, k1 bigint, k2 bigint, low int"


def _maximal(forest: SuffixForest, words: Words, data: np.ndarray, length: int, k1: np.ndarray, k2: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The leaves of deep internal nodes whose leaves do not all follow the same word of their row."""
    numbers = word_numbers(words, data)
    row = words.docs()[forest.starts]
    before = np.where(forest.starts > words.first[row], numbers[np.maximum(forest.starts, 1) - 1], -1)
    turns = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))])  # a row's first start always counts
    raw = data.tobytes()
    out: list[tuple] = []
    for depth, a, b in forest.nodes(length):
        if turns[b - 1] == turns[a]:
            continue
        leaves = forest.starts[a:b]
        text = b" ".join(raw[words.starts[i]: words.ends[i]] for i in range(leaves[0], leaves[0] + depth)).decode()
        mine = row[a:b]
        out += zip([text] * (b - a), [depth] * (b - a), k1[mine].tolist(), k2[mine].tolist(), (leaves - words.first[mine] + low[mine]).tolist())
        if len(out) > 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _REPEAT_TYPES)], ["words", "n_words", "k1", "k2", "low"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _REPEAT_TYPES)], ["words", "n_words", "k1", "k2", "low"])


_REPEAT_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32())


def _as_text(column: pa.ChunkedArray) -> pa.Array:
    """Binary words as the string array they were cut from (at word bounds, so they are whole UTF-8)."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    return array.view(pa.string())


def _ranges(gram: np.ndarray, done: np.ndarray, k1: np.ndarray, k2: np.ndarray, mark: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(gram, mask=done), pa.array(k1, mask=mark), pa.array(k2, mask=mark), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
        ["gram", "k1", "k2", "low", "high"],
    )


def _streamed(rows: DataFrame) -> DataFrame:
    """Rows whose gram meets another row's."""
    return rows.select("gram", "k1", "k2", "low", "high").repartition(F.col("gram")).sortWithinPartitions("gram").mapInArrow(_met, _RUNS)


def different_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, text, copies): each different text once; copies merge before they are shuffled."""
    k1, k2 = text_key(F.col(text))
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def _groups(docs: DataFrame, text: str, length: int, group_rows: int) -> tuple[DataFrame, DataFrame, bool]:
    """Each different text once; the runs of its groups, sorted by group; and whether groups are split."""
    spark = docs.sparkSession
    k1, k2 = text_key(F.col(text))
    rows = docs.where(F.length(text) >= 2 * length - 1).select(k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    runs = rows.mapInArrow(_emit_runs(length), _RUNS + ", known boolean")
    met = runs.where("known").select("gram", "k1", "k2", "low", "high").unionByName(_streamed(runs.where(~F.col("known"))))
    met = written(met)
    limit = group_rows
    sizes = met.groupBy("gram").count()
    while (hot_rows := sizes.where(F.col("count") > limit).limit(MOST_HOT + 1).collect()) and len(hot_rows) > MOST_HOT:
        limit *= 2
    hot = spark.sparkContext.broadcast({int(r["gram"]): -(-int(r["count"]) // limit) for r in hot_rows})
    lists = met.groupBy("k1", "k2").agg(F.collect_set(F.struct("gram", "low", "high")).alias("runs"))
    texts = different_texts(docs, text)
    groups = texts.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(
        _cut_runs(length, hot), "gram bigint, salt int, hot boolean, k1 bigint, k2 bigint, low int, words binary"
    )
    return texts, groups.repartition(F.col("gram"), F.col("salt")).sortWithinPartitions("gram", "salt"), bool(hot.value)


def _spans(groups: DataFrame, split: bool, length: int) -> DataFrame:
    """(k1, k2, spans): the repeated starts of each text that has any, as an array of (low, high), both included."""
    found = groups.mapInArrow(_search_trees(length), _RUNS)
    if split:
        found = written(found)
        found = found.where(F.col("gram").isNull()).unionByName(_streamed(found.where(F.col("gram").isNotNull())))
    return found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"))


def find_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(k1, k2, text, copies, spans): each different text with its repeated starts, as an array of (low, high), both included."""
    texts, groups, split = _groups(docs, text, length, group_rows)
    return texts.join(_spans(groups, split, length), ["k1", "k2"], "left")


def maximal_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(words, n_words, k1, k2, low): the deep internal nodes of all subtrees, one row for each place where their words stand in a different text.

    A node's words cannot be longer for all its places, inside the passage of its group: passages that go on past it come as several nodes that
    overlap, which together cover every repeated window. In a split group each part reports its own."""
    _, groups, _ = _groups(docs, text, length, group_rows)
    return groups.mapInArrow(_search_trees(length, True), _REPEATS).distinct()


def _cut(texts: pa.Array, copies: np.ndarray, lists: pa.ListArray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(from, to, words, words removed, kept words joined by single blanks) of slices of the texts, without their spans or, of copies, all words."""
    data, offsets = text_bytes(texts)
    begin, spans = lists.offsets.to_numpy(), lists.flatten()
    begin = begin - begin[0]
    low, high = spans.field(0).to_numpy(), spans.field(1).to_numpy()
    for a, b in slices(offsets):
        part = data[offsets[a]: offsets[b]]
        words = Words(part, offsets[a: b + 1] - offsets[a], SPACE_WORDS, SAME)
        count = np.diff(words.first)
        cover = np.zeros(len(words) + 1, np.int64)
        doc = np.repeat(np.arange(b - a), np.diff(begin[a: b + 1]))
        np.add.at(cover, words.first[doc] + low[begin[a]: begin[b]], 1)
        np.add.at(cover, words.first[doc] + high[begin[a]: begin[b]] + length, -1)
        whole = (copies[a:b] > 1) & (count >= length)
        gone = (np.cumsum(cover[:-1]) > 0) | np.repeat(whole, count)
        # one blank behind every kept word but a text's last one
        keep = np.flatnonzero(~gone)
        owner = words.docs()[keep]
        sizes = words.ends[keep] - words.starts[keep] + 1
        where = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(where[-1]) + np.repeat(words.starts[keep] - where[:-1], sizes)
        joined = np.append(part, np.uint8(32))[np.minimum(index, len(part))]
        joined[where[1:] - 1] = 32
        bounds = where[np.searchsorted(owner, np.arange(b - a + 1))]
        raw = joined.tobytes()
        kept = [raw[x: y - 1] if y > x else b"" for x, y in zip(bounds[:-1], bounds[1:])]
        yield a, b, count, count - np.bincount(owner, minlength=b - a), pa.array(kept, pa.binary()).view(pa.string())


_NO_SPANS = "array<struct<low:int,high:int>>"


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(k1, k2, n_words, n_removed, kept): each different text without its repeated words; kept words are joined by
    single blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for a, b, count, removed, kept in _cut(batch.column(2), batch.column(3).to_numpy(), batch.column(4), length):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(count), pa.array(removed), kept],
                    ["k1", "k2", "n_words", "n_removed", "kept"],
                )

    found = find_repeats(docs, text, length, group_rows)
    return found.select("k1", "k2", "text", "copies", F.coalesce("spans", F.array().cast(_NO_SPANS)).alias("spans")).mapInArrow(
        run, "k1 bigint, k2 bigint, n_words bigint, n_removed bigint, kept string"
    )


def per_document(docs: DataFrame, values: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """Documents' columns beside what was found for their text. Only narrow columns of `docs` are shuffled."""
    k1, k2 = text_key(F.col(text))
    return docs.select(F.struct(*keep).alias("row"), k1.alias("k1"), k2.alias("k2")).join(values, ["k1", "k2"])


def drop_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The documents (all their columns), their text without repeated words. Texts without repeats stay as they are;
    documents of which nothing is left go. Repeated starts and numbers of copies are sent to the documents, whose texts are
    shuffled once for the search and once to meet them."""
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fields = batch.column(0).flatten()
            for a, b, count, removed, kept in _cut(fields[at], batch.column(1).to_numpy(), batch.column(2), length):
                columns = [c.slice(a, b - a) for c in fields]
                columns[at] = pc.if_else(pa.array(removed > 0), kept.cast(columns[at].type), columns[at])
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array((removed == 0) | (removed < count)))

    _, groups, split = _groups(docs, text, length, group_rows)
    k1, k2 = text_key(F.col(text))
    copies = docs.groupBy(k1.alias("k1"), k2.alias("k2")).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    marks = _spans(groups, split, length).join(copies, ["k1", "k2"], "full")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), k1.alias("k1"), k2.alias("k2")).join(marks, ["k1", "k2"], "left")
    return rows.select(
        "row", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("spans", F.array().cast(_NO_SPANS)).alias("spans")
    ).mapInArrow(run, docs.schema)
