"""Helpers shared by the corpus operators: Arrow text batches, words as byte ranges, stable 64-bit hashes.

Texts travel as Arrow string columns; their bytes and offsets are read in place. Every batch is worked on in
slices of a few megabytes, so the memory of a task does not depend on how many documents it sees.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from heatgrid.operators.support import shared_folder

SLICE_BYTES = 1 << 21
HASH_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _byte_table(word: Callable[[int], bool]) -> np.ndarray:
    return np.array([word(b) for b in range(256)])


#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z: digits, letters and all bytes of non-ASCII characters.
LETTER_WORDS = _byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words `[^\x20\x09-\x0D]+`.
SPACE_WORDS = _byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string column (null: empty), without a copy where nothing is null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `most` bytes; a longer document is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range (none empty): its blocks of eight bytes are scrambled each with a key of its place, so
    that no relation between blocks cancels out in their sum, which is scrambled again with the length."""
    sizes = ends - starts
    blocks = (sizes + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * place
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))[at]  # eight bytes from any place on
    value &= _LOW_BYTES[np.minimum(np.repeat(ends, blocks) - at, 8)]
    keys = mix64((np.arange(int(blocks.max(initial=0)), dtype=np.uint64) + np.uint64(1)) * _ODD)
    mixed = mix64(mix64(value ^ keys[place]) + keys[place])
    return mix64(np.add.reduceat(mixed, first) + sizes.astype(np.uint64) * _ODD)


class Words:
    """The words of some documents: byte range, hash and document of each.

    `first[d] : first[d + 1]` are the words of document d. Hashes are of the word's bytes alone, so they are
    equal wherever the word stands.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: np.ndarray):
        n = len(data)
        inside = table[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = np.empty(len(self.starts), np.uint64)
        cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, n, HASH_BYTES)), len(self.starts)))
        for i, j in zip(cuts[:-1], cuts[1:]):  # blocks of whole words, so the arrays of a block stay small
            low = self.starts[i]
            self.hash[i:j] = word_hash(fold[data[low: self.ends[j - 1]]], self.starts[i:j] - low, self.ends[i:j] - low)

    def __len__(self) -> int:
        return len(self.starts)

    def docs(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_numbers(words: Words, data: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes of (folded) data: words of one hash are compared with the first of them."""
    _, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
    if equal_words(words, data, np.arange(len(words)), words, data, first[number]).all():
        return number
    raw, known = data.tobytes(), {}
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(words.starts.tolist(), words.ends.tolist())], np.int64)


def equal_words(a: Words, data_a: np.ndarray, i: np.ndarray, b: Words, data_b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the words i of a and j of b have the same bytes in (folded) data."""
    size = a.ends[i] - a.starts[i]
    out = size == b.ends[j] - b.starts[j]
    i, j, size = i[out], j[out], size[out]
    if len(i):
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        same = data_a[np.repeat(a.starts[i], size) + step] == data_b[np.repeat(b.starts[j], size) + step]
        out[out] = np.logical_and.reduceat(same, first)
    return out


def gram_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of each run of k values (runs may cross documents; the caller masks those)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[i: i + n]
    return mix64(total)


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a whole text (null: empty), to tell texts apart."""
    filled = F.coalesce(text, F.lit(""))
    return [F.xxhash64(filled), F.xxhash64(F.lit("second"), filled)]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later steps survive lost executors and repeat nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(docs: DataFrame, keep: dict[str, Column], text: Column, work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
              schema: list[tuple[str, T.DataType | str]]) -> DataFrame:
    """Arrow batches of (keep columns, text) through `work`; only these columns are read."""
    fields = T.StructType([f for n, t in schema for f in (T.StructType.fromDDL(f"{n} {t}") if isinstance(t, str) else [T.StructField(n, t)])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                for part in out if isinstance(out, Iterator) else (out,):
                    if part is not None and part.num_rows:
                        yield part

    return docs.select(*[c.alias(n) for n, c in keep.items()], text.cast("string").alias("text")).mapInArrow(run, fields)
