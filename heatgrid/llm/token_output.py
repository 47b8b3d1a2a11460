"""Token ids as binary shards with Elias-Fano encoded document boundaries.

The ids of all documents, in ascending id order and each ending with the end id, form one long array. It is written
in shards; a shard is a header, the Elias-Fano code of its document boundaries and its part of the id array:

    magic "EFIDS1", u8 bytes per id, u8 low bits, u64 documents, u64 ids, u64 bytes of low part, u64 bytes of high part,
    low part (packed low bits of the boundaries), high part (unary gaps of the high bits), u32 position of every 64th
    one bit (the select structure), ids (little endian)

n boundaries below u take about n (2 + log2(u / n)) bits instead of 64 n. `select(i)` jumps to the sampled one bit
before i and scans at most 64 ones, so one document is found without decoding the others.

Shards are rows of a Parquet table (document ids beside the binary shard), so Spark's commit protocol covers them and
any store that Spark writes to will do. Documents are dealt out by id range and sorted, which is the only shuffle.

Defined results: null and empty texts are written as the end id alone; rows with the same id follow each other, ordered
by text; null ids come first; an empty table gives no rows and no shards. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from heatgrid.llm.common import text_bytes
from heatgrid.llm.tokens import encoder_of

MAGIC = b"EFIDS1"
SHARD_IDS = 1 << 22
EVERY = 64
_HEAD = struct.Struct("<6sBBQQQQ")


class EliasFano:
    """A non-decreasing sequence of integers: packed low bits, unary high bits, sampled positions for select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts[None, :]) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::EVERY].astype("<u4"))

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        found = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            place = i * self.low_bits + b
            found |= ((self.low[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return found

    def select(self, i: int) -> int:
        """Value i, from the sampled one bit before it."""
        at = int(self.samples[i // EVERY])
        left = i % EVERY
        if left:
            first = (at + 1) >> 3
            rest = np.unpackbits(self.high[first: first + 16], bitorder="little")[(at + 1) & 7:]
            ones = np.flatnonzero(rest)
            size = 16
            while len(ones) < left:  # a long gap
                size *= 4
                rest = np.unpackbits(self.high[first: first + size], bitorder="little")[(at + 1) & 7:]
                ones = np.flatnonzero(rest)
            at += 1 + int(ones[left - 1])
        return ((at - i) << self.low_bits) | int(self._low_at(np.array([i]))[0])

    def all(self) -> np.ndarray:
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - i) << self.low_bits) | self._low_at(i)


def write_shard(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A shard's bytes. `ends[i]` is the number of ids up to the end of document i."""
    code = EliasFano.encode(ends)
    head = _HEAD.pack(MAGIC, ids.dtype.itemsize, code.low_bits, code.n, len(ids), len(code.low), len(code.high))
    return b"".join([head, code.low.tobytes(), code.high.tobytes(), code.samples.tobytes(), ids.tobytes()])


def read_shard(raw: bytes) -> tuple[EliasFano, np.ndarray]:
    """Boundaries and ids of a shard, both in place."""
    magic, width, low_bits, n, size, low, high = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = _HEAD.size
    parts = []
    for kind, count in ((np.uint8, low), (np.uint8, high), (np.dtype("<u4"), -(-n // EVERY)), (np.dtype(f"<u{width}"), size)):
        parts.append(np.frombuffer(raw, kind, count, at))
        at += parts[-1].nbytes
    return EliasFano(n, low_bits, *parts[:3]), parts[3]


def document_ids(raw: bytes, i: int) -> np.ndarray:
    """The ids of document i of a shard, through select alone."""
    code, ids = read_shard(raw)
    return ids[code.select(i - 1) if i else 0: code.select(i)]


def write_token_ids(docs: DataFrame, tokenizer_file: str, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0,
                    shard_ids: int = SHARD_IDS, partitions: int | None = None) -> None:
    """Encode every document and write the shards to `path` (columns part, shard, n_docs, n_ids, start, ids, payload)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
        .repartitionByRange(parts, F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    )
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_file)
        kind = encoder.kind if end_id < 1 << 16 else np.dtype("<u4")
        part, shard, written = TaskContext.get().partitionId(), 0, 0
        names: list[pa.Array] = []
        blocks: list[bytes] = []
        sizes: list[int] = []
        held_ids = 0
        end = np.array([end_id], kind).tobytes()

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(blocks), kind)
            ends = np.cumsum(sizes)
            held = pa.concat_arrays(names)
            columns = [pa.array([v], f.type) for v, f in zip((part, shard, len(sizes), len(ids), written), schema)]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays([0, len(held)], held), pa.array([write_shard(ids, ends)], pa.binary())], [*schema.names, "ids", "payload"])

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw, begin = data.tobytes(), 0
            for i in range(batch.num_rows):
                found = encoder.ids(raw[offsets[i]: offsets[i + 1]].decode())
                if kind != encoder.kind:
                    found = np.frombuffer(found, encoder.kind).astype(kind).tobytes()
                blocks += [found, end]
                sizes.append(len(found) // kind.itemsize + 1)
                held_ids += sizes[-1]
                if held_ids >= shard_ids:
                    names.append(batch.column(0).slice(begin, i + 1 - begin))
                    begin = i + 1
                    yield close()
                    shard, written = shard + 1, written + held_ids
                    names, blocks, sizes, held_ids = [], [], [], 0
            if begin < batch.num_rows:
                names.append(batch.column(0).slice(begin))
        if sizes:
            yield close()

    out = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("ids", T.ArrayType(kind)), T.StructField("payload", T.BinaryType()),
    ])
    placed.mapInArrow(run, out).write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).mode("error").parquet(path)


def read_token_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids binary of u32) of every document, from the shards.

    A shard knows where it begins within its part; where the parts begin follows from their sizes (one row for each task
    of the writing job, so this small table may meet in one place and be broadcast).
    """
    shards = spark.read.parquet(path)
    kind = shards.schema["ids"].dataType.elementType
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                code, ids = read_shard(batch.column(2)[row].as_py())
                ends = code.all()
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                held = batch.column(1)[row].values
                for at in range(0, len(ends), 256):
                    span = slice(at, at + 256)
                    blobs = [ids[a:b].astype("<u4").tobytes() for a, b in zip(begins[span], ends[span])]
                    yield pa.RecordBatch.from_arrays(
                        [held.slice(at, len(blobs)), pa.array(begins[span] + batch.column(0)[row].as_py()), pa.array(ends[span] - begins[span]), pa.array(blobs, pa.binary())],
                        ["id", "start", "n_tokens", "token_ids"],
                    )

    rows = shards.join(F.broadcast(parts), "part").select((F.col("part_start") + F.col("start")).alias("start"), "ids", "payload")
    out = T.StructType([T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())])
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
