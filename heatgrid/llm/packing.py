"""Best-fit packing of token sequences with certified bin counts.

Every partition packs its pieces best-fit decreasing. Dual-feasible functions give a lower bound on the bins that its
pieces need; where the bins meet the bound the packing is proven minimal there. Bins with gaps are opened again: their
documents are exchanged between partitions (fewer each time, as fewer pieces are left) and packed anew, until one
partition holds what is left. An uncertified partition opens all its bins with a notable gap, a certified one only its
emptiest bin, which another partition may fill.

Defined results: null and empty texts are one piece with the end id alone; repeated rows are packed each on their own;
ties are broken by the order of the written pieces; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from heatgrid.llm.common import map_texts, text_bytes, written
from heatgrid.llm.tokens import encoder_of

CAPACITY = 2048
PIECES_PER_PARTITION = 40_000


def piece_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, token_ids) with the ids of every whole text and the end id, cut only where longer than
    the capacity. `token_ids` are little-endian u32."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_file)
        data, offsets = text_bytes(batch.column(1))
        raw, end = data.tobytes(), np.array([end_id], "<u4").tobytes()
        for at in range(0, batch.num_rows, 256):
            rows, piece, start, length, blobs = [], [], [], [], []
            for i in range(at, min(at + 256, batch.num_rows)):
                ids = np.frombuffer(encoder.ids(raw[offsets[i]: offsets[i + 1]].decode()), encoder.kind).astype("<u4").tobytes() + end
                for k, a in enumerate(range(0, len(ids), capacity * 4)):
                    blobs.append(ids[a: a + capacity * 4])
                    rows.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(blobs[-1]) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(blobs, pa.binary())],
                ["id", "piece", "start", "length", "token_ids"],
            )

    out = map_texts(docs, {"id": F.col(id_col)}, F.col(text), work,
                    [("id", docs.schema[id_col].dataType), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("token_ids", "binary")])
    return out.withColumnRenamed("id", id_col)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual-feasible functions, over the histogram of lengths."""
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    # u(e): more than C - e counts as C, less than e as nothing
    many, total = np.cumsum(count), np.cumsum(count * x)
    e = np.arange(1, capacity // 2 + 1)
    large = many[-1] - many[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    best = max(best, int((-(-(large * capacity + middle) // capacity)).max()))
    # u(k): x (k + 1) / C where whole, else its floor times C / k
    for k in range(1, 33):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        doubled = np.where(whole, x * k, (scaled // capacity) * capacity)  # times k, to stay whole
        best = max(best, -(-int((count * doubled).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, fill of each bin. Bins of equal room share a stack, and the
    rooms in use are bits of one integer, so the tightest fit is its lowest bit from the length on."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def opened(fill: np.ndarray, bound: int, capacity: int, number: int) -> np.ndarray:
    """Which bins give their documents back for the next round: where the packing is not certified, all with a gap that
    is notable in this round (from a 256th of the capacity on, twice as much in each round); else the emptiest one."""
    gaps = capacity - fill
    again = gaps > (capacity >> max(1, 8 - number)) if len(fill) > bound else np.zeros(len(fill), bool)
    again[np.argmax(gaps)] |= gaps.max() > capacity // 64
    return again


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """All columns of `pieces`, with sequence_id, offset (gapless from 0) and certified (the bin count of the partition
    that placed it is proven minimal). Every length must be from 1 to the capacity. Each round is written to the
    shared folder; keep wide columns out of `pieces` and join them afterwards."""
    columns = pieces.columns
    held = written(pieces.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(length).cast("bigint").alias("n")))
    left, number, placed = held.count(), 0, []
    kind = T.StructType([*held.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("certified", T.BooleanType()), T.StructField("again", T.BooleanType())])
    while True:
        parts = max(1, -(-left // per_partition))
        last = parts == 1 or number > 16
        dealt = held.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(parts)).cast("int"))

        def run(batches: Iterator[pa.RecordBatch], number: int = number, last: bool = last) -> Iterator[pa.RecordBatch]:
            for table in _groups(batches):
                part = table.column("part")[0].as_py()
                lengths = table.column("n").to_numpy().astype(np.int64)
                bins, offsets, fill = best_fit(lengths, capacity)
                bound = lower_bound(lengths, capacity)
                again = np.zeros(len(fill), bool) if last else opened(fill, bound, capacity, number)
                base = (number << 56) | (part << 24)
                done = table.drop_columns(["part"])
                for name, values in (("sequence_id", bins + base), ("offset", offsets), ("certified", np.full(len(bins), len(fill) == bound)), ("again", again[bins])):
                    done = done.append_column(name, pa.array(values))
                yield from done.to_batches(max_chunksize=20_000)

        result = written(dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, kind))
        placed.append(result.where(~F.col("again")))
        held = result.where("again").select("row", "n")
        left = 0 if last else held.count()
        number += 1
        if not left:
            break
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.select("row.*", "sequence_id", "offset", "certified")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal `part` from batches sorted by it; a part has about `per_partition` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and held[-1].column("part")[0].as_py() != int(part[a]):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def sequences(packed: DataFrame, pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: (sequence_id, n_tokens, token_ids), each of at most the capacity."""
    placed = packed.select(id_col, "piece", "sequence_id", "offset").join(pieces.select(id_col, "piece", "token_ids"), [id_col, "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "token_ids")))
    joined = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    blob = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["token_ids"]))
    return joined.select("sequence_id", blob.alias("token_ids")).withColumn("n_tokens", F.length("token_ids") / 4)
