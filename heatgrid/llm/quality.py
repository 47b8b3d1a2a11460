"""Quality classifier by compression: text is closer to the label whose dictionary compresses it better.

Two zstandard dictionaries are trained on good and on bad labelled texts. A text is compressed with both, in
pieces, and the normalised difference of the two sizes goes through a fitted logistic curve.

Defined results: null and empty texts get the share of good labels in the fitting sample; labels that are null or
neither 0 nor 1 are left out of the fit; with one label only, every score is that share; repeated rows are scored
each on their own; an empty table gives no rows. Only the id and text columns are read, other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from heatgrid.llm.common import map_texts, text_bytes

PIECE_BYTES = 4096
LEVEL = 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # intercept, difference, difference x log length, log length
    prior: float


class _Sizes:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = []
        for content in (good, bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, raw: memoryview) -> float:
        good = bad = 0
        for at in range(0, len(raw), PIECE_BYTES):
            piece = raw[at: at + PIECE_BYTES]
            good += len(self.packers[0].compress(piece))
            bad += len(self.packers[1].compress(piece))
        return (bad - good) / (bad + good) if good + bad else 0.0


def _features(difference: np.ndarray, length: np.ndarray) -> np.ndarray:
    size = np.log1p(length) / 8.0
    return np.stack([np.ones(len(difference)), difference * 20, difference * 20 * size, size], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _logistic(x @ w)
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    pieces = [t[at: at + 1024] for t in texts for at in range(0, len(t), 1024)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples for training: raw content serves as the dictionary
        return (b"".join(texts) or b"\n")[-size:].ljust(8, b"\n")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "label",
                sample_per_label: int = 2000, sample_bytes: int = 4096, dictionary_bytes: int = 65536) -> QualityModel:
    """Fit on a bounded sample: per label the `sample_per_label` labelled ids with the smallest hash, and of each text a
    window of `sample_bytes` characters at a place drawn by that hash. Half of them make the dictionaries, the other
    half the curve, weighted as the labels occur in the whole table of labels. Only the sampled ids are broadcast, so
    no text is shuffled."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy("_label").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    halves: dict[int, list[list[bytes]]] = {}
    order = F.xxhash64(F.lit(17), F.col("_id"))
    for value in counts:
        drawn = rows.where(F.col("_label") == value).select("_id", order.alias("_order")).orderBy("_order", "_id").limit(sample_per_label)
        room = F.greatest(F.length(F.col(text)) - F.lit(sample_bytes), F.lit(0)) + 1
        window = F.substring(F.col(text), (F.pmod(F.col("_order"), room) + 1).cast("int"), F.lit(sample_bytes))
        found = docs.select(F.col(id_col).alias("_id"), F.col(text)).where(F.length(text) > 0).join(F.broadcast(drawn), "_id")
        texts = [r["_window"].encode() for r in found.select("_order", window.alias("_window")).distinct().orderBy("_order", "_window").collect()]
        if texts:
            halves[value] = [texts[0::2], texts[1::2] or texts]
    if len(halves) < 2:
        return QualityModel(b"\n" * 8, b"\n" * 8, (0.0, 0.0, 0.0, 0.0), prior)
    bad, good = (_dictionary(halves[v][0], dictionary_bytes) for v in (0, 1))
    sizes = _Sizes(good, bad)
    held = [(t, v) for v in (0, 1) for t in halves[v][1]]
    difference = np.array([sizes.difference(memoryview(t)) for t, _ in held])
    marks = np.array([v for _, v in held], float)
    weights = np.array(_fit_curve(_features(difference, np.array([len(t) for t, _ in held])), marks))
    shown = marks.mean()  # the intercept moves from the shares of the sample to those of the table
    weights[0] += np.log(prior / (1 - prior)) - np.log(shown / (1 - shown))
    return QualityModel(good, bad, tuple(float(v) for v in weights), prior)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every whole text; the model (two dictionaries of fixed size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        sizes = _Sizes(model.good, model.bad)
        data, offsets = text_bytes(batch.column(1))
        raw = memoryview(np.ascontiguousarray(data))
        difference = np.array([sizes.difference(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])
        length = np.diff(offsets)
        score = np.where((length > 0) & any(model.weights[1:]), _logistic(_features(difference, length) @ np.array(model.weights)), model.prior)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"]
        )

    out = map_texts(docs, {"id": F.col(id_col)}, F.col(text), work, [("id", docs.schema[id_col].dataType), ("score", "double"), ("predicted", "int")])
    return out.withColumnRenamed("id", id_col)
