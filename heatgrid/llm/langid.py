"""Language identification: a byte convolutional network, trained and applied in numpy.

Filters of several widths slide over the raw bytes of fixed-length windows; each filter keeps its largest response
(max pooling), and a linear layer with softmax gives the languages. A document's probabilities are the mean over all
its windows, weighted by their bytes. A filter over one-hot bytes is a sum of table rows, so a response needs one
look-up for every two bytes of its width.

Defined results: null texts and texts without a letter get `und` and score 0; null labels are not learned; with no
labelled row everything is `und`; ties go to the alphabetically first language; repeated rows are predicted each on
their own; an empty table gives no rows. Only the id and text columns are read, other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from heatgrid.llm.common import map_texts, text_bytes

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16


@dataclass
class LanguageModel:
    languages: list[str]
    filters: list[np.ndarray]  # one (width, 256, FILTERS) table per width
    bias: np.ndarray  # of all filters
    out: np.ndarray  # (filters, languages)
    out_bias: np.ndarray


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows (zero-padded) over all bytes of all documents; each window's document and bytes."""
    length = np.diff(offsets)
    each = -(-length // WINDOW)
    doc = np.repeat(np.arange(len(length)), each)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[:-1][doc] + number * WINDOW
    used = np.minimum(WINDOW, offsets[1:][doc] - start)
    place = start[:, None] + np.arange(WINDOW)[None, :]
    inside = np.arange(WINDOW)[None, :] < used[:, None]
    padded = np.append(data, np.zeros(1, np.uint8))
    return np.where(inside, padded[np.minimum(place, len(data))], np.uint8(0)), doc, used


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _responses(x: np.ndarray, tables: np.ndarray) -> np.ndarray:
    n = x.shape[1] - len(tables) + 1
    total = tables[0][x[:, :n]]
    for k in range(1, len(tables)):
        total += tables[k][x[:, k: k + n]]
    return total


def train_network(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, seed: int = 5, rate: float = 0.02) -> LanguageModel:
    """Adam on the cross-entropy. Max pooling sends each gradient to one position, so updates touch few table rows."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.2, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at: at + 64]
            batch, n = x[rows], len(rows)
            best, pooled = [], []
            for tables in params[: len(WIDTHS)]:
                found = _responses(batch, tables)
                best.append(found.argmax(axis=1))
                pooled.append(np.take_along_axis(found, best[-1][:, None, :], 1)[:, 0])
            before = np.concatenate(pooled, axis=1) + params[-3]
            hidden = np.maximum(before, 0)
            p = _softmax(hidden @ params[-2] + params[-1])
            p[np.arange(n), y[rows]] -= 1
            p /= n
            back = (p @ params[-2].T) * (before > 0)
            grads = [np.zeros_like(q) for q in params]
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS: (i + 1) * FILTERS]
                for k in range(w):
                    byte = np.take_along_axis(batch, best[i] + k, axis=1)
                    np.add.at(grads[i][k], (byte, np.arange(FILTERS)[None, :]), g)
            grads[-3], grads[-2], grads[-1] = back.sum(axis=0), hidden.T @ p, p.sum(axis=0)
            step += 1
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LanguageModel(languages, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


def _smallest(most: int):
    """The `most` smallest different hashes of each language among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, np.ndarray] = {}
        for batch in batches:
            named = batch.column(0).dictionary_encode()
            code, order = named.indices.to_numpy(), batch.column(1).to_numpy()
            for i, name in enumerate(named.dictionary.to_pylist()):
                best[name] = np.unique(np.concatenate([best.get(name, order[:0]), order[code == i]]))[:most]
        for name, found in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found)], ["_lang", "_order"])

    return run


def fit_language(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_per_language: int = 800, windows_per_text: int = 2) -> LanguageModel:
    """Train on a bounded sample: per language the `sample_per_language` different texts with the smallest text hash, and of
    each up to `windows_per_text` windows, cut at places drawn by that hash.

    Two passes over the rows, however many languages there are: each task keeps the smallest hashes of each language, which gives the last
    hash taken; then the windows of the texts up to it are cut, copies once."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = F.xxhash64(F.lit(29), F.col(text))
    hashes = rows.select(F.col(lang).alias("_lang"), order.alias("_order")).mapInArrow(_smallest(sample_per_language), "_lang string, _order bigint").distinct()
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_order"))
    kept = hashes.withColumn("_place", place).where(F.col("_place") <= sample_per_language)
    edges = {r["_lang"]: r["edge"] for r in kept.groupBy("_lang").agg(F.max("_order").alias("edge")).collect()}
    languages = sorted(edges)
    xs, ys = [], []
    if languages:
        room = F.greatest(F.length(text) - F.lit(WINDOW), F.lit(0)) + 1
        cuts = [F.substring(F.col(text), (F.pmod(F.xxhash64(F.lit(i), order), room) + 1).cast("int"), F.lit(WINDOW)).alias(f"_w{i}") for i in range(windows_per_text)]
        edge = F.element_at(F.create_map(*[F.lit(x) for item in edges.items() for x in item]), F.col(lang))
        taken = rows.where(order <= edge).select(F.col(lang).alias("_lang"), order.alias("_order"), *cuts).groupBy("_lang", "_order")
        drawn = taken.agg(*[F.first(f"_w{i}") for i in range(windows_per_text)]).orderBy("_lang", "_order").collect()
        for number, name in enumerate(languages):
            pieces = [piece.encode()[:WINDOW] for r in drawn if r["_lang"] == name for piece in dict.fromkeys(r[2:])]
            block = np.zeros((len(pieces), WINDOW), np.uint8)
            for i, piece in enumerate(pieces):
                block[i, : len(piece)] = np.frombuffer(piece, np.uint8)
            xs.append(block)
            ys.append(np.full(len(pieces), number))
    if not languages:
        return LanguageModel([], [np.zeros((w, 256, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros((FILTERS * len(WIDTHS), 0), np.float32), np.zeros(0, np.float32))
    return train_network(np.concatenate(xs), np.concatenate(ys), languages)


class Predictor:
    """The network with its filters as tables over byte pairs."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.pairs = []
        for tables in model.filters:
            parts = [(k, (tables[k][:, None, :] + tables[k + 1][None, :, :]).reshape(65536, FILTERS)) for k in range(0, len(tables) - 1, 2)]
            if len(tables) % 2:
                parts.append((len(tables) - 1, tables[-1]))
            self.pairs.append((len(tables), parts))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pair = (x[:, :-1].astype(np.uint16) << np.uint16(8)) | x[:, 1:]
        pooled = []
        for width, parts in self.pairs:
            n = x.shape[1] - width + 1
            total = None
            for k, table in parts:
                found = np.take(table, pair[:, k: k + n] if len(table) > 256 else x[:, k: k + n], axis=0)
                total = found if total is None else np.add(total, found, out=total)
            pooled.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.model.bias, 0)
        return _softmax(hidden @ self.model.out + self.model.out_bias)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; the model has a fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept: dict[str, Predictor] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "net" not in kept:
            kept["net"] = Predictor(shared.value)
        net, names = kept["net"], shared.value.languages
        lettered = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        if not names:
            label, score = np.full(len(lettered), UNDETERMINED, object), np.zeros(len(lettered))
        else:
            data, offsets = text_bytes(batch.column(2))
            sums = np.zeros((len(lettered), len(names)))
            x, doc, used = None, None, None
            step = 1 << 18
            at = 0
            while at < len(lettered):  # as many documents as fill about a quarter of a megabyte
                end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, side="right")) - 1), len(lettered))
                lo, hi = offsets[at], offsets[end]
                for cut in range(int(lo), int(hi), step) if end == at + 1 else (int(lo),):
                    if end == at + 1:  # a long text goes in parts of whole windows
                        span = np.array([0, min(step, int(hi) - cut)])
                        x, doc, used = windows_of(data[cut: cut + step][: span[1]], span)
                    else:
                        x, doc, used = windows_of(data[lo:hi], offsets[at: end + 1] - lo)
                    if len(x):
                        np.add.at(sums, doc + at, net.probabilities(x) * used[:, None])
                at = end
            share = sums / np.maximum(np.diff(offsets), 1)[:, None]
            label = np.where(lettered, np.array(names, object)[share.argmax(axis=1)], UNDETERMINED)
            score = np.where(lettered, np.clip(share.max(axis=1), 0.0, 1.0), 0.0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    out = map_texts(docs, {"id": F.col(id_col), "lettered": has_letter(F.col(text))}, F.col(text), work,
                    [("id", docs.schema[id_col].dataType), ("lang_pred", "string"), ("score", "double")])
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text", min_score: float = 0.3) -> DataFrame:
    """The documents (all their columns) in which a language was found; `und` ones and those below min_score go."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    predicted = predict_language(marked, model, "row", "text")
    return predicted.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")
