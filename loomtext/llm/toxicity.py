"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the damped counts of the hashed n-grams of its folded text.  Each
is multiplied by the log ratio of its smoothed shares of the toxic and of the other
training mass, and a logistic regression is fitted on the scaled features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import checkpoint, held_out, scored_rows, table, tidy

ORDERS = (3, 4, 5)
BITS = 19
#: Expected training texts of each class: documented bounds on the sample, not shares of the corpus.
TRAIN_TOXIC = 1200
TRAIN_OTHER = 2400
#: Bytes of the sample's features that the driver takes: the texts with the least hashes, as far as they fit.  A text has 3 MB at most.
TRAIN_BYTES = 96 << 20
THRESHOLD = 0.7
SMOOTH = 0.5
#: Features in fewer training texts, or with a smaller ratio, get no weight.
LEAST_TEXTS = 5
LEAST_RATIO = 0.7
FOLDS = 4
#: Values of a training step that are in hand at once.
_PART = 1 << 20
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)


def features(text: str) -> np.ndarray:
    """Hashed n-grams of the whole text, repeats kept: lower case, each run of white space one blank, a blank at each end."""
    codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in ORDERS:
        if len(codes) >= n:
            m = len(codes) - n + 1
            h = np.full(m, n * 40503, np.uint32)
            for k in range(n):
                h ^= codes[k : k + m] * _MULTIPLIERS[k]
                h *= np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of a text and how often each occurs."""
    return np.unique(features(text), return_counts=True)


def damped(counts: np.ndarray) -> np.ndarray:
    """A count's value as a feature: repeats add ever less."""
    return np.log2(1 + counts)


@dataclass
class Model:
    """``weights``: one number a feature, the learned weight times the ratio."""

    weights: np.ndarray
    bias: float

    def margin(self, found: np.ndarray) -> float:
        """Weighted sum over features with repeats; those without weight go before the counting."""
        w = self.weights
        unique, counts = np.unique(found[w[found] != 0], return_counts=True)
        return float(w[unique] @ damped(counts)) + self.bias

    def score(self, texts: list[str]) -> list[float]:
        return [float(1 / (1 + np.exp(-np.clip(self.margin(features(t)), -500, 500)))) for t in texts]


def log_count_ratio(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """log of each feature's smoothed share of the toxic mass over its share of the other mass; 0 where it says little."""
    mass, seen = np.zeros((2, 1 << BITS)), np.zeros(1 << BITS, np.int32)
    for (f, c), label in zip(rows, y):
        mass[int(label), f] += damped(c)
        seen[f] += 1
    total = np.maximum(mass.sum(axis=1, keepdims=True), 1e-9)
    share = (mass / total) + SMOOTH / total[1]
    ratio = np.log(share[1]) - np.log(share[0])
    ratio[(seen < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    return ratio


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, ridge: float = 2e-4, steps: int = 150) -> np.ndarray:
    """Logistic regression by gradient descent with momentum on the scaled features; weights for raw counts."""
    ratio = log_count_ratio(rows, y).astype(np.float32)
    used = np.flatnonzero(ratio)
    index = np.full(1 << BITS, -1, np.int32)
    index[used] = np.arange(len(used), dtype=np.int32)
    sizes = np.array([int((ratio[f] != 0).sum()) for f, _ in rows])
    cols, values, at = np.empty(sizes.sum(), np.int32), np.empty(sizes.sum(), np.float32), 0
    for (f, c), n in zip(rows, sizes):
        keep = ratio[f] != 0
        cols[at : at + n] = index[f[keep]]
        values[at : at + n] = damped(c[keep]) * ratio[f[keep]]
        at += n
    ends = np.cumsum(sizes)
    marks = [0, *(np.flatnonzero(np.diff(ends // _PART)) + 1).tolist(), len(rows)]
    parts = [(a, b, slice(ends[a] - sizes[a], ends[b - 1])) for a, b in zip(marks, marks[1:]) if b > a]  # rows of about _PART values, to bound what a step holds
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    power = sum(float(values[own] @ values[own]) for _, _, own in parts)
    scale = np.float32(1 / np.sqrt(max(1.0, power / len(y))))
    values *= scale
    w, velocity, b, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for _ in range(steps):
        slope, tilt, w32 = ridge * w, 0.0, w.astype(np.float32)
        for first, last, own in parts:
            at = np.repeat(np.arange(last - first), sizes[first:last])
            z = np.clip(np.bincount(at, w32[cols[own]] * values[own], minlength=last - first) + b, -500, 500)
            error = balance[first:last] * (1 / (1 + np.exp(-z)) - y[first:last]) / len(y)
            slope += np.bincount(cols[own], error.astype(np.float32)[at] * values[own], minlength=len(used))
            tilt += error.sum()
        velocity = 0.9 * velocity - 4.0 * slope
        vb = 0.9 * vb - 1.0 * tilt
        w, b = w + velocity, b + vb
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * ratio[used] * scale
    return weights


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Weights from all rows; the cut comes from rows that a fold's weights have not seen.  Without both classes, a constant."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        mean = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(mean / (1 - mean))))
    fold = np.zeros(len(y), np.int32)
    for label in (0, 1):  # folds share out either class
        own = np.flatnonzero(y == label)
        fold[own] = np.arange(len(own)) % FOLDS
    weights = fit_weights(rows, y)
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        inside = np.flatnonzero(fold != k)
        part = fit_weights([rows[i] for i in inside], y[inside]) if 0 < y[inside].sum() < len(inside) else weights
        for i in np.flatnonzero(fold == k):
            unseen[i] = part[rows[i][0]] @ damped(rows[i][1])
    cut = best_cut(unseen, y)
    # the cut gets the score THRESHOLD; the slope stretches the fitted margins around it
    return Model(weights * 2, float(np.log(THRESHOLD / (1 - THRESHOLD)) - 2 * cut))


def best_cut(margins: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest errors."""
    order = np.argsort(margins, kind="stable")
    z, y = margins[order], labels[order] > 0
    missed = np.concatenate(([0], np.cumsum(y)))  # toxic texts below the cut
    false = (~y).sum() - np.concatenate(([0], np.cumsum(~y)))
    edges = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    gaps = np.where(missed + false == (missed + false).min(), np.diff(edges), -1)
    at = int(gaps.argmax())
    return float((edges[at] + edges[at + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic: int = TRAIN_TOXIC, other: int = TRAIN_OTHER) -> Model:
    """Train on whole texts of a bounded sample of labelled rows, chosen by a hash of the key.

    Rows without text, key or label are left out; a key that is repeated counts each time;
    without rows or with one class the score is a constant.  The sample's keys (at most a few
    thousand, by the bounds) are broadcast to the documents; features of at most TRAIN_BYTES,
    and nothing else, come to the driver.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, toxic / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, other / max(1, sizes.get(0, 0)))))
    sample = known.where((F.xxhash64(F.col("k"), F.lit(7)).bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(1 << 24))) < share)

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            found = [counted(t) for t in batch.column(1).to_pylist()]
            f, c = [f.astype("<u4").tobytes() for f, _ in found], [np.minimum(c, 0xFFFF).astype("<u2").tobytes() for _, c in found]
            order = [xxhash.xxh3_64_intdigest(x + z) >> 1 for x, z in zip(f, c)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(order, pa.int64()), pa.array(f, pa.binary()), pa.array(c, pa.binary())], names=["y", "h", "f", "c"])

    picked = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").select("y", "t")
    found = checkpoint(picked.mapInArrow(tidy(extract), "y int, h bigint, f binary, c binary"))
    # rows come in any order; the model must not depend on it
    sizes = found.select("h", (F.octet_length("f") + F.octet_length("c")).alias("size")).toArrow()
    h, size = sizes.column("h").to_numpy(), sizes.column("size").to_numpy().astype(np.int64)
    order = np.argsort(h, kind="stable")
    over = order[np.cumsum(size[order]) > TRAIN_BYTES]
    got = (found.where(F.col("h") < int(h[over[0]])) if len(over) else found).toArrow()
    features_of, counts_of = _slices(got.column("f"), "<u4"), _slices(got.column("c"), "<u2")
    y, h = (got.column(n).to_numpy() for n in ("y", "h"))
    order = np.lexsort((y, h))
    return train([(features_of(i), counts_of(i)) for i in order], y[order])


def _slices(column, kind: str):
    """Views of a binary column's values, without a copy of each."""
    import pyarrow as pa

    array = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    if not len(array):
        return lambda i: np.zeros(0, kind)
    wide = "<i8" if pa.types.is_large_binary(array.type) else "<i4"
    at = np.frombuffer(array.buffers()[1], wide)[array.offset : array.offset + len(array) + 1] // np.dtype(kind).itemsize
    data = np.frombuffer(array.buffers()[2] or b"", kind)
    return lambda i: data[at[i] : at[i + 1]]


def score_documents(docs: DataFrame, model: Model, keep: list[str], *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns plus ``score`` and ``predicted``; a null text scores as an empty one.

    Whole texts of any length are read; repeated rows score alike; an empty table gives no
    rows; other columns, also ones named like these, are not read.
    """
    picked, split = scored_rows(docs, keep, text)
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    def run(batches):
        import pyarrow as pa

        own = Model(weights.value, bias)
        for batch in batches:
            kept, kept_names, texts = split(batch)
            scores = own.score([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=[*kept_names, "score", "predicted"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return picked.mapInArrow(tidy(run), f"{schema}, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)))
    return score_documents(docs, model, ["doc_id"]).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
