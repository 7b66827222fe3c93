"""Toxicity: cumulative-link ordinal regression from sparse text features to expected severity.

P(grade <= k) = sigmoid(threshold k - weights . features): the thresholds are ordered, the weights shared by all.
Features are words and the beginnings of words, hashed; a feature's value grows with the log of its count. The model is
fitted on the driver from a bounded sample of labelled documents (``MOST_LABELLED``) and scores all documents in one pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm._common import by_column, trim

#: Labelled documents used at most, those with the least hash of their id: bounds what the driver collects.
MOST_LABELLED = 6000
#: Hash buckets of features, features kept, documents a feature must be in, rounds of fitting, weight decay.
DIMENSIONS, KEPT, LEAST_DOCS, ROUNDS, DECAY = 1 << 20, 1000, 3, 1500, 1e-3
#: A document is rejected from this expected severity on.
REJECT = 0.5

_TOKEN = re.compile(r"[^\W\d_]+")


def _buckets(word: str) -> list[int]:
    """The hashed features of a word: itself and its beginnings."""
    h = xxhash.xxh64_intdigest
    return [h(f) % DIMENSIONS for f in (word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k))]


def features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed features with their counts, and the number of words."""
    words = Counter(_TOKEN.findall(text.lower()))
    found: Counter[int] = Counter()
    for w, n in words.items():
        for b in _buckets(w):
            found[b] += n
    return np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found)), sum(words.values())


def _value(counts: np.ndarray) -> np.ndarray:
    return np.log2(1 + counts)


#: Words whose weighted features a worker remembers; it forgets all of them when there are more.
REMEMBERED = 200_000


@dataclass
class Model:
    """weights by hash bucket, zero for most; thresholds ascending, one less than the grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def _weighted(self, word: str) -> tuple[int, ...]:
        """The buckets of a word that have a weight: none for most words."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = tuple(b for b in _buckets(word) if self.weights[b])
        return found

    def probabilities(self, text: str) -> np.ndarray:
        found: dict[int, int] = {}
        for w, n in Counter(_TOKEN.findall(text.lower())).items():
            for b in self._weighted(w):
                found[b] = found.get(b, 0) + n
        z = float(sum(float(self.weights[b]) * np.log2(1 + n) for b, n in sorted(found.items())))
        upto = np.concatenate([1 / (1 + np.exp(-(self.thresholds - z).clip(-40, 40))), [1.0]])
        return np.diff(upto, prepend=0.0)


def graded(toxic: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from a yes-no label: toxic documents are severe if they have more of toxic features than the median.

    The amount is what the model's features measure; by a share of the text's words, grades would contradict them.
    """
    if not toxic.any():
        return np.zeros(len(toxic), int)
    return np.where(toxic > 0, 1 + (amount > np.median(amount[toxic > 0])), 0)


def _select(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Buckets most associated with the label, by the signed root of the likelihood ratio."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    a, b = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for (at, _), t in zip(docs, toxic):
        (a if t else b)[at] += 1
    p1, p0, p = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (a + b + 1) / (n1 + n0 + 2)
    gain = a * np.log(p1 / p) + b * np.log(p0 / p) + (n1 - a) * np.log((1 - p1) / (1 - p)) + (n0 - b) * np.log((1 - p0) / (1 - p))
    gain[(a + b) < min(LEAST_DOCS, n1)] = 0
    gain[p1 < p0] = 0  # what marks clean documents would let long ones hide a slur
    best = np.argsort(-gain, kind="stable")[:KEPT]
    return best[gain[best] > 3]


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray) -> Model:
    """Grades 0.. as labels; yes-no labels are graded first. Without two grades the model knows grade 0 only."""
    labels = np.asarray(labels, int)
    toxic = (labels > 0).astype(int)
    if not len(labels) or toxic.all() or not toxic.any():
        return Model(np.zeros(DIMENSIONS, np.float32), np.array([20.0]) if not toxic.any() else np.array([-20.0]))
    chosen = _select([d[:2] for d in docs], toxic)
    column = np.full(DIMENSIONS, -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    row, col, val, amount = [], [], [], np.zeros(len(docs))
    for i, (at, counts, _) in enumerate(docs):
        c = column[at]
        keep = c >= 0
        row.append(np.full(keep.sum(), i))
        col.append(c[keep])
        val.append(_value(counts[keep]))
        amount[i] = _value(counts[keep]).sum()
    row, col, val = np.concatenate(row), np.concatenate(col), np.concatenate(val)
    grade = labels if labels.max() > 1 else graded(toxic, amount)
    top = int(grade.max())
    w, theta0, gaps = np.zeros(len(chosen)), 1.0, np.zeros(max(0, top - 1))
    # Parameters: weights, the first threshold, the logs of the gaps between thresholds. Adam on all rows.
    p = np.concatenate([w, [theta0], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    k = len(chosen)
    lo, hi = grade - 1, grade  # thresholds around a grade; -1 and top are infinite

    def sig(x):
        return 1 / (1 + np.exp(-x.clip(-40, 40)))

    for t in range(1, ROUNDS + 1):
        theta = p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))])
        z = np.bincount(row, val * p[col], len(docs))
        a = np.where(hi < top, sig(theta[np.minimum(hi, top - 1)] - z), 1.0)
        b = np.where(lo >= 0, sig(theta[np.maximum(lo, 0)] - z), 0.0)
        da, db = np.where(hi < top, a * (1 - a), 0.0), np.where(lo >= 0, b * (1 - b), 0.0)
        q = np.maximum(a - b, 1e-12)
        gz = (da - db) / q / len(docs)  # of the loss by z
        g = np.zeros_like(p)
        g[:k] = np.bincount(col, val * gz[row], k) + DECAY * p[:k] / max(1, k) ** 0.5
        gt = np.bincount(np.minimum(hi, top - 1), -da / q / len(docs), top) + np.bincount(np.maximum(lo, 0), db / q / len(docs), top)
        g[k] = gt.sum()
        for j in range(top - 1):
            g[k + 1 + j] = gt[j + 1 :].sum() * np.exp(p[k + 1 + j])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[chosen] = p[:k]
    return Model(weights, p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> Model:
    """A model from at most ``most`` labelled documents, one row each. Rows with a null id, label or text are not used.

    Of several rows of one id that with the least text is taken, so that repeated rows add nothing to what the driver gets.
    """
    some = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("grade")).where(F.col("l_id").isNotNull() & F.col("grade").isNotNull())
    some = some.groupBy("l_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = d.join(F.broadcast(some), d["doc_id"] == some["l_id"]).select("doc_id", "grade", "text")  # at most ``most`` rows are broadcast
    rows = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, grades, texts in by_column(batches, "doc_id", "grade", "text"):
            found = [features(t) for t in texts.to_pylist()]
            columns = [pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, grades, *columns], ["doc_id", "grade", "at", "counts", "n"])

    got = rows.mapInArrow(run, "doc_id long, grade int, at array<int>, counts array<int>, n long").toArrow()
    at, counts = (got[c].combine_chunks() if got.num_rows else None for c in ("at", "counts"))
    order = sorted(range(got.num_rows), key=lambda i: (ids[i], n[i])) if (ids := got["doc_id"].to_pylist()) and (n := got["n"].to_pylist()) else []
    found = [(at[i].values.to_numpy(), counts[i].values.to_numpy(), n[i]) for i in order]  # views of what was collected
    model = fit(found, got["grade"].to_numpy()[order] if order else np.array([], int))
    del got, at, counts, found
    trim()  # what the driver held for fitting
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity, grade (the likeliest), probabilities: one row for each of docs.

    A null or empty text has no features. Repeated rows have a row each, a very long text is read whole, an empty table gives no
    rows, and other columns are left out, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for ids, texts in by_column(batches, "doc_id", "text"):
            p = [m.probabilities(t or "") for t in texts.to_pylist()]
            severity = [float(x @ np.arange(len(x))) for x in p]
            columns = [ids, pa.array(severity), pa.array([int(x.argmax()) for x in p], pa.int32()), pa.array([x.tolist() for x in p], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_severity", "grade", "probabilities"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, expected_severity double, grade int, probabilities array<double>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """docs without those whose expected severity is ``reject`` or more; all columns as they are, whatever their names.

    Each row is judged by its own whole text: rows that share an id, or have none, are apart, repeated rows go or stay together. Null and
    empty texts have no features, so what the model says of them is its thresholds' (clean, if it was fitted on any clean document).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            if b.num_rows:
                p = [m.probabilities(t or "") for t in b.column(b.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()]
                yield b.filter(pa.array([float(x @ np.arange(len(x))) < reject for x in p]))

    return docs.mapInArrow(run, docs.schema)
