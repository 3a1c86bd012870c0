"""Quality classifier (operator 5): a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees, one feature at a time, learns a lookup table for
each feature; then tables for the pairs of features that explain most of what is
left. A score is a sum of table entries, looked up for a batch of documents at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import read, remainder, row_slices, without
from loomgraph.llm.labelled import SAMPLE_ROWS, labelled_texts
from loomgraph.session import written

FEATURES = (
    "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "same_as_before", "distinct_pairs",
    "caps", "letters", "digits", "punctuation", "symbols", "symbol_runs", "bars", "marks", "word_marks", "line_length", "repeated_lines", "wide",
)
THRESHOLD = 0.5

_RUN = re.compile(r"[^\w\s]{2,}")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")


def features(text: str) -> list[float]:
    """The numbers that a whole text is judged by; all are 0 for an empty text."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    packed = sum(map(len, words))
    letters = len(_LETTER.findall(text))
    digits = sum(map(text.count, "0123456789"))
    symbols = sum(map(text.count, "$%&*#@^~|<>{}[]\\+=_"))
    marks = sum(map(text.count, "!?"))
    runs = len(_RUN.findall(text))
    return [
        float(np.log1p(n)),
        packed / n,
        sum(len(w) > 14 for w in counts) / len(counts),
        sum(len(w) < 4 for w in words) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:], strict=False))) / n,
        len(_UPPER.findall(text)) / max(letters, 1),
        letters / chars,
        digits / packed,
        max(0, packed - letters - digits) / packed,
        symbols / packed,
        runs / n,
        counts["|"] / n,
        marks / n,
        sum(w[-1] in ".,!?;:" for w in words) / n,
        chars / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        1 - len(text.encode("ascii", "ignore")) / chars,
    ]


@dataclass
class Additive:
    """Bin edges and tables; ``score`` adds up what the bins of each row hold."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def logit(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, reg: float) -> np.ndarray:
    """A shallow tree over ordered bins: greedy splits of (gradient, weight) sums; a value for each bin."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    part = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + reg)
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = np.arange(a + 1, b)
            if len(at):
                gain = part(a, at) + part(at, b) - part(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(at[k])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + reg)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.08, leaves: int = 3, pairs: int = 6, coarse: int = 8, reg: float = 2.0) -> Additive:
    """Fit on a bounded sample. One class only, or no rows: a constant score (0.5 without rows)."""
    y = y.astype(float)
    if not len(y):
        return Additive()
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Additive(intercept=float(np.log(mean / (1 - mean))))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    z = np.full(len(y), model.intercept)
    sums = lambda k, n, v: np.bincount(k, weights=v, minlength=n)
    for _ in range(rounds):
        for j, n in enumerate(sizes):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            step = rate * _tree(sums(b[:, j], n, y - p), sums(b[:, j], n, p * (1 - p)), leaves, reg)
            model.tables[j] += step
            z += step[b[:, j]]
    model.coarse = [np.minimum(np.arange(n) * coarse // n, coarse - 1) for n in sizes]
    cb = np.stack([model.coarse[j][b[:, j]] for j in range(len(sizes))], axis=1)

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        k = cb[:, i] * coarse + cb[:, j]
        return k, sums(k, coarse * coarse, y - p), sums(k, coarse * coarse, p * (1 - p))

    gains = []
    for i in range(len(sizes)):
        for j in range(i):
            _, g, h = cells(i, j)
            gains.append((float((g**2 / (h + 5 * reg)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((coarse, coarse)) for _ in model.pairs]
    for _ in range(rounds // 5):
        for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True):
            k, g, h = cells(i, j)
            step = rate * g / (h + 5 * reg)
            t += step.reshape(coarse, coarse)
            z += step[k]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on at most about ``rows`` labelled documents; only their features reach the driver."""
    sample = labelled_texts(docs, labels, label, rows)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            x = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.record_batch({"x": x, "label": batch.column("label"), "doc_id": batch.column("doc_id")})

    got = sample.mapInArrow(measure, "x array<double>, label int, doc_id long").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["label"].to_numpy())


def _scores(model: Additive, batch: pa.RecordBatch) -> np.ndarray:
    return model.score(np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES)))


def score(docs: DataFrame, model: Additive, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted for each row, by its whole text.

    A null text counts as empty, and empty texts have a score. Repeated rows are
    scored alike; null identifiers are kept; no rows give none. Other columns are
    not read.
    """

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            s = _scores(model, batch)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(rate, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns.

    A document is rejected by its identifier and text: rows that share an identifier
    are judged each by its own text.
    """
    model = train(docs, labels)
    h = F.xxhash64(F.coalesce(docs["text"], F.lit("")))

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            low = _scores(model, batch) < threshold
            yield batch.select(["doc_id", "h"]).filter(pa.array(low))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), h.alias("h"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rejected = written(rows.mapInArrow(rate, "doc_id long, h long"), "rejected").distinct()
    return without(docs, rejected, doc_id=docs["doc_id"], h=h)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of the labelled ones that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
