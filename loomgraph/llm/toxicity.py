"""Toxicity (operator 2): gradient-boosted trees over dense features, then isotonic calibration.

A lexicon of words and word beginnings is counted over the labelled documents. The
features are densities of lexicon words, their nearness to second-person words,
capitals, punctuation and obfuscation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import read, remainder, row_slices
from loomgraph.llm.labelled import SAMPLE_ROWS, labelled_texts
from loomgraph.session import written

THRESHOLD = 0.7
#: The share of the trees' probability in a score, which only orders scores that are equal otherwise.
TIES = 1e-6
#: Documents of each class that an entry must occur in, at least, to be listed.
LEAST_DOCS = 3
LEAST_WEIGHT = 1.5
#: How surprising (in nats) an entry's share of toxic documents must be, so that chance among very many words lists few.
LEAST_SURPRISE = 9.0
#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6, 7)

FEATURES = ("heaviest", "second", "weight_density", "hits", "hit_density", "distinct_hits", "near_you", "you_density", "capitals", "shouted_hits", "punctuation", "mark_runs", "obfuscated", "obfuscated_hits", "log_words")

#: Second-person words of the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch euer ihr tu te toi ton ta tes vous votre vos usted ustedes tú ti contigo vosotros".split())
NEAR = 3
#: Characters that commonly stand for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W_]+(?:[0-9@$!*.\-_]+[^\W_]+)*")
_ODD = re.compile(r"[^\W\d_][0-9@$!*.\-_]+[^\W\d_]")
_LETTER = re.compile(r"[^\W\d_]")
_INNER = re.compile(r"[*.\-_]")


def words_of(text: str) -> Iterator[tuple[str, str, bool]]:
    """Each word as written, its lower-case form with look-alikes resolved, and whether it was obfuscated."""
    for w in _WORD.findall(text):
        if w.isalpha():
            yield w, w.lower(), False
        elif _ODD.search(w):
            yield w, _INNER.sub("", w.translate(LOOKALIKES)).lower(), True
        else:
            yield w, w.lower(), False


def entries(word: str) -> list[str]:
    """What the lexicon knows of a word: itself, and its beginnings (an asterisk marks those)."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


class Known(dict):
    """What a lexicon makes of words as written, remembered: None for plain words, else (word, weight, obfuscated, second person)."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, raw: str) -> tuple[str, float, bool, bool] | None:
        if len(self) > 500_000:
            self.clear()
        _, word, obfuscated = next(words_of(raw))
        weight = max(self.weights.get(e, 0.0) for e in entries(word))
        you = word in SECOND_PERSON
        out = self[raw] = (word, weight, obfuscated, you) if weight > 0 or obfuscated or you else None
        return out


def features(text: str, weights: dict[str, float] | Known) -> list[float]:
    """All are 0 for a text without words."""
    known = weights if isinstance(weights, Known) else Known(weights)
    hits: list[tuple[int, str, float]] = []
    you: list[int] = []
    shouted = odd = odd_hits = 0
    raws = _WORD.findall(text)
    n = len(raws)
    for i, found in enumerate(map(known.__getitem__, raws), 1):
        if found is None:
            continue
        word, w, obfuscated, second = found
        odd += obfuscated
        if w > 0:
            hits.append((i, word, w))
            odd_hits += obfuscated
            shouted += raws[i - 1].isupper() and len(raws[i - 1]) > 1
        if second:
            you.append(i)
    if not n:
        return [0.0] * len(FEATURES)
    near = 0
    at = 0
    for i, _, _ in hits:
        while at < len(you) and you[at] < i - NEAR:
            at += 1
        near += at < len(you) and you[at] <= i + NEAR
    best = sorted((w for _, _, w in hits), reverse=True)
    letters = len(_LETTER.findall(text))
    return [
        best[0] if best else 0.0,
        best[1] if len(best) > 1 else 0.0,
        100 * sum(best) / n,
        float(len(hits)),
        100 * len(hits) / n,
        float(len({w for _, w, _ in hits})),
        near / n * 100,
        100 * len(you) / n,
        len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text)) / max(letters, 1),
        100 * shouted / n,
        sum(map(text.count, "!?")) / n,
        len(re.findall(r"[!?*#$%]{2,}", text)) / n,
        100 * odd / n,
        100 * odd_hits / n,
        math.log1p(n),
    ]


def build_lexicon(sample: DataFrame) -> tuple[dict[str, tuple[int, int]], int, int]:
    """Entries with the numbers of toxic and other documents that hold them, and both totals.

    Counted over all documents of the sample; entries that chance does not explain stay.
    """

    def explode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, labels = [], []
            for text, label in zip(batch["text"], batch["label"], strict=True):
                own = {e for _, w, _ in words_of(text) for e in entries(w)}
                keys += own
                labels += [label] * len(own)
            yield pd.DataFrame({"entry": keys, "label": pd.Series(labels, dtype="int32")})

    total = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    toxic, clean = int(total["t"]), int(total["n"] - total["t"])
    counted = sample.mapInPandas(explode, "entry string, label int").groupBy("entry").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    base, held = max(toxic, 0.5) / max(toxic + clean, 1), F.col("t") + F.col("c")
    surprise = F.col("t") * F.log(F.col("t") / held / base) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / held / (1 - base))).otherwise(0.0)
    top = counted.where(F.col("t") >= LEAST_DOCS).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT)
    top = top.where(surprise >= LEAST_SURPRISE) if toxic and clean else top.limit(0)
    top = top.orderBy("entry").collect()  # of a bounded sample
    return {r["entry"]: (int(r["t"]), int(r["c"])) for r in top}, toxic, clean


def weigh(t: float, c: float, toxic: int, clean: int) -> float:
    return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))


class Toxicity:
    """A lexicon, boosted trees and a calibration; or one constant where there is nothing to learn from."""

    def __init__(self, weights: dict[str, float], trees: GBTClassificationModel | None, calibration: IsotonicRegressionModel | None, constant: float) -> None:
        self.weights, self.trees, self.calibration, self.constant = weights, trees, calibration, constant

    def raw(self, rows: DataFrame) -> DataFrame:
        """Add the trees' probability to rows with the array ``x``."""
        out = self.trees.transform(rows.withColumn("features", array_to_vector("x")))
        return out.withColumn("raw", vector_to_array("probability")[1])

    def calibrated(self, rows: DataFrame) -> DataFrame:
        """Add the score: the isotonic fit, and a millionth of the trees' probability to order what it makes equal."""
        out = self.calibration.transform(rows)
        return out.withColumn("score", F.col("fitted") * (1 - TIES) + F.col("raw") * TIES)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Toxicity:
    """Fit on at most about ``rows`` labelled documents that are not held out.

    When a document of the sample is measured, its own counts are taken out of the
    lexicon. A quarter of the sample, by hash, calibrates; the rest grows the trees.
    """
    sample = written(labelled_texts(docs, labels, label, rows), "sample")
    counts, toxic, clean = build_lexicon(sample)
    n = toxic + clean
    constant = toxic / n if n else 0.5
    if not toxic or not clean:
        return Toxicity({}, None, None, constant)

    def measure(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = {e: weigh(t, c, toxic, clean) for e, (t, c) in counts.items()}
        for batch in batches:
            out = []
            for text, own in zip(batch["text"], batch["label"], strict=True):
                mine = {e for _, w, _ in words_of(text) for e in entries(w) if e in counts}
                less = {e: weigh(counts[e][0] - own, counts[e][1] - (1 - own), toxic - own, clean - (1 - own)) for e in mine}
                out.append(features(text, full | {e: w if w >= LEAST_WEIGHT and counts[e][0] - own >= LEAST_DOCS else 0.0 for e, w in less.items()}))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"].astype(float), "x": out})

    measured = written(sample.mapInPandas(measure, "doc_id long, label double, x array<double>").repartition(2, "doc_id").sortWithinPartitions("doc_id"), "measured")
    fold = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0
    grow, hold = measured.where(~fold), measured.where(fold)
    both = grow.agg(F.count_distinct("label")).first()[0] == 2 and hold.agg(F.count_distinct("label")).first()[0] == 2
    if not both:
        grow = hold = measured
    share = n / (2 * toxic), n / (2 * clean)
    grow = grow.withColumn("weight", F.when(F.col("label") == 1, share[0]).otherwise(share[1])).withColumn("features", array_to_vector("x"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=3, maxIter=20, stepSize=0.3, seed=7, minInstancesPerNode=2).fit(grow)
    model = Toxicity({e: weigh(t, c, toxic, clean) for e, (t, c) in counts.items()}, trees, None, constant)
    model.calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="fitted").fit(model.raw(hold).select("raw", "label"))
    return model


def score(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted for each row, by its whole text.

    A null text counts as empty, and empty texts have a score. Without labels of
    both classes all scores are the share of toxic labels (0.5 without any).
    Repeated rows are scored alike; null identifiers are kept; no rows give none.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if model.trees is None:
        scored = rows.select("doc_id", F.lit(float(model.constant)).alias("score"))
    else:
        weights = model.weights

        def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Known(weights)
            for batch in row_slices(batches):
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "x": pa.array([features(t, known) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))})

        scored = model.calibrated(model.raw(rows.mapInArrow(measure, "doc_id long, x array<double>")).select("doc_id", "raw")).select("doc_id", "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of the labelled ones that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
