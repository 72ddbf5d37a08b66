"""Toxicity severity by cumulative-link ordinal regression on hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import chunks, pick, word_hashes
from assayloom.llm.language import fold_of

FEATURES = 1 << 18
#: Letters as they are (A-Z lower-cased, UTF-8 tails kept), everything else a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _features(texts: list[bytes | None], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once; with ``weights`` only features that weigh something."""
    hashes, counts = word_hashes([(t or b"").translate(LETTERS) for t in texts])
    feature = (hashes[:, 0] % np.uint64(FEATURES)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    if weights is not None:
        own = weights[feature] != 0
        doc, feature = doc[own], feature[own]
    pairs = np.unique(doc * FEATURES + feature)
    return pairs // FEATURES, pairs % FEATURES


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class SeverityModel:
    """P(grade >= k) = sigmoid(weights . x - thresholds[k - 1]): one weight vector for all thresholds, which ascend."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def reach(self, texts: list[bytes | None]) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each text."""
        doc, feature = _features(texts, self.weights)
        score = np.bincount(doc, self.weights[feature], len(texts))
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _learn(counts: np.ndarray, index: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int, rounds: int, rate: float, strengths: tuple[float, ...]) -> SeverityModel:
    """One fit a strength; each keeps only the features that the one before gave a weight, so a strong penalty chooses and a weak one weighs."""
    for strength in strengths:
        model = _descend(counts, index, grade, weight, grades, rounds, rate, strength)
        kept = model.weights[index] != 0
        ends = np.concatenate(([0], np.cumsum(kept)))[np.cumsum(counts)]
        counts, index = np.diff(ends, prepend=0), index[kept]
    return model


def _descend(counts: np.ndarray, index: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int, rounds: int, rate: float, strength: float) -> SeverityModel:
    """Proximal Adam on the weighted mean loss with an L1 penalty that shrinks with the root of the rows."""
    n = len(grade)
    used, index = np.unique(index, return_inverse=True)
    starts = np.cumsum(counts) - counts
    some = counts > 0
    w, theta = np.zeros(len(used)), np.linspace(1, 2, grades - 1) if grades > 1 else np.zeros(0)
    mean_w, seen_w, mean_t, seen_t = np.zeros(len(used)), np.zeros(len(used)), np.zeros(grades - 1), np.zeros(grades - 1)
    weight, penalty = weight / weight.sum(), strength / np.sqrt(max(n, 1))
    for turn in range(1, rounds + 1):
        score = np.zeros(n)
        if len(index):
            score[some] = np.add.reduceat(w[index], starts[some])
        reach = np.concatenate((np.ones((n, 1)), _sigmoid(score[:, None] - theta), np.zeros((n, 1))), axis=1)
        low, high = reach[np.arange(n), grade], reach[np.arange(n), grade + 1]
        slope = weight * (low + high - 1)
        gap = np.maximum(low - high, 1e-9)
        grad_w = np.bincount(index, np.repeat(slope, counts), len(used))
        grad_t = np.bincount(grade, weight * low * (1 - low) / gap, grades + 1)[1:grades] - np.bincount(grade + 1, weight * high * (1 - high) / gap, grades + 1)[1:grades]
        fresh, old = 1 - 0.9**turn, 1 - 0.99**turn
        mean_w, seen_w = 0.9 * mean_w + 0.1 * grad_w, 0.99 * seen_w + 0.01 * grad_w**2
        mean_t, seen_t = 0.9 * mean_t + 0.1 * grad_t, 0.99 * seen_t + 0.01 * grad_t**2
        step = rate / (np.sqrt(seen_w / old) + 1e-6)
        w -= step * mean_w / fresh
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        theta = np.sort(theta - rate / (np.sqrt(seen_t / old) + 1e-6) * mean_t / fresh)
        theta = np.maximum.accumulate(theta + np.arange(grades - 1) * 1e-6)
    weights = np.zeros(FEATURES)
    weights[used] = w
    return SeverityModel(weights, theta)


def _refined(counts: np.ndarray, index: np.ndarray, grade: np.ndarray, weight: np.ndarray, rounds: int, rate: float, strength: float, folds: int = 3) -> np.ndarray:
    """Labels that only say toxic or not, as up to three grades of toxic: the odds that a fit which has not seen the document gives it, cut
    at the thirds of the toxic documents whose odds its words raise."""
    doc = np.repeat(np.arange(len(counts)), counts)
    fold, odds = np.arange(len(counts)) % folds, np.zeros(len(counts))
    for k in range(folds):
        seen = fold != k
        if not (grade[seen] == 1).any():
            continue
        model = _descend(counts[seen], index[seen[doc]], grade[seen], weight[seen], 2, rounds, rate, strength)
        own = ~seen[doc]
        odds += np.bincount(doc[own], model.weights[index[own]], len(counts))
    raised = (grade == 1) & (odds > 0)
    cuts = np.unique(np.quantile(odds[raised], (1 / 3, 2 / 3))) if raised.any() else np.zeros(0)
    fine = np.where(grade == 1, 1 + (odds[:, None] > cuts[None, :]).sum(axis=1), 0)
    return np.unique(fine, return_inverse=True)[1]  # no empty grade in between


def fit(docs: DataFrame, labels: DataFrame, grade: str = "grade", most_rows: int = 16_000, most_bytes: int = 64 << 20, rounds: int = 200, rate: float = 0.05, strengths: tuple[float, ...] = (0.1, 0.01)) -> SeverityModel:
    """A model of the severity ``grade`` (0, 1, ..; int) that ``labels`` (doc_id, grade) gives documents outside the held-out fold.

    Fitted on a bounded sample: about ``most_rows`` labelled rows, half of the room for grade 0 and the rest shared by the
    others, chosen by a hash of the id and weighted back to their shares; whole texts of the chosen are read. Where those texts
    are longer than ``most_bytes`` together, the same share of each grade's rows is left out, so what the driver gets is bounded in
    bytes too (a word of the sample is four bytes there). Labels of two grades only are refined to more by _refined: their
    severity then says how strongly the words of other documents speak for toxic, since no such label says how bad it is. Nulls and
    negative grades are not learned from. Without labels, nothing is toxic.
    """
    rated = pick(labels, doc_id="long", **{grade: "int"}).toDF("doc_id", "grade").filter((fold_of() != 0) & (F.col("grade") >= 0)).groupBy("doc_id").agg(F.max("grade").alias("grade"))
    sizes = {r[0]: r[1] for r in rated.groupBy("grade").count().limit(101).collect()}
    if len(sizes) > 100:
        raise ValueError("more than 100 grades")
    grades = max(sizes, default=0) + 1
    if grades < 2:
        return SeverityModel(np.zeros(FEATURES), np.full(1, 40.0))
    room = {g: most_rows / 2 if g == 0 else most_rows / 2 / max(1, len(sizes) - (0 in sizes)) for g in sizes}
    rate_of = {g: min(1.0, room[g] / n) for g, n in sizes.items()}

    def within(rates: dict[int, float]) -> Column:
        part = F.shiftright(F.xxhash64("doc_id"), 1) + F.lit(1 << 62)  # 0 to 2**63
        return reduce(lambda a, b: a | b, ((F.col("grade") == g) & (part < F.lit(min((1 << 63) - 1, int(r * (1 << 63))))) for g, r in rates.items()))

    # About most_rows ids, whatever the input: sent to every task, so that no text is shuffled to find its label.
    texts_of = lambda rates: pick(docs, doc_id="long", text="string").join(F.broadcast(rated.filter(within(rates))), "doc_id").select("doc_id", "text", "grade")
    size = texts_of(rate_of).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        rate_of = {g: r * most_bytes / size for g, r in rate_of.items()}
    chosen = texts_of(rate_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            doc, feature = _features(texts)
            cuts = np.searchsorted(doc, np.arange(1, len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.astype(np.int32).tobytes() for x in np.split(feature, cuts)], pa.binary())], ["doc_id", "grade", "features"])

    rows = sorted(chosen.mapInArrow(run, "doc_id long, grade int, features binary").collect(), key=lambda r: (r[0], bytes(r[2])))
    if not rows:
        return SeverityModel(np.zeros(FEATURES), np.full(1, 40.0))
    index, counts = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.int32), np.array([len(r[2]) // 4 for r in rows])
    grade_of, weight = np.array([r[1] for r in rows]), np.array([1 / rate_of[r[1]] for r in rows])
    if grades == 2:
        grade_of = _refined(counts, index, grade_of, weight, rounds, rate, strengths[0])
    return _learn(counts, index, grade_of, weight, int(grade_of.max()) + 1, rounds, rate, strengths)


def predict(docs: DataFrame, model: SeverityModel, toxic_from: float = 0.35) -> DataFrame:
    """(doc_id long, severity double, grade int, p_toxic double, toxic boolean) of every whole text, one row per row of ``docs``.

    severity is the expected grade, grade the number of thresholds reached with even odds, p_toxic the probability of grade 1
    or more. Null and wordless texts have no features: they get what the thresholds alone say. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            reach = sent.value.reach(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reach.sum(axis=1)), pa.array((reach >= 0.5).sum(axis=1).astype(np.int32)), pa.array(reach[:, 0]), pa.array(reach[:, 0] >= toxic_from)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 1 toxic, 0 not; null where toxic is null. fit() refines such labels."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("grade"))


def rate(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Fit on the labelled documents outside the held-out fold, then predict all of ``docs``; see fit and predict.

    Nulls, repeated rows and empty tables are as there: rows with a null doc_id are rated and not learned from, a row repeated is
    rated each time, and labels that are missing altogether make nothing toxic.
    """
    return predict(docs, fit(docs, grades_of(labels), **how))
