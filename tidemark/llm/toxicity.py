"""Toxicity: cumulative-link ordinal regression of severity grades on sparse word counts.

Thresholds are ordered; all share the weights of the words."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import words_of
from tidemark.llm.quality import labelled_sample

#: Labelled rows of each grade that the model is fitted on, at most: those of the smallest hash of their id.
SAMPLE = {0: 1500, 1: 700}
#: A word or prefix is a feature if this share of the toxic sample has it, its log odds ratio is as large as
#: that, and so many standard errors above zero.
LEAST_SHARE, LEAST_ODDS, LEAST_Z = 0.02, 2.0, 3.5
#: Characters of the prefixes that stand for the word forms of one stem.
PREFIXES = (4, 5, 6, 7)
#: Ridges on the weights, of which the folds inside the fitted sample choose; their number; and the steps of the fit.
RIDGES, FOLDS, STEPS, STEP = (1e-2, 3e-3, 1e-3, 3e-4, 1e-4), 3, 400, 0.05
#: Words that a task remembers; the memory starts anew beyond.
REMEMBER = 400_000


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    """P(grade > k) = sigmoid(weights . counts - thresholds[k]), one weight per word for all thresholds."""

    words: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, counts: np.ndarray) -> np.ndarray:
        return _sigmoid((counts @ self.weights)[:, None] - self.thresholds[None, :])


def features(word: bytes) -> list[bytes]:
    """A word and its prefixes, which end in an asterisk."""
    text = word.decode("utf-8", "replace")
    return [word] + [text[:k].encode() + b"*" for k in PREFIXES if len(text) > k]


def indicators(bags: list[list[bytes]], toxic: list[int]) -> list[bytes]:
    sides = (Counter(), Counter())
    for words, y in zip(bags, toxic, strict=True):
        sides[y].update({f for w in words for f in features(w)})
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    out = []
    for f, a in sides[1].items():
        if a >= max(2, LEAST_SHARE * n1):
            cells = (a + 0.5, n1 - a + 0.5, sides[0][f] + 0.5, n0 - sides[0][f] + 0.5)
            odds = np.log(cells[0] / cells[1] * cells[3] / cells[2])
            if odds >= LEAST_ODDS and odds >= LEAST_Z * np.sqrt(sum(1 / c for c in cells)):
                out.append(f)
    return sorted(out)


class Finder(dict):
    """word -> places of its features among ``at``; remembers a bounded number of words."""

    def __init__(self, at: dict[bytes, int]):
        super().__init__()
        self.at = at

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = out = tuple(self.at[f] for f in features(word) if f in self.at)
        return out


def count_features(words, finder: Finder, times=None) -> tuple[np.ndarray, int]:
    """Logs of one more than the counts of the features, and the number of words that have any."""
    out, n = np.zeros(len(finder.at)), 0
    for i, places in enumerate(map(finder.__getitem__, words)):
        if places:
            k = times[i] if times else 1
            n += k
            for p in places:
                out[p] += k
    return np.log1p(out), n


def likelihood(x: np.ndarray, counts: np.ndarray, grades: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """Mean log likelihood of ``grades`` and its gradient. ``x`` holds the weights, the first of ``k`` thresholds, and the logs of the steps to the next ones."""
    n, f = counts.shape
    steps = np.exp(x[f + 1 :])
    theta = x[f] + np.concatenate(([0.0], np.cumsum(steps)))
    above = np.concatenate((np.ones((n, 1)), _sigmoid((counts @ x[:f])[:, None] - theta), np.zeros((n, 1))), axis=1)
    at = np.arange(n)
    p = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
    slope = above * (1 - above)  # of each sigmoid
    lower, upper = slope[at, grades], slope[at, grades + 1]
    g_theta = np.zeros((n, k + 2))
    g_theta[at, grades] = -lower / p
    g_theta[at, grades + 1] = upper / p
    by_theta = g_theta[:, 1 : k + 1].sum(0)
    tail = np.cumsum(by_theta[::-1])[::-1]  # a step moves its own and all later thresholds
    return float(np.log(p).mean()), np.concatenate((counts.T @ ((lower - upper) / p), tail[:1], tail[1:] * steps)) / n


def train(counts: np.ndarray, grades: np.ndarray, words: dict[bytes, int], ridge: float) -> Model:
    """Maximum likelihood with a ridge on the weights, by Adam; thresholds stay ordered as sums of positive steps."""
    k = max(1, int(grades.max(initial=0)))
    n, f = counts.shape
    x = np.zeros(f + k)
    x[f] = 1.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, STEPS + 1 if n else 1):
        _, grad = likelihood(x, counts, grades, k)
        grad[:f] -= ridge * x[:f]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x += STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(words, x[:f], x[f] + np.concatenate(([0.0], np.cumsum(np.exp(x[f + 1 :])))))


def best_ridge(counts: np.ndarray, grades: np.ndarray, words: dict[bytes, int]) -> float:
    """The ridge under which folds of the fitted sample, each left out in turn, are likeliest."""
    if len(grades) < 20 * FOLDS:
        return RIDGES[0]
    fold = np.arange(len(grades)) % FOLDS

    def score(ridge: float) -> float:
        total = 0.0
        for k in range(FOLDS):
            model = train(counts[fold != k], grades[fold != k], words, ridge)
            above = np.concatenate((np.ones((int((fold == k).sum()), 1)), model.above(counts[fold == k]), np.zeros((int((fold == k).sum()), 1))), axis=1)
            g, at = np.minimum(grades[fold == k], len(model.thresholds)), np.arange(len(above))
            total += float(np.log(np.maximum(above[at, g] - above[at, g + 1], 1e-12)).sum())
        return total

    return max(RIDGES, key=score)


def fit(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", most: dict[int, int] | None = None) -> Model:
    """Learns from a bounded sample of the labelled texts outside the held-out fold: of each grade of ``grade_col`` (0, 1, ...) at most ``most``, SAMPLE by default.

    Grades are the labels': as many thresholds are learned as the labels have grades above 0. Labels that only
    say toxic or not have one.
    """
    sample, _ = labelled_sample(docs, labels, grade_col, SAMPLE if most is None else most)

    def pack(batches):
        for b in batches:
            bags = [Counter(words_of(t.as_py())) for t in b.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([list(c) for c in bags], pa.list_(pa.binary())), pa.array([list(c.values()) for c in bags], pa.list_(pa.int32()))], ["doc_id", "label", "words", "n"]
            )

    rows = sorted(sample.mapInArrow(pack, "doc_id long, label int, words array<binary>, n array<int>").collect(), key=lambda r: r["doc_id"])
    grades = np.array([r["label"] for r in rows], dtype=int)
    bags = [[bytes(w) for w in r["words"]] for r in rows]
    finder = Finder({f: i for i, f in enumerate(indicators(bags, (grades > 0).astype(int).tolist()))})
    counts = np.array([count_features(bag, finder, r["n"])[0] for bag, r in zip(bags, rows, strict=True)]).reshape(len(rows), len(finder.at))
    return train(counts, grades, finder.at, best_ridge(counts, grades, finder.at))


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, grade, toxic, n_terms) for each row of ``docs``.

    severity is the expected grade, grade the number of thresholds that are passed more likely than not, toxic
    whether it is above 0, n_terms the text's indicator words. Null and empty texts have no words, and so the
    least severity.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        finder = Finder(model.words)
        for b in batches:
            if not b.num_rows:
                continue
            pairs = [count_features(words_of(t.as_py() or b""), finder) for t in b.column(1).cast(pa.large_binary())]
            above = model.above(np.array([c for c, _ in pairs]).reshape(b.num_rows, len(model.words)))
            grade = (above >= 0.5).sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(1)), pa.array(grade), pa.array(grade > 0), pa.array([n for _, n in pairs], pa.int64())], ["id", "severity", "grade", "toxic", "n_terms"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, severity double, grade int, toxic boolean, n_terms long")
