"""Quality classifier: averaged vectors of hashed features, softmax output, numpy SGD.

Features are words, their character n-grams, pairs of neighbouring words, and how far back a word occurred last:
the latter is what tells of repetition, for which no single word stands.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows of each class that the model is fitted on, at most: those of the smallest hash of their id.
SAMPLE_PER_CLASS = 1000
BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 18, 8, 6, 1.0, 17
GRAMS = (3, 4)
#: Words whose features a task remembers; the memory starts anew beyond, between parts of texts of so many words.
REMEMBER, PART = 400_000, 100_000


def features(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams, taken with its borders."""
    text = word.decode("utf-8", "replace")
    out, bordered = [crc32(word) % BUCKETS], f"<{text}>"
    for n in GRAMS:
        out += [crc32(bordered[i : i + n].encode()) % BUCKETS for i in range(len(bordered) - n + 1)]
    return out


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbouring words, of whose CRC-32 ``hashes`` are."""
    with np.errstate(over="ignore"):
        return ((hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS


def distances(words: np.ndarray) -> np.ndarray:
    """Buckets of how far back each word occurred last, by powers of two; words that are new to the text have none."""
    order = np.argsort(words, kind="stable")
    again = words[order[1:]] == words[order[:-1]]
    return (_DISTANCE + np.frexp((order[1:] - order[:-1])[again])[1].astype(np.int64)) % BUCKETS


_DISTANCE = crc32(b"\x00distance")


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features, and how often each occurs."""
    words = text.split()
    single = np.array([f for w in words for f in features(w)], np.int64)
    hashes = np.array([crc32(w) for w in words], np.uint64)
    return np.unique(np.concatenate((single, pairs(hashes), *(distances(hashes[k : k + PART]) for k in range(0, len(words), PART)))), return_counts=True)


@dataclass
class Model:
    """Each feature's share of the logit of class 1 (its vector times the difference of the two outputs)."""

    weight: np.ndarray
    bias: float

    def scorer(self):
        """text -> score; keeps the sums of the words met."""
        weight, bias = self.weight.astype(np.float64), self.bias
        sums, sizes, hashes = np.zeros(REMEMBER + PART), np.zeros(REMEMBER + PART, np.int64), np.zeros(REMEMBER + PART, np.uint64)

        class Places(dict):
            def __missing__(self, word):
                at = features(word)
                self[word] = i = len(self)
                sums[i], sizes[i], hashes[i] = weight[at].sum(), len(at), crc32(word)
                return i

        places = Places()

        def score(text: bytes) -> float:
            words, total, n, before = text.split(), 0.0, 0, np.empty(0, np.uint64)
            for k in range(0, len(words), PART):
                if len(places) > REMEMBER:
                    places.clear()
                part = words[k : k + PART]
                at = np.fromiter(map(places.__getitem__, part), np.int64, len(part))
                both = np.concatenate((before, hashes[at]))
                more, before = np.concatenate((pairs(both), distances(both[len(before) :]))), both[-1:]
                total += sums[at].sum() + weight[more].sum()
                n += int(sizes[at].sum()) + len(more)
            logit = bias + (total / n if n else 0.0)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

        return score


def step(vectors: np.ndarray, outputs: np.ndarray, ids: np.ndarray, n: np.ndarray, label: int, rate: float) -> None:
    """One step of gradient descent on the cross entropy of a bag; a feature's step grows with the root of the bag's size, as shares shrink with it."""
    share = n / n.sum()
    mean = share @ vectors[ids]
    z = outputs @ mean
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    back = outputs.T @ p
    outputs -= rate * np.outer(p, mean)
    vectors[ids] -= (rate * math.sqrt(len(ids)) * share)[:, None] * back


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], prior: float) -> Model:
    """Fits vectors and outputs by stochastic gradient descent on bags of (features, counts).

    The sample may hold the classes in other shares than the corpus does; ``prior``, the share of class 1
    among all labelled rows, sets the bias right.
    """
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    outputs = np.zeros((2, DIM))
    steps, done = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - done / steps)
            done += 1
            if len(bags[i][0]):
                step(vectors, outputs, *bags[i], labels[i], rate)
    ones = sum(labels)
    offset = math.log(prior / (1 - prior)) - math.log((ones + 1) / (len(labels) - ones + 1))
    return Model((vectors @ (outputs[1] - outputs[0])).astype(np.float32), offset)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of a bounded sample of the labelled rows outside the held-out fold, and the rows of each class.

    Rows with a null or other label, and ids with contradicting labels, are left out.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(*per_class) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
        .filter("label = other")
        .select("doc_id", "label")
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picks = None
    for label, most in per_class.items():
        pick = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)
        picks = pick if picks is None else picks.union(pick)
    # sum(per_class) rows at most, so that they may be broadcast
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picks), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), counts


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Learns from at most 2 * SAMPLE_PER_CLASS labelled texts, whose features are counted on the executors."""
    sample, counts = labelled_sample(docs, labels, label_col, {0: SAMPLE_PER_CLASS, 1: SAMPLE_PER_CLASS})

    def count(batches):
        for b in batches:
            rows = [[x.astype(np.int32).tobytes() for x in bag(t.as_py())] for t in b.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "label", "ids", "n"])

    rows = sorted(sample.mapInArrow(count, "doc_id long, label int, ids binary, n binary").collect(), key=lambda r: r["doc_id"])
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 1) / (total + 2)
    return train([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["n"], np.int32).astype(float)) for r in rows], [r["label"] for r in rows], prior)


def quality_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a last column ``score_col``, from 0 to 1. Null and blank texts get the score of no features at all.

    A column of that name is replaced.
    """
    docs = docs.drop(score_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches):
        score = held.value.scorer()
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([score(t.as_py() or b"") for t in texts], pa.float64())], names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, schema)
