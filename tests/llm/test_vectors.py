"""Recall of the embedding search for pairs of known cosine, and how far it moves the vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import vectors


def pairs_at(cosine, n, dim, rng):
    """``n`` unit vectors and partners of theirs at exactly ``cosine``."""
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("dim", [32, 128])
def test_recall_of_planted_pairs(spark, dim):
    """300 pairs at each cosine among 3,000 others, each row's links known from brute force."""
    rng = np.random.default_rng(dim)
    cosines, n = (0.9505, 0.955, 0.965, 0.98, 0.995), 300
    planted = [x for c in cosines for x in pairs_at(c, n, dim, rng)]
    x = np.concatenate([*planted, rng.normal(size=(3000, dim))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert vectors.make_plan(len(x), 0.95).lists > 2  # several lists, not one that holds all
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.id: r for r in vectors.vector_groups(df).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all()
    for k, c in enumerate(cosines):
        at = slice(2 * n * k, 2 * n * (k + 1))
        assert found[at].sum() >= 0.99 * want[at].sum(), c
        first = range(2 * n * k, 2 * n * k + n)
        assert sum(got[i].component_id == got[i + n].component_id for i in first) >= 0.99 * n, c


def test_single_and_double_precision_agree(spark):
    """Vectors of floats travel as floats and are compared in double precision, as the same values given as doubles are."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24)).astype(np.float32)
    x = np.concatenate([base + np.float32(s) * rng.normal(size=base.shape).astype(np.float32) for s in (0, 0.05, 0.2, 0.3)])
    x[7] *= np.float32(1e30)  # squares beyond single precision
    x[8] *= np.float32(1e-30)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    single = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    double = single.withColumn("embedding", F.col("embedding").cast("array<double>"))
    a, b = (sorted(map(tuple, vectors.vector_groups(df).collect())) for df in (single, double))
    assert a == b and sum(r[1] for r in a) > 100


def test_vectors_are_fetched_once(spark, monkeypatch):
    """Only ids and cells are laid out by list; the table of vectors is read where equal ones merge, placed, sent and named."""
    kept = {}
    keep = vectors.Scratch.keep

    def watch(self, df, name):
        kept[name] = df
        return keep(self, df, name)

    monkeypatch.setattr(vectors.Scratch, "keep", watch)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    vectors.vector_groups(df)
    assert kept["placed"].columns == ["rep", "cell"]
    plan = kept["found"]._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "vec#" in line for line in plan.splitlines()) == 1
