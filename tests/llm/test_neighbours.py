"""Tables on which an index that knows only the bulk of the rows misses neighbours: recall against brute force."""

import numpy as np
from pyspark.sql import functions as F

from lumenscreen.llm import ann


def recall(spark, x):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in range(0, len(x), 50):
        near = u @ u[q]
        near[q] = -9
        want |= {(q, int(j)) for j in np.argsort(-near)[:5]}
    assert len(got) == len(want)
    return len(got & want) / len(want)


def test_neighbours_within_tight_groups(spark):
    # A group is larger than what is reranked at least, and closer than its codes' errors.
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4, 16))[rng.integers(0, 4, 6000)] + 1e-3 * rng.normal(size=(6000, 16))
    assert recall(spark, x) >= 0.95


def test_queries_that_are_unlike_most_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 6000)] + 0.02 * rng.normal(size=(6000, 16))
    rare = np.arange(6000) % 50 < 3
    x[rare] = rng.normal(size=(rare.sum(), 16))
    assert recall(spark, x) >= 0.95
