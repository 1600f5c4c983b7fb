"""Approximate neighbours: recall on vectors with and without structure, hot vectors, odd tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabulark.operators import ann
from tabulark.operators.ann import approximate_knn_join, recall
from tabulark.operators.knn import knn_join


def frame(spark, rows):
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in rows], "id long, v array<double>, label int")


def both(spark, rows, k=5, **more):
    df = frame(spark, rows)
    exact = knn_join(df, df, k, "id", "id", "v", "v", exclude_self=True)
    return approximate_knn_join(df, df, k, "id", "id", "v", "v", exclude_self=True, **more), exact


def test_clustered_vectors_need_a_small_share(spark):
    rng = np.random.RandomState(0)
    centres = rng.standard_normal((40, 16)) * 8
    rows = [(i, centres[i % 40] + rng.standard_normal(16)) for i in range(1200)]
    found, exact = both(spark, rows, share=0.06, block_rows=100)
    assert recall(found, exact) >= 0.95
    got = {(r.query_key, r.neighbour_key): r.distance for r in found.collect()}
    vectors = dict(rows)
    assert all(abs(np.linalg.norm(vectors[a] - vectors[b]) - d) < 1e-9 and a != b for (a, b), d in got.items())


def test_reading_everything_is_exact_up_to_codes(spark):
    rng = np.random.RandomState(1)
    rows = [(i, rng.standard_normal(24)) for i in range(400)]
    found, exact = both(spark, rows, share=1.0, block_rows=64)
    assert recall(found, exact) >= 0.99


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.RandomState(2)
    same = rng.standard_normal(4)
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(4)) for i in range(600)]
    found, exact = both(spark, rows, share=0.5, block_rows=64)
    assert recall(found, exact) >= 0.95
    hot = found.filter("query_key = 300").orderBy("rank").collect()
    assert [r.distance for r in hot] == [0.0] * 5 and [r.neighbour_key for r in hot] == [0, 3, 6, 9, 12]


def test_odd_tables(spark):
    one = frame(spark, [(1, np.ones(3))])
    assert approximate_knn_join(one, one, 2, "id", "id", "v", "v", carry="label").collect()[0]["label"] == 1
    assert approximate_knn_join(one, one, 2, "id", "id", "v", "v", exclude_self=True).count() == 0
    assert approximate_knn_join(one, one.limit(0), 2, "id", "id", "v", "v").count() == 0
    assert approximate_knn_join(one.limit(0), one, 2, "id", "id", "v", "v").count() == 0


def test_queries_of_a_block_are_cut(spark, monkeypatch):
    rng = np.random.RandomState(5)
    df = frame(spark, [(i, rng.standard_normal(6)) for i in range(500)])
    monkeypatch.setattr(ann, "_ASKED", 60)

    monkeypatch.setattr(ann, "BLOCK_BYTES", 24 * 70)
    most, plain = [], type(df).repartition

    def watched(self, number, *columns):
        if "_ask" in columns:
            most.append(self.groupBy(*columns).count().agg(F.max("count")).first()[0])
        return plain(self, number, *columns)

    monkeypatch.setattr(type(df), "repartition", watched)
    assert approximate_knn_join(df, df, 3, "id", "id", "v", "v", share=1.0).count() == 1500
    assert len(most) == 2 and max(most) <= 140
    found, exact = both(spark, list(enumerate(rng.standard_normal((500, 6)))), share=1.0)
    assert recall(found, exact) >= 0.99


def test_candidates_are_the_nearest_codes_of_the_cells_read(monkeypatch):
    monkeypatch.setattr(ann, "_WIDE", 64)
    monkeypatch.setattr(ann, "_MATRIX_CELLS", 640)
    rng = np.random.RandomState(6)
    centres, own = rng.standard_normal((5, 4)), rng.randint(0, 5, 300)
    steps = rng.randint(-127, 128, (300, 4)).astype(np.int8)
    codes = [np.float32(0.01).tobytes() + s.tobytes() for s in steps]
    a, wanted = rng.standard_normal((37, 4)), [sorted(rng.choice(5, 2, replace=False).tolist()) for _ in range(37)]
    asked = pa.table({"_v": a.tolist(), "_cells": wanted})
    rows = pa.table({"_t": np.arange(300), "_cell": own.astype("int32"), "_code": codes})
    q, t, _ = ann._best_codes(asked, rows, centres, 7)
    vectors = centres[own] + steps * np.float32(0.01)
    for i in range(37):
        near = np.where(np.isin(own, wanted[i]), ((a[i] - vectors) ** 2).sum(1), np.inf)
        assert set(t[q == i]) == set(np.argsort(near)[:7])
