"""Vector join and search against all pairs."""

import re

import numpy as np
import pandas as pd
import pytest

from authsignal.llm import ann, vector_join
from tests.conftest import SMALL

VECTOR = "vec_id long, embedding array<float>, label int, rep long, dim string, block int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "d", 2, 3) for i, v, label in rows], VECTOR)


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.asarray(a, dtype=np.float32).astype(float), np.asarray(b, dtype=np.float32).astype(float)
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))


def all_pairs(rows, least):
    n = len(rows)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b) and cosine(a, b) >= least:
                links[i].add(j)
                links[j].add(i)
    found = [r[0] for r in rows]
    while True:
        new = [min([found[i], *(found[j] for j in links[i])]) for i in range(n)]
        if new == found:
            return sorted((r[0], len(links[k]), found[k], r[0] == found[k]) for k, r in enumerate(rows))
        found = new


def clustered(n, dim, seed):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((6, dim))
    rows = centres[draw.integers(0, 6, n)] + draw.standard_normal((n, dim)) * draw.choice([0.05, 0.2, 0.6], n)[:, None]
    rows[n // 2 : n // 2 + 20] = rows[0]
    return rows.astype(np.float32).astype(float)


@pytest.mark.parametrize("block, leaf", [(1024, 128), (16, 4)])
def test_join_equals_all_pairs(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(vector_join, "BLOCK", block)
    monkeypatch.setattr(vector_join, "LEAF", leaf)
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(clustered(240, 8, 1))]
    got = vector_join.near_duplicates(vectors(spark, rows), 0.93).collect()
    assert sorted(map(tuple, got)) == all_pairs(rows, 0.93)


def odd_vectors():
    big = [3e38, 1e38, 0.0]
    return [
        (0, [1.0, 0.0, 0.0], 1), (1, [2.0, 0.01, 0.0], 1), (2, [1.0, 0.0, 0.0], None), (3, None, 1), (4, [], 1),
        (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, [float("inf"), 1.0, 0.0], 1),
        (9, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 2), (11, big, 2), (12, [3e-38, 1e-38, 0.0], 2), (13, [1.0, 0.0, 0.0], 1),
        (14, [-1.0, 0.0, 0.0], 1), (14, [-1.0, 0.0, 0.0], 1), (15, [-0.0, 1.0, 0.0], 1), (16, [0.0, 1.0, 0.0], 1),
    ]


def test_join_of_odd_rows(spark):
    rows = odd_vectors()
    got = vector_join.near_duplicates(vectors(spark, rows), 0.93).collect()
    assert sorted(map(tuple, got)) == all_pairs(rows, 0.93)
    assert vector_join.near_duplicates(vectors(spark, []), 0.93).collect() == []


def test_join_of_large_groups(spark):
    """A third near each other, a third copies of one vector, and a third that takes no part, all of one label."""
    draw = np.random.default_rng(4)
    near = (np.eye(8)[0] + draw.standard_normal((300, 8)) * 0.02).tolist()
    rows = [(k, v, 1) for k, v in enumerate(near + [np.eye(8)[3].tolist()] * 300 + [None] * 150 + [[0.0] * 8] * 150)]
    got = vector_join.near_duplicates(vectors(spark, rows), 0.93).collect()
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows) == len(found)
    assert found == {k: (299, k - k % 300, k % 300 == 0) if k < 600 else (0, k, True) for k in range(900)}


def test_join_query(spark):
    from authsignal.llm.queries import op8_vector_join

    table = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    rows = list(zip(table.vec_id.tolist(), table.embedding.tolist(), table.label.tolist()))
    assert sorted(map(tuple, op8_vector_join(spark, SMALL).collect())) == all_pairs(rows, 0.93)


def nearest_rows(rows, asked, most):
    """Exact nearest by id: of repeated ids the vector that sorts first."""
    own = {}
    for i, v, _ in rows:
        if i is not None and usable(v) and (i not in own or v < own[i]):
            own[i] = v
    found = {}
    for q in filter(asked, own):
        scored = sorted((-cosine(own[q], v), i) for i, v in own.items() if i != q and len(v) == len(own[q]))
        found[q] = [(i, -s) for s, i in scored[:most]]
    return found


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in rows}) for q, rows in want.items())
    return hits / sum(map(len, want.values()))


def grouped(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def test_search_query_recall(spark):
    from authsignal.llm.queries import op9_neighbours

    table = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    rows = list(zip(table.vec_id.tolist(), table.embedding.tolist(), table.label.tolist()))
    want, got = nearest_rows(rows, lambda i: i % 50 == 0, 5), grouped(op9_neighbours(spark, SMALL))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9
    exact = {i: v for i, v, _ in rows}
    for q, found in got.items():
        assert all(score == pytest.approx(cosine(exact[q], exact[i]), abs=1e-12) for i, score in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_search_in_small_blocks(spark):
    from pyspark.sql import functions as F

    rows = [(k, v.tolist(), 1) for k, v in enumerate(clustered(400, 70, 2))]
    settings = ann.Settings(block=32, queries=8)
    got = grouped(ann.neighbours(vectors(spark, rows), F.col("vec_id") % 9 == 0, 7, settings))
    want = nearest_rows(rows, lambda i: i % 9 == 0, 7)
    assert set(got) == set(want) and recall(got, want) >= 0.95


def test_bounds_hold_for_most(spark):
    rows = clustered(2000, 64, 3)
    centre = np.zeros(64)
    turn = ann.rotation(64, 42)
    assert np.allclose(turn @ turn.T, np.eye(64))
    code, far, own = ann.codes(rows, centre, turn)
    queries = ann.Queries(rows[5:25], centre, turn, ann.Settings())
    ones = np.bitwise_count(code).sum(axis=1).astype(float)
    estimates, errors = queries.estimates(code, own, ones)
    true = ann.centred(rows[5:25], centre)[0] @ ann.centred(rows, centre)[0].T
    assert estimates.shape == errors.shape == true.shape
    assert (np.abs(estimates - true) <= errors).mean(axis=1).min() > 0.9


def test_more_queries_make_more_tasks(spark):
    """Each task searches a bounded number of blocks, however many queries there are."""
    rows = vectors(spark, [(k, v.tolist(), 1) for k, v in enumerate(clustered(512, 8, 6))])
    settings = ann.Settings(block=64, queries=16, together=2)
    own = ann.candidates(rows, "vec_id", "embedding")
    index = ann.build_index(own, np.zeros(8), settings)
    tasks = []
    for asked in (32, 512):
        found = ann.search(index, own.where(f"vec_id < {asked}"), np.zeros(8), 3, settings)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        tasks.append(int(re.search(r"RepartitionByExpression \[dim.*?\], (\d+)", plan)[1]))
        assert found.count() == 3 * asked
    assert tasks[1] >= 8 * tasks[0]


def test_search_of_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = odd_vectors() + [(None, [1.0, 0.0, 0.0], 1), (14, [-1.0, 0.5, 0.0], 1)]
    got = grouped(ann.neighbours(vectors(spark, rows), F.lit(True), 3))
    want = nearest_rows(rows, lambda i: True, 3)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert ann.neighbours(vectors(spark, []), F.lit(True), 3).collect() == []
