"""Fingerprints and classes against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from authsignal.config import ScaleLimits
from authsignal.llm import simhash
from authsignal.llm.graph import components, flat_labels, lowest_of_class
from tests.conftest import SMALL


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(ids, marks, radius):
    """Smallest id reachable, by spreading minima until nothing changes."""
    marks = np.array(marks, dtype=np.uint64)
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= radius
    found = np.array([i if i is not None else 1 << 60 for i in ids])
    while True:
        new = np.array([found[row].min() for row in near])
        if (new == found).all():
            return [None if f == 1 << 60 else int(f) for f in found]
        found = new


def test_query_against_brute_force(spark):
    from authsignal.llm.queries import op10_simhash

    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    marks = [plain_fingerprint(t) for t in docs.text]
    want = dict(zip(docs.doc_id, zip((f"{m:016x}" for m in marks), plain_classes(docs.doc_id, marks, 2))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash(spark, SMALL).collect()}
    assert got == want


def test_near_marks_in_small_tiles(spark):
    """Marks around a few centres, so that many differ by few bits, in tiles of four."""
    draw = random.Random(5)
    marks = set()
    for centre in (0, 0xFFFF, draw.getrandbits(64), 0xFFFFFFFFFFFFFFFF):
        for _ in range(60):
            mark = centre
            for _ in range(draw.randint(0, 4)):
                mark ^= 1 << draw.randrange(64)
            marks.add(mark)
    marks = sorted(marks)
    signed = np.array(marks, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"), 2, size=4)
    roots = {r.node: r.root for r in components(edges).collect()}
    want = plain_classes(signed, marks, 2)
    groups = {}
    for mark, lowest in zip(signed, want):
        groups.setdefault(lowest, set()).add(roots.get(mark, mark))
    assert all(len(found) == 1 for found in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_odd_rows(spark, documents, odd_texts):
    got = simhash.near_duplicates(documents(odd_texts)).collect()
    marks = [plain_fingerprint(t) for _, t in odd_texts]
    want = plain_classes([i for i, _ in odd_texts], marks, 2)
    signed = np.array(marks, dtype=np.uint64).view(np.int64).tolist()
    key = lambda row: tuple((v is not None, v or 0) for v in row)
    rows = zip((i for i, _ in odd_texts), signed, want)
    assert sorted(map(tuple, got), key=key) == sorted(rows, key=key)


def test_empty_table(spark, documents):
    assert simhash.near_duplicates(documents([])).collect() == []


def test_labels_of_a_chain():
    n = 500
    order = np.random.default_rng(1).permutation(n)
    labels = flat_labels(order[:-1], order[1:], np.arange(n))
    assert (labels == 0).all()


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({roots[k] for k in range(301)}) == 1
    assert len({roots[k] for k in range(1000, 1050)}) == 1
    assert len(set(roots.values())) == 2


def test_only_narrow_plans(spark, documents):
    plan = simhash.near_duplicates(documents([(1, "a b c")]))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def spread_of(df):
    """Rows of each task that has any."""
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())


@pytest.fixture
def plain_exchanges(spark):
    """Sixteen partitions that are neither merged nor broadcast, so that a hot key shows."""
    wanted = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_class_is_spread(spark, plain_exchanges):
    """A third of all nodes in one class, as a star, beside chains of two: no task takes the class."""
    limits = ScaleLimits(broadcast_bytes=0, hot_rows=8)
    n = 3000
    edges = [(0, k) for k in range(1, n // 3)] + [(k, k + 1) for k in range(n // 3, n, 2)]
    edges = spark.createDataFrame(edges, "a long, b long")
    found = components(edges, limits)
    roots = {r.node: r.root for r in found.collect()}
    assert len(roots) == n + n % 2 and len({roots[k] for k in range(n // 3)}) == 1
    assert len(set(roots.values())) == 1 + (n - n // 3 + 1) // 2
    members = spark.range(n).select(F.col("id").alias("node"), (F.col("id") + 7).alias("first_id"))
    lowest = lowest_of_class(members, found, "node", limits)
    got = {r.node: r.lowest for r in lowest.collect()}
    assert all(got[k] == 7 for k in range(n // 3)) and all(got[k] == k - (k - n // 3) % 2 + 7 for k in range(n // 3, n))
    tasks = spread_of(lowest)
    assert len(tasks) == 16 and tasks[-1] <= 2 * tasks[8]


def test_class_of_a_third_of_the_rows(spark, documents):
    rows = [(k, "the same text for all of these") for k in range(200)] + [(1000 + k, f"t{k} " * 3 + f"u{k * 7} v{k * 13}") for k in range(400)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(rows)).collect()}
    marks = np.array([plain_fingerprint(t) for _, t in rows], dtype=np.uint64)
    assert got == dict(zip((i for i, _ in rows), plain_classes([i for i, _ in rows], marks, 2)))
