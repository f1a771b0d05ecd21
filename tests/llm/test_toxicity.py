"""Fit, scores and located sentences, and held-out accuracy."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from authsignal.llm import toxicity


@pytest.fixture(scope="module")
def planted():
    """Documents of many sentences, of which one offends where the label is 1."""
    draw = random.Random(3)
    plain = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(1500):
        sentences = [[draw.choice(plain) for _ in range(draw.randint(3, 12))] for _ in range(draw.randint(1, 12))]
        toxic = int(draw.random() < 0.2)
        if toxic:
            draw.choice(sentences).append(draw.choice(["vilething", "nastyperson", "fouls" + draw.choice("abcdefgh") * 3]))
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + ".", toxic))
    return rows


@pytest.fixture(scope="module")
def model(spark, documents, planted):
    labels = spark.createDataFrame([(i, toxic, "x") for i, _, toxic in planted], "doc_id long, toxic int, text string")
    return toxicity.learn(documents([r[:2] for r in planted]), labels, keep=~toxicity.held_out())


def test_held_out_accuracy(spark, documents, planted, model):
    scored = {r.doc_id: r for r in toxicity.score(documents([r[:2] for r in planted]), model).collect()}
    away = [(scored[i], toxic) for i, _, toxic in planted if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(away) > 200
    assert np.mean([(r.score >= 0.5) == bool(toxic) for r, toxic in away]) > 0.98


def test_offending_sentences_are_located(spark, documents, planted, model):
    text = "all is well here. ünï what a vilething you are! the end"
    (row,) = toxicity.score(documents([(1, text)]), model).collect()
    (span,) = row.spans
    assert text.encode()[span.start : span.end].decode().strip() == "ünï what a vilething you are"
    assert row.score >= span.score - 1e-12 >= 0.5


def test_score_is_the_noisy_or(spark, documents, model):
    one, two = (toxicity.judged(t, toxicity.Known(model.weights), model.weights, model.bias)[0] for t in ("vilething", "word1"))
    both = toxicity.judged("vilething. word1", toxicity.Known(model.weights), model.weights, model.bias)[0]
    assert both == pytest.approx(1 - (1 - one) * (1 - two))


def test_labels_of_held_out_rows_teach_nothing(spark, documents, planted, model):
    flipped = [(i, 1 - toxic if zlib.crc32(str(i).encode()) % 5 == 0 else toxic) for i, _, toxic in planted]
    labels = spark.createDataFrame(flipped, "doc_id long, toxic int")
    again = toxicity.learn(documents([r[:2] for r in planted]), labels, keep=~toxicity.held_out())
    assert again.weights == model.weights and again.bias == model.bias


def test_reject_keeps_clean_rows_as_they_are(spark, documents, planted, model):
    docs = documents([(1, "a nice day"), (2, "you vilething"), (3, None), (None, "")])
    assert sorted(map(str, toxicity.reject(docs, model).collect())) == sorted(map(str, docs.where("doc_id IS NULL OR doc_id <> 2").collect()))


def test_odd_rows(spark, documents, odd_texts, model):
    got = toxicity.score(documents(odd_texts), model).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(documents([]), model).collect() == []


def test_no_usable_labels(spark, documents):
    docs = documents([(1, "a"), (2, "b")])
    for rows in ([], [(1, None), (None, 1), (2, 7)], [(1, 0), (2, 0)]):
        model = toxicity.learn(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]


def plain_score(text, model):
    """Noisy-or of a logistic model over the sentences, written out from the text alone."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        sentence = "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() or c.isdigit() else " " for c in sentence)
        names = set()
        for word in sentence.split(" "):
            raw = word.encode()
            names |= {raw, raw[:5] + b"*" if len(raw) > 5 else raw, raw[:6] + b"*" if len(raw) > 6 else raw, raw[:7] + b"*" if len(raw) > 7 else raw}
        z = model.bias + sum(model.weights.get(name, 0.0) for name in names)
        clean *= 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return 1 - clean


def test_scores_against_plain_python(spark, documents, planted, odd_texts, model):
    rows = [r[:2] for r in planted[:300]] + [(10_000 + k, t) for k, (_, t) in enumerate(odd_texts)]
    got = {r.doc_id: r.score for r in toxicity.score(documents(rows), model).collect()}
    assert got == pytest.approx({i: plain_score(t, model) for i, t in rows}, abs=1e-9)


def test_sample_is_bounded(spark, documents, planted):
    """One id repeated a thousand times is one row of the fit, and marks are bounded as well."""
    again = [(planted[0][0], f"{planted[0][1]} again {k}") for k in range(1000)]
    labels = spark.createDataFrame([(i, toxic) for i, _, toxic in planted], "doc_id long, toxic int")
    limits = toxicity.Limits(documents=50, rounds=1, least_documents=1)
    seen = []
    keep = toxicity.instances
    try:
        toxicity.instances = lambda sample, words: seen.append(sample.count()) or keep(sample, words)
        toxicity.learn(documents([r[:2] for r in planted] + again), labels, limits)
    finally:
        toxicity.instances = keep
    assert seen == [50]
    rows = spark.createDataFrame([(k, [1] * 10) for k in range(30)], "doc_id long, places array<int>")
    assert [toxicity.bounded(rows, marks).count() for marks in (0, 9, 10, 205, 300, 999)] == [0, 0, 1, 20, 30, 30]


def test_rows_without_an_id(spark, documents, model):
    (row,) = toxicity.score(documents([(None, "vilething")]), model).withColumn("held_out", toxicity.held_out()).collect()
    assert row.held_out is False and row.score >= 0.5


def test_query(spark):
    from authsignal.llm.queries import op2_toxicity
    from tests.conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = op2_toxicity(spark, SMALL).collect()
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    away = [r.predicted == known[r.doc_id] for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert np.mean(away) > 0.9
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
