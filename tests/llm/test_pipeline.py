"""The stages one after the other, against plain versions of what they must keep."""

import pandas as pd
import pytest

import corpus_pipeline
from authsignal.functions.shared import written
from authsignal.llm import toxicity
from tests.conftest import SMALL
from tests.llm.test_lines import brute
from tests.llm.test_simhash import plain_classes, plain_fingerprint
from tests.llm.test_tokens import check_pieces, plain_ids


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
        found.append(docs.toPandas())
    return found


def test_toxic_documents_go(spark, steps):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), keep=~toxicity.held_out())
    clean = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
    assert set(steps[1].doc_id) == clean and len(clean) < len(steps[0])
    pd.testing.assert_frame_equal(
        steps[1].sort_values("doc_id").reset_index(drop=True),
        steps[0][steps[0].doc_id.isin(clean)].sort_values("doc_id").reset_index(drop=True),
    )


def test_repeated_lines_go(steps):
    rows = steps[1].sort_values("doc_id")
    want = {i: text for i, (text, _) in brute(list(zip(rows.doc_id, rows.text)), 50).items()}
    assert dict(zip(steps[2].doc_id, steps[2].text)) == want
    assert (steps[2].n_chars == steps[2].text.map(len)).all()


def test_one_of_each_group_stays(steps):
    classes = plain_classes(steps[2].doc_id, [plain_fingerprint(t) for t in steps[2].text], 2)
    assert sorted(steps[3].doc_id) == sorted(set(classes))
    assert list(steps[3].columns) == list(corpus_pipeline.DOCUMENT)


def test_all_that_is_left_is_packed(steps):
    ids = dict(zip(steps[3].doc_id, plain_ids(steps[3].text)))
    check_pieces(list(steps[4].itertuples()), ids, 4096)


def test_odd_rows(spark, documents, odd_texts):
    docs = documents(odd_texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), name)
        assert docs.columns == list(corpus_pipeline.DOCUMENT)
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in docs.collect())
    # 2 and 3 have no words like 1, 5 loses all its lines to 4; documents without an id stay
    assert kept == [(False, 0), (False, 0), (True, 1), (True, 4), (True, 6), (True, 7), (True, 7), (True, 7), (True, 8), (True, 9)]


def test_empty_table(spark, documents):
    docs = documents([])
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
    assert docs.collect() == []
