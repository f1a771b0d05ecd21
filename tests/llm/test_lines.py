"""Line dedup against all runs of all documents."""

import random

import pytest

from authsignal.llm import lines
from tests.conftest import SMALL


def brute(docs, least):
    """Removes each line that lies in a run of enough words which also stands at an earlier place."""
    seen, gone = {}, {}
    for n, (doc_id, text) in enumerate(docs):
        places = [(k, line.strip()) for k, line in enumerate(text.split("\n")) if line.strip()]
        gone[n] = set()
        for s in range(len(places)):
            words = 0
            for e in range(s, len(places)):
                words += len(places[e][1].split())
                if words >= least:
                    run = tuple(line for _, line in places[s : e + 1])
                    if seen.setdefault(run, (n, s)) != (n, s):
                        gone[n] |= {k for k, _ in places[s : e + 1]}
    return {
        doc_id: ("\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone[n]), len(gone[n]))
        for n, (doc_id, text) in enumerate(docs)
    }


def result(df):
    return {r.doc_id: (r.text, r.removed_lines) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(spark, documents, seed):
    draw = random.Random(seed)
    base = [" ".join(draw.choice("abcd") for _ in range(draw.choice([1, 2, 3, 5, 9, 14]))) for _ in range(14)]
    docs = []
    for i in range(60):
        text = []
        while len(text) < draw.randint(0, 25):
            if docs and draw.random() < 0.4:
                other = draw.choice(docs)[1].split("\n")
                k = draw.randint(0, len(other))
                text += other[k : k + draw.randint(1, 6)]
            else:
                text.append(draw.choice(base) + draw.choice(["", " 1", " 2 "]))
            if draw.random() < 0.1:
                text.append(" ")
        docs.append((i, "\n".join(text)))
    assert result(lines.deduplicate(documents(docs), 12)) == brute(docs, 12)


def test_query_against_brute_force(spark):
    import pandas as pd

    from authsignal.llm.queries import op1_line_dedup

    docs = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")
    want = brute(list(zip(docs.doc_id, docs.text)), 50)
    assert sum(n for _, n in want.values()) > 0
    assert result(op1_line_dedup(spark, SMALL)) == want


def test_passage_in_many_documents(spark, documents):
    passage = " ".join(f"w{k}" for k in range(60))
    docs = [(i, f"start {i}\n{passage}\nend {i}") for i in range(40)]
    got = result(lines.deduplicate(documents(docs)))
    assert got[0] == (docs[0][1], 0)
    assert all(got[i] == (f"start {i}\nend {i}", 1) for i in range(1, 40))


def test_odd_rows(spark, documents, odd_texts):
    got = lines.deduplicate(documents(odd_texts), keep=("lang", "n_chars")).collect()
    assert len(got) == len(odd_texts)
    by_id = {}
    for row in got:
        by_id.setdefault(row.doc_id, []).append(row.text)
        assert row.kept.lang == "en"
    assert by_id[1] == [""] and by_id[2] == [""] and len(by_id[7]) == 3
    assert by_id[4] == [odd_texts[3][1]] and by_id[5] == [""]


def test_repeated_row_is_one_document(spark, documents):
    text = " ".join(map(str, range(60)))
    got = lines.deduplicate(documents([(1, text), (1, text)])).collect()
    assert [r.text for r in got] == [text, text]


def test_empty_table(spark, documents):
    assert lines.deduplicate(documents([])).collect() == []


def test_a_line_chosen_by_several_windows_is_one_place():
    text = "\n".join(f"line {k} of a text" for k in range(40))
    found = list(lines.document_windows(text, 20))
    assert sum(w[4] for w in found) == len({w[2] for w in found}) < len(found)
    # equal lines: every place is chosen by the window that begins there
    same = list(lines.document_windows("\n".join(["a b c d e"] * 12), 20))
    assert sum(w[4] for w in same) == len({w[0] for w in same}) == len(same)
