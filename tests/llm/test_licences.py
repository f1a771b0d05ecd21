"""Automata against a recursive matcher, and the query against plain counts."""

import random
import re

import pandas as pd
import pytest

from authsignal.llm import licences
from tests.conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_query_against_plain_counts(spark):
    from authsignal.llm.queries import op5_licences

    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in op5_licences(spark, SMALL).collect()}
    assert any(r.labels for r in got.values())
    for doc_id, text in zip(docs.doc_id, docs.text):
        words, starts, labels = plain_words(text), [], set()
        for phrase, label in licences.PHRASES.items():
            want = phrase.split()
            own = [k for k in range(len(words)) if words[k : k + len(want)] == want]
            starts += own
            labels |= {label} if own else set()
        row = got[doc_id]
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(starts), ",".join(sorted(labels)))
        assert (row.first_word, row.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1


@pytest.mark.parametrize(
    "template, pattern",
    [
        ("a b c", "a b c"),
        ("a <<beginOptional>>b<<endOptional>> c", "a (b )?c"),
        ("a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> a", "a (b (c )?d )?a"),
        ('a <<var;name="x";match="1-3">> b', "a (\\w ){1,3}b"),
        ('a <<var;match="0-2">> <<beginOptional>>b<<endOptional>>', "a( \\w){0,2}( b)?"),
        ('<<beginOptional>>a b<<endOptional>> c <<var;match="2-2">> d', "(a b )?c (\\w ){2}d"),
        ('a <<var;name="x";match=".*">> b', "a (\\w )*b"),
        ('a <<var;name="x";original="q; r";match=".+">> b c', "a (\\w )+b c"),
        ('a <<var;match=".{0,5}">> b', "a (\\w ){0,3}b"),
        ('a <<var;match=".{2,7}">><<var;match="0-1">> b <<var;match=".*">>', "a (\\w ){1,5}b( \\w)*"),
        ('a <<beginOptional;name="t">>b <<var;match=".{1,6}">><<endOptional;x="y">> d', "a (b (\\w ){1,3})?d"),
        ('a <<var;match="b c|d">> a', "a (b c|d) a"),
        ('<<var;match="a b|c|">> d <<var;match=".{1,}">> a', "(a b |c )?d (\\w )+a"),
    ],
)
def test_templates_equal_patterns(template, pattern):
    own = licences.compile_template("t", template)
    draw = random.Random(4)
    for _ in range(400):
        words = [draw.choice("abcd") for _ in range(draw.randint(0, 14))]
        want = []
        for start in range(len(words)):
            ends = [e for e in range(start + 1, len(words) + 1) if re.fullmatch(pattern, " ".join(words[start:e]))]
            if ends:
                want.append((start, max(ends)))
        assert licences.places(own, [w.encode() for w in words]) == want


@pytest.mark.parametrize(
    "bad",
    [
        "<<beginOptional>>a", "<<odd>> a", "<<endOptional>> a", "a <<endOptional>>", '<<var;match="0-3">> a',
        "<<beginOptional>>a<<endOptional>>", "", 'a <<var;match="3-1">> b', 'a <<var;match=".{9,2}">> b', "a <<variable>> b",
        'a <<var;match="[0-9]+">> b', 'a <<var;match="(b|c)">> d', "a <<var;match=.+>> b", 'a <<var;match="">> b',
    ],
)
def test_bad_templates_are_refused(bad):
    with pytest.raises(ValueError):
        licences.compile_template("bad", bad)


def test_many_starts_in_one_loop():
    own = licences.compile_template("t", 'a <<var;match=".*">> z')
    words = [b"a", b"b"] * 2000 + [b"z"]
    assert licences.places(own, words) == [(k, 4001) for k in range(0, 4000, 2)]


def test_whole_licence_texts(spark, documents):
    mit = """The MIT License (MIT)

Copyright (c) 2001-2019 Ada Lovelace, Grace Hopper, Mary Jackson, Katherine Johnson and Dorothy Vaughan

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    isc = """ISC License Copyright (c) 2004, Some Body. Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    cases = [(1, mit), (2, mit.replace("WITHOUT WARRANTY", "WITH WARRANTY")), (3, isc), (4, isc.replace("hereby", "")), (5, mit[200:])]
    got = {r.doc_id: r for r in licences.scan(documents(cases)).collect()}
    assert [got[k].labels for k in range(1, 6)] == ["mit,mit-permission", "mit-permission", "isc", "", ""]
    assert got[1].score == 1 and got[3].score == 1


def test_score_is_the_share_of_covered_words(spark, documents):
    text = "x y under the MIT license copyright z all rights reserved q CC-BY-NC 4.0 r"
    (row,) = licences.scan(documents([(1, text)])).collect()
    assert [(s.label, s.start, s.end) for s in row.spans] == [
        ("mit", 2, 6), ("mit-notice", 2, 11), ("cc-by-nc", 12, 15), ("cc-by-nc-4.0", 12, 17),
    ]
    assert row.score == pytest.approx((9 + 5) / 18)


def test_mandatory_words_must_match(spark, documents):
    good = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
    bad = good.replace("may not", "may")
    got = {r.doc_id: r.labels for r in licences.scan(documents([(1, good), (2, bad)])).collect()}
    assert got == {1: "apache-2,apache-2.0,apache-2.0-notice", 2: "apache-2,apache-2.0"}


def test_odd_rows(spark, documents, odd_texts):
    many = "under the MIT license " * 5000
    got = licences.scan(documents([*odd_texts, (20, many)])).collect()
    assert len(got) == len(odd_texts) + 1
    row = next(r for r in got if r.doc_id == 20)
    assert (row.n_base, row.first_word, row.last_word, row.base_labels) == (5000, 0, 19996, "mit")
    assert all(r.labels == "" and r.score == 0 for r in got if r.doc_id != 20)
    assert licences.scan(documents([])).collect() == []
