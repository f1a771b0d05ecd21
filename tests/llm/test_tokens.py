"""The token file, packing and both encoders against the tokenizer libraries."""

import base64
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from authsignal.functions.shared import new_path
from authsignal.llm import bpe, packing, tokens
from authsignal.llm.encoding import encoder
from tests.conftest import SMALL

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "B", " ", "\n", "\t", "'", "'s", "'re", "'ll", "'ve", "s", "t", "l", "e", "v", "r", "é", "́", "\x85"]
PARTS += ["​", "　", "1", "٣", "!", "<|endoftext|>", "中", "ﬁ", "😀", "\x1c", "\xa0", "İ", "ß", "Ünï", "×"]


def odd_strings(n=3000):
    draw = random.Random(7)
    made = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 25))) for _ in range(n)]
    return made + ["", " ", "ab" * 3000, "a" * 5000, " " * 4000 + "x", "it's", "'s's", "x \n", "'ve've", "''s"]


def plain_ids(texts):
    found = Tokenizer.from_file(WORDS).encode_batch(list(texts), add_special_tokens=False)
    return [np.array([*one.ids, 2], dtype="<u4") for one in found]


def plain_bpe():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_equal_the_library():
    texts = odd_strings()
    want = [ids[:-1].tobytes() for ids in plain_ids(texts)]
    assert encoder(WORDS).encode(texts) == want


def test_bytes_equal_the_library():
    library, own = plain_bpe(), bpe.coder(RANKS)
    texts = odd_strings()
    for chunk in bpe.in_scans(texts, 5000):
        for text, ids in zip(chunk, own.encode(chunk)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
            assert own.decode(ids) == text.encode()


def test_every_class_of_codepoint():
    library, own = plain_bpe(), bpe.coder(RANKS)
    points = [c for c in [*range(0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x11000)]]
    texts = [f"a{chr(c)}a{chr(c)}{chr(c)}1{chr(c)}! {chr(c)}" for c in points]
    for chunk in bpe.in_scans(texts):
        assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(chunk)] == library.encode_ordinary_batch(chunk, num_threads=1)


def test_long_and_short_merges_agree():
    own = bpe.coder(RANKS)
    draw = random.Random(2)
    for _ in range(50):
        piece = "".join(draw.choice("theaonr é") for _ in range(200)).encode()
        assert own.merge(piece) == own.merge_long(piece)


def test_byte_query(spark):
    from hashlib import sha256

    from authsignal.llm.queries import op7_byte_bpe

    docs, library = pd.read_parquet(f"{SMALL}/documents.parquet"), plain_bpe()
    got = {r.doc_id: r for r in op7_byte_bpe(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        row = got[doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha256(ids.tobytes()).hexdigest())
        assert row.decoded_sha256 == sha256(text.encode()).hexdigest()


def test_byte_encoder_keeps_odd_rows(spark, documents, odd_texts):
    got = bpe.encode(documents(odd_texts), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in odd_texts)
    assert bpe.encode(documents([]), RANKS).collect() == []


def test_token_file_query(spark):
    from authsignal.llm.queries import op6_token_file

    docs = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")
    before, want = 0, {}
    for doc_id, ids in zip(docs.doc_id, plain_ids(docs.text)):
        want[doc_id] = (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op6_token_file(spark, SMALL).collect()}
    assert got == want


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_file_is_selective(spark, encoding):
    path = new_path(spark, "tokens")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tokens.write_tokens(docs, path, WORDS, encoding=encoding, row_group_bytes=1 << 16, page_rows=8)
    rows = tokens.read_tokens(spark, path, 50, 60)
    assert sorted(r.doc_id for r in rows.collect()) == list(range(50, 61))
    plan = rows.select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,50)" in plan and "ids" not in plan.split("ReadSchema")[1]
    files = [f.removeprefix("file:") for f in spark.read.parquet(path).inputFiles()]
    ids = [pq.ParquetFile(f).metadata.row_group(0).column(4) for f in files]
    wanted = {"dictionary": "RLE_DICTIONARY", "delta": "DELTA_BINARY_PACKED"}[encoding]
    assert all(c.has_offset_index and (wanted in c.encodings or "PLAIN_DICTIONARY" in c.encodings) for c in ids)
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > len(files)


def test_token_file_of_odd_rows(spark, documents, odd_texts):
    path = new_path(spark, "tokens")
    tokens.write_tokens(documents(odd_texts), path, WORDS)
    rows = tokens.with_starts(tokens.read_tokens(spark, path), tokens.range_starts(spark, path)).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)]).tolist()[:-1]
    assert [r.doc_id for r in rows] == sorted((i for i, _ in odd_texts), key=lambda i: (i is not None, i or 0))
    empty = new_path(spark, "tokens")
    tokens.write_tokens(documents([]), empty, WORDS)
    assert tokens.read_tokens(spark, empty).collect() == [] and tokens.range_starts(spark, empty).collect() == []


def best_fit(lengths, window):
    """Piece by piece: the tightest open window, else a new one."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [room for room in rooms if room >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(window - length)
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_plan_equals_best_fit_decreasing(seed):
    draw = random.Random(seed)
    window = draw.choice([7, 16, 50])
    lengths = [draw.randint(1, window) for _ in range(draw.randint(0, 300))]
    if seed % 3 == 0:
        lengths += [draw.randint(1, window)] * 200
    rows, used, placed = packing.plan(Counter(lengths), window), defaultdict(list), Counter()
    for length, first, last, sequence, each, offset in rows:
        for rank in range(first, last):
            used[sequence + (rank - first) // each].append((offset + length * ((rank - first) % each), length))
            placed[length] += 1
    assert placed == Counter(lengths)
    for spans in used.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(used) == list(range(len(used)))
    assert Counter(window - sum(n for _, n in spans) for spans in used.values()) == best_fit(lengths, window)


def test_packing_query(spark):
    from authsignal.llm.queries import op4_packing

    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    check_pieces(op4_packing(spark, SMALL).collect(), dict(zip(docs.doc_id, plain_ids(docs.text))), 4096)


def check_pieces(rows, ids, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for groups, ends in ((by_doc, {d: len(i) for d, i in ids.items()}), (by_sequence, None)):
        for key, spans in groups.items():
            end = 0
            for start, length in sorted(spans):
                assert start == end
                end += length
            assert end == ends[key] if ends else end <= window
    assert set(by_doc) == set(ids)


def test_packed_windows_hold_the_ids(spark, documents):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice(["alpha", "beta", "gamma"]) for _ in range(draw.randint(0, 90)))) for i in range(80)]
    cut = packing.pieces(documents(rows), WORDS, window=32)
    placed = packing.assign(cut, window=32)
    ids = dict(zip((i for i, _ in rows), plain_ids(t for _, t in rows)))
    check_pieces(placed.collect(), ids, 32)
    filled = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.fill(cut, placed).collect()}
    for r in placed.collect():
        assert filled[r.sequence_id][r.offset : r.offset + r.length].tolist() == ids[r.doc_id][r.start : r.start + r.length].tolist()


def test_packing_of_odd_rows(spark, documents, odd_texts):
    rows = packing.pack(documents(odd_texts), WORDS, window=64).collect()
    assert sum(r.length for r in rows) == sum(len(i) for i in plain_ids(t or "" for _, t in odd_texts))
    assert packing.pack(documents([]), WORDS).collect() == []
