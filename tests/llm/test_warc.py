"""Archives: exact round trip, revisits, dictionary frames and odd rows."""

import hashlib
import struct

import pandas as pd
import zstandard

from authsignal.functions.shared import new_path
from authsignal.llm import warc
from tests.conftest import SMALL

PAGE = "page_id long, url string, html string, digest int, n string, first int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2) for r in rows], PAGE)


def test_query_against_brute_force(spark):
    from authsignal.llm.queries import op3_warc

    table = pd.read_parquet(f"{SMALL}/pages.parquet")
    payloads = {i: (h or "").encode() for i, h in zip(table.page_id, table.html)}
    firsts = {}
    for i in sorted(payloads):
        firsts.setdefault(payloads[i], i)
    got = {r.page_id: r for r in op3_warc(spark, SMALL).collect()}
    assert set(got) == set(payloads)
    for i, payload in payloads.items():
        first = firsts[payload] if len(payload) >= 100 and firsts[payload] != i else None
        want = (len(payload), hashlib.sha256(payload).hexdigest(), "response" if first is None else "revisit", first)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want


def test_copies_and_odd_rows(spark):
    long = "x" * 200
    tricky = "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9
    rows = [(1, "http://a/ b", None), (2, None, long), (3, "http://a/é", long), (4, "u", "short"), (5, "u\n", "short")]
    rows += [(None, "u", long), (2, "u", long), (9, "u", tricky), (8, "u", tricky), (7, "", ""), (6, "u", "y" * 3_000_000)]
    rows += [(k, "h", long) for k in range(100, 160)]
    path = new_path(spark, "warc")
    manifest = warc.write_archives(pages(spark, rows), path)
    got = warc.read_archives(manifest, path, payloads=True).collect()
    assert len(got) == len(rows)
    kinds = {}
    for r in got:
        kinds.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert kinds[2] == [("response", None, 200)] * 2
    assert kinds[3] == kinds[None] == kinds[100] == kinds[159] == [("revisit", 2, 200)]
    assert kinds[4] == kinds[5] == [("response", None, 5)]
    assert kinds[9] == [("revisit", 8, len(tricky.encode()))]
    assert kinds[1] == kinds[7] == [("response", None, 0)]
    assert all(bytes(r.payload).decode() == tricky for r in got if r.page_id == 8)


def test_frames_and_dictionary(spark):
    rows = [(k, "u", f"<html><body>page {k} " + "common words of every page " * 30) for k in range(3000)]
    path = new_path(spark, "warc")
    manifest = warc.write_archives(pages(spark, rows).coalesce(1), path).collect()
    with open(f"{path.removeprefix('file:')}/{manifest[0].file}", "rb") as file:
        blob = file.read()
    assert manifest[0].bytes == len(blob)
    magic, size = struct.unpack("<II", blob[:8])
    assert magic == 0x184D2A5D
    words = zstandard.ZstdCompressionDict(blob[8 : 8 + size])
    # each record is a frame of its own
    at, records, tool = 8 + size, 0, zstandard.ZstdDecompressor(dict_data=words)
    while at < len(blob):
        one = tool.decompressobj()
        text = one.decompress(blob[at:])
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        at, records = len(blob) - len(one.unused_data), records + 1
    assert records == 3000


def test_empty_table(spark):
    path = new_path(spark, "warc")
    assert warc.read_archives(warc.write_archives(pages(spark, []), path), path).collect() == []
