"""The prefix trie against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from authsignal.llm import conversations
from authsignal.llm.conversations import Limits
from tests.conftest import SMALL

TURN = "conv_id long, turn long, role string, text string, name long, key string, depth int, part int"


def turns(spark, rows):
    return spark.createDataFrame([(*row, 7, "k", 1, 2) for row in rows], TURN)


def rebuilt(rows, group=100, most=6):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(found)] for c, found in own.items()}
    result = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % most
        head = c - (abs(c) % group) * (1 if c >= 0 else -1)
        result[c] = own.get(head, [])[:h] + found[h:]
    return result


def expected(rows):
    nodes = {}
    for c, found in rebuilt(rows).items():
        for d in range(len(found) + 1):
            nodes.setdefault(tuple(found[:d]), []).append((c, d == len(found)))
    children, leaves, saved = {}, {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        below = [m for m in children.get(node, [])]
        leaves[node] = sum(leaves[m] for m in below) or 1
        own = (len(nodes[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[m] for m in below)
        if node:
            children.setdefault(node[:-1], []).append(node)
    name = {node: min(c for c, _ in members) for node, members in nodes.items()}
    return sorted(
        (
            name[node], len(node), name[node[:-1]] if node else None, len(members), len(children.get(node, [])), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(c for c, last in members if last)).encode()).hexdigest(),
        )
        for node, members in nodes.items()
    )


def got(df):
    return sorted(tuple(r) for r in df.collect())


def drawn(seed, n=160):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        conv = draw.choice([c, c * 37, -c])
        for turn in range(draw.choice([1, 2, 3, 5, 8])):
            rows.append((conv, turn, draw.choice(["user", "assistant"][turn % 2 :]), draw.choice(["a", "b", "héé"])))
    return rows


ODD = [
    (None, 0, "user", "lost"), (0, None, None, None), (0, 0, "user", "x"), (0, 0, "user", "x"), (0, 0, "assistant", "y"), (1, 5, None, "z" * 50_000),
    (2, 5, "", "z" * 50_000), (3, 1, "user", ""), (-7, 1, "user", "neg"), (-107, 2, "user", "neg"), (205, 0, "user", "𝒳é"), (200, 0, "user", "𝒳é"),
]


@pytest.mark.parametrize("limit", [20_000, 9])
def test_trie_equals_dictionaries(spark, limit):
    rows = drawn(limit)
    assert got(conversations.prefix_trie(turns(spark, rows), limits=Limits(nodes=limit))) == expected(rows)


def test_trie_of_odd_rows(spark):
    assert got(conversations.prefix_trie(turns(spark, ODD))) == expected(ODD)
    assert got(conversations.prefix_trie(turns(spark, []))) == []
    assert got(conversations.prefix_trie(turns(spark, ODD[:1]))) == []


def test_long_conversation_over_blocks_and_pieces(spark, monkeypatch):
    """One conversation holds most rows; many others end at one node."""
    monkeypatch.setattr(conversations, "BLOCK", 8)
    monkeypatch.setattr(conversations, "PIECE", 4)
    rows = [(1, k, "user", f"t{k % 3}") for k in range(300)] + [(c, k, "user", f"t{k}") for c in range(2, 90) for k in range(3)]
    assert got(conversations.prefix_trie(turns(spark, rows), limits=Limits(nodes=60))) == expected(rows)


def test_turnless_conversations(spark):
    """A conversation of fewer turns than it gives up, with no first one of its group."""
    conv = next(c for c in range(301, 399) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(conv, 0, "user", "gone"), (401, 0, "user", "a"), (400, 0, "user", "b")]
    found = got(conversations.prefix_trie(turns(spark, rows)))
    assert found == expected(rows)
    assert found[0][1] == 0 and found[0][7] == hashlib.sha256(str(conv).encode()).hexdigest()


def test_decomposition_of_chains_stars_and_random_trees():
    draw = random.Random(3)
    for n, parent_of in ((500, lambda k: k - 1), (500, lambda k: 0), (700, lambda k: draw.randrange(k)), (300, lambda k: max(0, k - draw.choice([1, 2])))):
        parent = [-1] + [parent_of(k) for k in range(1, n)]
        own = [draw.choice([1, 1, 5, 100]) for _ in range(n)]
        values = [(draw.randrange(2), draw.randrange(50)) for _ in range(n)]
        weight, sums = list(own), [list(v) for v in values]
        for k in range(n - 1, 0, -1):
            weight[parent[k]] += weight[k]
            for v in (0, 1):
                sums[parent[k]][v] += sums[k][v]
        assert conversations.decompose(parent, weight, values) == sums


def test_query(spark):
    from authsignal.llm.queries import op12_prefix_trie

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_prefix_trie(spark, SMALL)) == expected(rows)
