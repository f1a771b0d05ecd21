"""Byte-level BPE by ranks: boundaries from transition scans, cached merges, offsets to decode.

Pre-tokenisation uses no regex. Every codepoint gets a class (with one or two codepoints of
lookahead folded in), every class maps each state of a small automaton to the next, and such maps
compose associatively: blocks of text are composed independently, block entries follow from a scan
over the compositions, and then all codepoints of all blocks step at once. The states before each
codepoint say where tokens begin. The slices between boundaries are merged by rank, once per
distinct slice and worker; decoding copies vocabulary bytes by offset.

Defined cases: a null text counts as empty; an empty text has no ids; repeated rows are encoded
each; a null id stays null; an empty table gives no rows; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from authsignal.llm.common import batches, ship, texts

MOST_SLICES = 500_000  # distinct slices one Python worker remembers, about 100 MB
LONGEST = 64  # longer slices are merged each time
BLOCK = 64
CHARS = 1_000_000  # codepoints scanned at once

# ---- classes of codepoints ----
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, LAST, BLANK, BREAK = range(9)
# SHORT: an apostrophe before s, t, m or d; LONG: before re, ve or ll. SPACE: white space before more
# white space or the end; LAST: other white space before anything else; BLANK: the same, but U+0020.
# BREAK: between texts.

# ---- states: what the codepoint before belongs to ----
FREE, LETTERS, NUMBERS, OTHERS, SPACES, AFTER_BLANK, TWO_MORE, ONE_MORE = range(8)

# fixed values: white space by the Unicode property
WHITE_SPACE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Tables [class, state] of the next state and of whether a token begins."""
    following = np.zeros((9, 8), dtype=np.uint8)
    begins = np.ones((9, 8), dtype=bool)
    for kind, state in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
        following[kind] = state
        begins[kind, [state, AFTER_BLANK]] = False
    for kind, state in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        following[kind] = state
        following[kind, [OTHERS, AFTER_BLANK]] = OTHERS  # the apostrophe is inside another token
        begins[kind, [OTHERS, AFTER_BLANK]] = False
    following[LETTER, [TWO_MORE, ONE_MORE]] = ONE_MORE, FREE
    begins[LETTER, [TWO_MORE, ONE_MORE]] = False
    following[SPACE] = SPACES
    begins[SPACE, SPACES] = False
    following[LAST], following[BLANK], following[BREAK] = FREE, AFTER_BLANK, FREE
    return following, begins


FOLLOWING, BEGINS = transitions()


@lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """The class of every codepoint without lookahead."""
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    found[WHITE_SPACE] = SPACE
    return found


def classes(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Classes with lookahead; ``breaks`` are the places between texts."""
    kind = codepoint_classes()[points]
    kind[breaks] = BREAK
    after = np.append(points[1:], 0)
    ends = np.append(kind[1:], BREAK)
    lone = (kind == SPACE) & (ends != SPACE) & (ends != BREAK)
    marks = np.flatnonzero((points == ord("'")) & (kind == OTHER) & (ends == LETTER))
    kind[lone] = np.where(points[lone] == 32, BLANK, LAST)
    if len(marks):
        one = after[marks]
        two = np.where(ends[np.minimum(marks + 1, len(ends) - 1)] == LETTER, after[np.minimum(marks + 1, len(after) - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.isin(one * 256 + np.minimum(two, 255), [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        kind[marks[short]], kind[marks[long]] = SHORT, LONG
    return kind


def compose(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Maps of states applied one after the other, row by row."""
    return np.take_along_axis(second, first, axis=1)


def boundaries(kind: np.ndarray) -> np.ndarray:
    """Whether a token begins at each codepoint."""
    n = len(kind)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, BREAK, dtype=np.uint8)
    padded[:n] = kind
    # one row for each step, so that a step of all blocks is one stretch of memory
    steps = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    flat = FOLLOWING.reshape(-1)
    for step in steps:
        whole = flat[(step[:, None] * np.uint8(8)) + whole]
    # inclusive scan of the blocks' maps by doubling
    reach = 1
    while reach < rows:
        whole[reach:] = compose(whole[:-reach].copy(), whole[reach:])
        reach *= 2
    state = np.concatenate(([FREE], whole[:-1, FREE])).astype(np.uint8)
    begins, flags = BEGINS.reshape(-1), np.empty((BLOCK, rows), dtype=bool)
    for k, step in enumerate(steps):
        place = step * np.uint8(8) + state
        flags[k] = begins[place]
        state = flat[place]
    return np.ascontiguousarray(flags.T).reshape(-1)[:n]


def slices(texts_: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of all texts, each with a line feed behind, the starts of tokens in it, and each text's first token.

    The line feeds between texts are tokens of their own; the last of the starts is the end of all.
    """
    line = "\n".join(texts_) + "\n"
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    lengths = np.fromiter(map(len, texts_), np.int64, len(texts_)) + 1
    breaks = np.cumsum(lengths) - 1
    begins = boundaries(classes(points, breaks))
    begins[breaks] = True
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width) - width
    starts = np.append(at[begins], at[-1] + width[-1])
    tokens = np.cumsum(begins)
    firsts = np.concatenate(([0], tokens[breaks]))
    return line.encode("utf-8", "surrogatepass"), starts, firsts


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = (line.split() for line in file if line.strip())
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in pairs}
        self.seen: dict[bytes, bytes] = {}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank] = word
        self.blob = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.sizes = np.fromiter(map(len, words), np.int64, size)
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one slice: always the adjacent pair of least rank, leftmost first."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 256:
            return self.merge_long(piece)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == NO_RANK:
                break
            k = pairs.index(low)
            parts[k] += parts[k + 1]
            del parts[k + 1], pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], NO_RANK)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], NO_RANK)
        return [ranks[part] for part in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for long slices, with a heap and linked parts."""
        import heapq

        ranks, n = self.ranks, len(piece)
        ends = list(range(1, n + 1))  # the part that begins at k ends here; 0 once it is merged
        before = list(range(-1, n - 1))
        heap = [(ranks[piece[k : k + 2]], k, k + 2) for k in range(n - 1) if piece[k : k + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, end = heapq.heappop(heap)
            middle = ends[k]
            if not middle or middle >= n or ends[middle] != end:
                continue
            ends[k], ends[middle] = end, 0
            if end < n:
                before[end] = k
                if (rank := ranks.get(piece[k : ends[end]])) is not None:
                    heapq.heappush(heap, (rank, k, ends[end]))
            if before[k] >= 0 and (rank := ranks.get(piece[before[k] : end])) is not None:
                heapq.heappush(heap, (rank, before[k], end))
        found, k = [], 0
        while k < n:
            found.append(ranks[piece[k : ends[k]]])
            k = ends[k]
        return found

    def slice_ids(self, piece: bytes) -> bytes:
        ids = np.array(self.merge(piece), dtype="<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self.seen) >= MOST_SLICES:
                self.seen.clear()
            self.seen[piece] = ids
        return ids

    def encode(self, texts_: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        line, starts, firsts = slices(texts_)
        marks = starts.tolist()
        seen, slow = self.seen.get, self.slice_ids
        ids = [seen(piece) or slow(piece) for piece in map(line.__getitem__, map(slice, marks, marks[1:]))]
        ends = firsts.tolist()
        return [b"".join(ids[s : e - 1]) for s, e in zip(ends, ends[1:])]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, copied from the vocabulary by offset."""
        names = np.frombuffer(ids, dtype="<u4")
        sizes = self.sizes[names]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.offsets[names] - (ends - sizes), sizes) + np.arange(total)].tobytes()


NO_RANK = 1 << 60
_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """One coder for each rank file and Python worker."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


def in_scans(texts_: list[str], chars: int = CHARS) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts_:
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, and the bytes they decode to."""
    return _coded(docs, ranks, id_col, text_col, False)


def digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode`` without sending the ids on."""
    return _coded(docs, ranks, id_col, text_col, True)


def _coded(docs: DataFrame, ranks: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    ship(docs.sparkSession)
    names, kind = (("ids_sha256", "decoded_sha256"), pa.string()) if digest else (("ids", "decoded"), pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((name, kind) for name in names)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)

        def found():
            for part in parts:
                ids_of = iter(part.column("doc_id").to_pylist())
                for chunk in in_scans(part.column("text").to_pylist()):
                    for ids in own.encode(chunk):
                        back = own.decode(ids)
                        n = len(ids) // 4
                        if digest:
                            ids, back = hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()
                        yield next(ids_of), n, ids, back

        yield from batches(found(), schema, 4096 if digest else 256)

    ddl = "doc_id long, n_tokens long, " + ", ".join(f"{name} {'string' if digest else 'binary'}" for name in names)
    return texts(docs, id_col, text_col).mapInArrow(run, ddl)
