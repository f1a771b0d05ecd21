"""Token ids of whole texts by the tokenizers library, word by word behind a bounded cache."""

from __future__ import annotations

import os
import re
import struct

MOST_WORDS = 1_000_000  # cached words and stems of one Python worker, about 150 MB
LONGEST = 80  # longer words are encoded each time

# Latin letters that normal form C and lower case keep as single letters, then marks but no apostrophe
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()

_encoders: dict[str, "WordEncoder"] = {}


class Words(dict):
    """Ids by word; what is missing is encoded when it is asked for."""

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self.tokenizer = tokenizer
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain:
            stem, marks = plain.groups()
            stem = stem.lower()
            ids = self.stems.get(stem)
            if ids is None:
                # what the normalizer and the pre-tokenizer make of such a stem is known: itself
                tokens = self.tokenizer.model.tokenize(stem.encode().decode("latin-1").translate(BYTE_LETTERS))
                ids = packed([token.id for token in tokens])
                self.stems[stem] = ids
            if marks:
                tail = self.marks.get(marks)
                if tail is None:
                    tail = self.marks[marks] = self.whole(marks)
                ids += tail
        else:
            ids = self.whole(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def whole(self, word: str) -> bytes:
        return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)


class WordEncoder:
    """Encodes with a tokenizer whose pre-tokenizer removes white space, so words stand alone.

    A text is cut at blanks and line feeds only. No normalisation, merge or added token of such a
    tokenizer reaches across either, hence the ids of a text are those of its words in order. A word
    of Latin letters and closing marks goes straight to the library's model, any other word through
    the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) + len(self.words.stems) > MOST_WORDS:
            self.words = Words(self.tokenizer)
        ids = self.words.__getitem__
        return [b"".join(map(ids, text.replace("\n", " ").split(" "))) for text in texts]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def in_chunks(texts: list[str], chars: int = 2_000_000):
    """Runs of texts of bounded total length (a longer text is a run of its own)."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
