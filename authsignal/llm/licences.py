"""Licence wording found by templates with optional and replaceable regions.

A template is written as in licence lists:

* ``<<beginOptional>> ... <<endOptional>>`` may be missing as a whole, and may be nested;
* ``<<var;name="...";original="...";match="...">>`` is a replaceable region (``match`` left out: 0 to 8 words);
* all other words are mandatory and must match exactly.

Tags may carry further attributes. ``match`` is one of these; anything else is refused:

* ``a-b``: a to b words of any kind;
* ``.*`` or ``.+``: any number of words, or one at least;
* ``.{a,b}`` or ``.{a,}``: a to b characters, read as words: none or, where a is above zero, one at
  least, and at most (b + 1) // 2, since a word has a character and a blank stands between two;
* ``one text|another text``: one of these wordings, which may end in an empty one.

Each template is compiled into an automaton over words (states are template places; an optional
region adds a move without a word). A text is accepted where a run of its words takes the automaton
from its start to its end. All states that are open at one word advance together, so a scan is
linear in the text times the states of the template, and begins only where a first word stands. A
template whose mandatory words aren't all present in a text isn't run on it.

Words are the runs of bytes that ``word_runs`` keeps, with A-Z in lower case.

Defined cases: a null text counts as empty, has no words and gets empty labels and score 0; places
that overlap all count; the same label from several templates counts once; repeated rows are scanned
each; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from authsignal.llm.common import batches, rows_of, ship, texts

# bytes that are not part of a word: all ASCII but digits and letters
KEPT = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
TAG = re.compile(r"<<(.*?)>>", re.S)
ANY = None  # the word of a replaceable region

# ---- fixed values: phrases and their labels ----
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# ---- fixed values: templates and their labels ----
TEMPLATES = {
    "apache-2.0": "<<beginOptional>>licensed under the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2 0",
    "apache-2.0-notice": """licensed under the apache license version 2 0 the license you may not use this
        <<var;name="thing";match="1-3">> except in compliance with the license""",
    "mit-notice": """<<beginOptional>>released<<endOptional>> under the mit license
        <<beginOptional>>copyright <<var;name="holder";match="0-8">> all rights reserved<<endOptional>>""",
    "mit-permission": """permission is hereby granted free of charge to any person obtaining a copy of this
        <<var;name="software";match="1-3">> and associated documentation files""",
    "cc-by-nc-4.0": "<<beginOptional>>licensed under<<endOptional>> cc by nc 4 0 <<beginOptional>>international<<endOptional>>",
    "gpl-or-later": """gnu general public license <<beginOptional>>as published by the free software
        foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;name="version";match="1-2">> or
        <<var;name="option";match="0-3">> any later version""",
    "mit": """<<beginOptional;name="title">>the mit license <<beginOptional>>mit<<endOptional>><<endOptional>>
        <<beginOptional;name="copyright">>copyright <<var;name="holder";match=".{1,5000}">><<endOptional>>
        permission is hereby granted free of charge to any person obtaining a copy of
        <<var;name="software";match="this software|the software">> and associated documentation files the software to deal
        in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to
        do so subject to the following conditions the above copyright notice and this permission notice
        <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions
        of the software the software is provided as is without warranty of any kind express or implied including but not
        limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        <<var;name="parties";match=".+">> be liable for any claim damages or other liability whether in an action of contract
        tort or otherwise arising from out of or in connection with the software or the use or other dealings in the
        software""",
    "isc": """<<beginOptional;name="title">>isc license<<endOptional>>
        <<beginOptional;name="copyright">>copyright <<var;name="holder";match=".{1,5000}">><<endOptional>>
        permission to use copy modify and <<var;name="or";match="or distribute|distribute">> this software for any purpose
        with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in
        all copies the software is provided as is and <<var;name="author";match=".{1,500}">> disclaims all warranties with
        regard to this software including all implied warranties of merchantability and fitness in no event shall
        <<var;name="parties";match=".{1,500}">> be liable for any special direct indirect or consequential damages or any
        damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
        tortious action arising out of or in connection with the use or performance of this software""",
    "bsd-redistribution": """redistribution and use in source and binary forms with or without modification are
        permitted provided that the following conditions are met""",
}


def word_runs(text: str) -> list[bytes]:
    """The words of a text."""
    return text.encode().translate(KEPT).split()


@dataclass
class Automaton:
    """Moves by word and without one; state 0 is the start."""

    label: str
    moves: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    mandatory: set[bytes] = field(default_factory=set)
    most: dict[int, int] = field(default_factory=dict)  # states that loop: how many words they take
    end: int = 0

    def grow(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def closed(self, states: set[int]) -> set[int]:
        """With what is reached without a word."""
        todo, found = list(states), set(states)
        while todo:
            for state in self.skips[todo.pop()]:
                if state not in found:
                    found.add(state)
                    todo.append(state)
        return found

    def run(self, at: int, words: list[bytes | None]) -> int:
        """The state behind these words, one after the other."""
        for word in words:
            state = self.grow()
            self.moves[at].append((word, state))
            at = state
        return at

    def region(self, at: int, least: int, most: float) -> int:
        """The state behind ``least`` to ``most`` words of any kind: a run, then one state that loops."""
        at = self.run(at, [ANY] * least)
        if most > least:
            loop = self.grow()
            self.skips[at].append(loop)
            self.moves[loop].append((ANY, loop))
            self.most[loop] = most - least
            at = loop
        return at

    def choice(self, at: int, wordings: list[list[bytes]]) -> int:
        """The state behind any one of the wordings."""
        behind = self.grow()
        for words in wordings:
            self.skips[self.run(at, words)].append(behind)
        return behind

    def finish(self) -> "Automaton":
        self.start = self.closed({0})
        self.reached = [self.closed({state}) for state in range(len(self.moves))]
        self.firsts = {word for state in self.start for word, _ in self.moves[state]}
        return self


def bounds(match: str) -> tuple[int, float] | None:
    """Fewest and most words that a replaceable region stands for; None where it lists wordings."""
    if found := re.fullmatch(r"(\d+)-(\d+)", match):
        least, most = int(found[1]), int(found[2])
    elif match in (".*", ".+"):
        least, most = int(match == ".+"), math.inf
    elif found := re.fullmatch(r"\.\{(\d+),(\d*)\}", match):
        few, many = int(found[1]), int(found[2]) if found[2] else None
        least, most = int(few > 0), math.inf if many is None else (many + 1) // 2 if few <= many else -1
    elif re.fullmatch(r"[A-Za-z0-9 ,|\x80-\U0010ffff]+", match):
        return None
    else:
        raise ValueError(f"a region that isn't understood: {match!r}")
    if least > most:
        raise ValueError(f"a region that can't match: {match!r}")
    return least, most


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of one template; ValueError where its markup isn't understood."""
    own, at, open_regions = Automaton(label), 0, []
    for k, part in enumerate(TAG.split(template)):
        name = part.split(";")[0].strip()
        if k % 2 == 0:
            words = word_runs(part)
            if not open_regions:
                own.mandatory.update(words)
            at = own.run(at, words)
        elif name == "beginOptional":
            open_regions.append(at)
        elif name == "endOptional":
            if not open_regions:
                raise ValueError(f"template {label}: an optional region ends that hasn't begun")
            state = own.grow()
            own.skips[at].append(state)
            own.skips[open_regions.pop()].append(state)
            at = state
        elif name == "var":
            found = re.search(r';\s*match\s*=\s*"(.*?)"\s*(;|$)', part, re.S)
            if not found and re.search(r";\s*match\b", part):
                raise ValueError(f"template {label}: match without a quoted value in {part!r}")
            match = found[1].strip() if found else "0-8"
            words = bounds(match)
            at = own.region(at, *words) if words else own.choice(at, [word_runs(wording) for wording in match.split("|")])
        else:
            raise ValueError(f"template {label}: unknown region {part!r}")
    if open_regions:
        raise ValueError(f"template {label}: an optional region isn't closed")
    own.end = at
    if ANY in own.finish().firsts or own.end in own.start:
        raise ValueError(f"template {label}: it must begin with a word and can't be empty")
    return own


def places(own: Automaton, words: list[bytes]) -> list[tuple[int, int]]:
    """Accepted runs (first word, word behind): for each start the longest, in order.

    For each state that is open, and each start that reaches it, the words are kept that a loop may
    still take: what can follow the largest number can follow all smaller ones.
    """
    found: dict[int, int] = {}
    firsts, most = own.firsts, own.most
    starts = [k for k, word in enumerate(words) if word in firsts]
    open_states: dict[int, dict[int, float]] = {}  # state: the starts that reach it, with words left
    nxt, k, n = 0, 0, len(words)
    while k < n:
        if not open_states:
            if nxt >= len(starts):
                break
            k = starts[nxt]
        if nxt < len(starts) and starts[nxt] == k:
            for state in own.start:
                open_states.setdefault(state, {})[k] = most.get(state, 0)
            nxt += 1
        word, after = words[k], {}
        for state, sources in open_states.items():
            for wanted, target in own.moves[state]:
                if wanted is not ANY and wanted != word:
                    continue
                going = sources
                if target == state:
                    going = {source: left - 1 for source, left in sources.items() if left > 0}
                    if not going:
                        continue
                for reached in own.reached[target]:
                    into = after.setdefault(reached, {})
                    if reached == state and target == state:
                        for source, left in going.items():
                            into[source] = max(left, into.get(source, left))
                    else:
                        into.update(dict.fromkeys(going, most.get(reached, 0)))
        open_states = after
        k += 1
        for source in after.get(own.end, ()):
            found[source] = k
    return sorted(found.items())


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document with its labels and the spans of words they were found in.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` are of the phrases alone; ``labels``
    has the templates' too; ``score`` is the share of the document's words in accepted runs.
    """
    ship(docs.sparkSession)
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64())]
        + [("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
        + [("spans", pa.list_(span))]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [compile_template(label, phrase) for phrase, label in phrases.items()]
        more = [compile_template(label, template) for label, template in templates.items()]
        vocabulary = frozenset().union(*(own.mandatory for own in base + more))

        def found():
            for part in parts:
                for doc_id, text in rows_of(part, "doc_id", "text"):
                    words = word_runs(text)
                    present = vocabulary.intersection(words)
                    sets = [
                        [(own.label, s, e) for own in group if own.mandatory <= present for s, e in places(own, words)]
                        for group in (base, more)
                    ]
                    spans = sorted(sets[0] + sets[1], key=lambda x: (x[1], x[2], x[0]))
                    starts = [s for _, s, _ in sets[0]]
                    covered = behind = 0
                    for _, s, e in spans:
                        covered += max(0, e - max(s, behind))
                        behind = max(behind, e)
                    yield (
                        doc_id,
                        len(words),
                        len(starts),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted({x[0] for x in sets[0]})),
                        ",".join(sorted({x[0] for x in spans})),
                        covered / len(words) if words else 0.0,
                        [dict(zip(("label", "start", "end"), x)) for x in spans],
                    )

        yield from batches(found(), schema)

    return texts(docs, id_col, text_col).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,start:long,end:long>>",
    )
