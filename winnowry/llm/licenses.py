"""License scan by template markup.

A template is a text with ``<<beginOptional>>...<<endOptional>>`` regions and replaceable ``<<var;tokens="low-high">>``
regions. It's compiled into an automaton over words, made deterministic step by step as words arrive; a text is
accepted where every mandatory word stands exactly, optional regions stand whole or not at all, and a replaceable
region has between low and high words. Whole texts are scanned; the automaton starts only where a first word stands
in a text that holds the template's anchor, which is one of its mandatory words, so no acceptance is lost.

Defined results: null is empty; an empty text has no words, no places and empty labels; repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import blocks, spans, words_per_row

#: Phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Public license notices and texts as templates, by the label they give.
TEMPLATES = {
    "notice-gpl": '<<beginOptional>>This <<var;tokens="1-3">> is<<endOptional>> licensed under the GNU General Public License, version <<var;tokens="1-1">><<beginOptional>> or later<<endOptional>>',
    "notice-apache-2.0": "Licensed under the Apache License, Version 2.0<<beginOptional>> (the \"License\"); you may not use this file except in compliance with the License<<endOptional>>",
    "notice-cc-by": "Licensed under <<beginOptional>>a <<endOptional>>CC BY<<beginOptional>>-NC<<endOptional>><<beginOptional>>-SA<<endOptional>><<beginOptional>>-ND<<endOptional>> 4.0",
    "notice-mit": "<<beginOptional>>This <<var;tokens=\"1-3\">> is <<endOptional>>released under the MIT License",
    "text-mit": """<<beginOptional>>Copyright (c) <<var;tokens="1-12">><<endOptional>> Permission is hereby granted, free of charge, to any person obtaining a copy
        of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;tokens="1-12">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "text-isc": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;tokens="1-12">>
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        <<var;tokens="1-12">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
}
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_TRANSLATE = bytes(b + 32 if 65 <= b <= 90 else b if WORD_BYTES[b] else 32 for b in range(256))
MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TRANSLATE).split()


@dataclass
class Automaton:
    """Words as edges between numbered states; ``skip`` edges take no word; an edge of None takes any word."""

    label: str
    edges: list[dict[bytes | None, int]] = field(default_factory=lambda: [{}])
    skip: list[list[int]] = field(default_factory=lambda: [[]])
    mandatory: list[bytes] = field(default_factory=list)
    known: dict = field(default_factory=dict)

    def state(self) -> int:
        self.edges.append({})
        self.skip.append([])
        return len(self.edges) - 1

    def closed(self, states) -> frozenset:
        reach, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in reach:
                    reach.add(s)
                    todo.append(s)
        return frozenset(reach)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        """The deterministic step; words outside the template's vocabulary share one entry."""
        key = (states, word if word in self.vocabulary else None)
        if (to := self.known.get(key)) is None:
            to = self.known[key] = self.closed({e[w] for s in states for e in (self.edges[s],) for w in (key[1], None) if w in e})
        return to

    def finish(self, end: int) -> Automaton:
        self.end, self.vocabulary = end, {w for e in self.edges for w in e if w is not None}
        self.begin = self.closed({0})
        self.first = {w for s in self.begin for w in self.edges[s]}
        self.anchor = max(self.mandatory, key=lambda w: (len(w), w))
        return self

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words that begins at ``at``; -1 if there is none."""
        states, last = self.begin, -1
        for k in range(at, len(words)):
            states = self.step(states, words[k])
            if not states:
                break
            if self.end in states:
                last = k + 1
        return last


def parse(template: str) -> list:
    """Markup as items: word (bytes), (low, high) of a replaceable region, or a list of an optional region's items."""
    stack: list[list] = [[]]
    for k, part in enumerate(MARKUP.split(template)):
        if k % 2 == 0:
            stack[-1] += words_of(part.encode())
        elif part == "beginOptional":
            stack.append([])
        elif part == "endOptional":
            region = stack.pop()
            stack[-1].append(region)
        else:
            low, high = re.search(r'tokens="(\d+)-(\d+)"', part).groups()
            stack[-1].append((int(low), int(high)))
    if len(stack) != 1:
        raise ValueError("an optional region isn't closed")
    return stack[0]


def compile_template(label: str, template: str) -> Automaton:
    made = Automaton(label)

    def lay(items: list, at: int, must: bool) -> int:
        for item in items:
            if isinstance(item, bytes):
                to = made.state()
                made.edges[at][item] = to
                if must:
                    made.mandatory.append(item)
                at = to
            elif isinstance(item, tuple):
                stops = []
                for k in range(item[1]):
                    if k >= item[0]:
                        stops.append(at)
                    to = made.state()
                    made.edges[at][None] = to
                    at = to
                for s in stops:
                    made.skip[s].append(at)
            else:
                # a state of its own keeps the region's first word apart from the words after the region
                inner = made.state()
                made.skip[at].append(inner)
                done, to = lay(item, inner, False), made.state()
                made.skip[done].append(to)
                made.skip[at].append(to)
                at = to
        return at

    end = lay(parse(template), 0, True)
    if not made.mandatory:
        raise ValueError(f"{label} has no mandatory word")
    return made.finish(end)


def template_regex(template: str) -> str:
    """The same language as a regular expression over words each followed by a space (to check the automata by)."""

    def lay(items: list) -> str:
        return "".join(re.escape(i.decode()) + " " if isinstance(i, bytes) else "(?:[^ ]+ ){%d,%d}" % i if isinstance(i, tuple) else f"(?:{lay(i)})?" for i in items)

    return lay(parse(template))


def find_all(words: list[bytes], automata: list[Automaton]) -> list[tuple[str, int, int]]:
    """(label, start, end) of every accepted run, the longest from each start."""
    there, found = set(words), []
    for a in automata:
        if a.anchor in there:
            for k, w in enumerate(words):
                if (w in a.first or None in a.first) and (end := a.longest(words, k)) >= 0:
                    found.append((a.label, k, end))
    return found


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[str, int]]:
    """(label, start) of every place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        want = phrase.encode().split()
        at = -1
        for _ in range(words.count(want[0])):
            at = words.index(want[0], at + 1)
            if words[at : at + len(want)] == want:
                found.append((label, at))
    return found


SCANNED = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document. score: 1 if a template is accepted, else 0.5 if a phrase stands there, else 0. spans: accepted runs, in words."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    types = pa.schema([("id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                       ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [compile_template(k, t) for k, t in templates.items()]
        anchors = {a.anchor for a in automata} | {max(p.encode().split(), key=len) for p in phrases}
        anchored = re.compile(b"|".join(sorted(map(re.escape, anchors)))) if anchors else None
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for low, high, data, at in blocks(batch.column(1)):
                starts, _ = spans(data, at, WORD_BYTES)
                n_words = np.diff(words_per_row(starts, at)).tolist()
                plain = data.tobytes().translate(_TRANSLATE)
                for i in range(high - low):
                    text = plain[at[i] : at[i + 1]]
                    base, runs = [], []
                    if anchored and anchored.search(text):
                        words = text.split()
                        base, runs = phrase_places(words, phrases), find_all(words, automata)
                    places, own = [p for _, p in base], {x for x, _ in base}
                    rows.append({
                        "id": ids[low + i], "n_words": n_words[i], "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None),
                        "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {x for x, _, _ in runs})), "score": 1.0 if runs else 0.5 if base else 0.0,
                        "spans": [{"label": x, "start": s, "end": e} for x, s, e in runs],
                    })
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, SCANNED)
    return out.withColumnRenamed("id", id_col)
