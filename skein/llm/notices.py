"""License scans: fuzzy search for short notices with pigeonhole seeds and bounded-error matching.

A notice that occurs with at most k edits and is split into k + 1 pieces has one piece
unharmed. All pieces of all notices are searched at once (Aho-Corasick); each piece found
marks the stretch where its notice can lie, too short for two; there the regex library's best
``{e<=k}`` match decides and gives the span and its number of edits. Of overlapping spans of
one notice that with the fewest edits stays, the first among equals. A notice with k = 0 is its
own and only piece. Texts are compared as words: A-Z lower-cased, words joined by one blank.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.arrays import ALNUM, LOWER, lean
from skein.session import ship_package


@dataclass(frozen=True)
class Notice:
    """A phrase of blank-separated words, its label and the edits allowed; ``base`` ones are exact."""

    phrase: str
    label: str
    edits: int = 0
    base: bool = False


BASE = (
    Notice("cc by", "cc-by", base=True),
    Notice("general public license", "gpl", base=True),
    Notice("all rights reserved", "reserved", base=True),
)
FUZZY = (
    Notice("licensed under the apache license version 2 0", "apache-2.0", 4),
    Notice("licensed under the mit license", "mit", 2),
    Notice("permission is hereby granted free of charge to any person", "mit", 5),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("gnu general public license", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("gnu affero general public license", "agpl", 2),
    Notice("mozilla public license", "mpl", 2),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("licensed under cc by", "cc-by", 1),
    Notice("spdx license identifier", "spdx", 2),
    Notice("all rights reserved", "reserved", 1),
    Notice("this work is licensed under", "licensed", 2),
    Notice("released into the public domain", "public-domain", 3),
)
#: bytes to what words are made of: lower-cased letters and digits, all beyond ASCII; else a blank
NORMAL = bytes(np.where(ALNUM, LOWER, 32).astype(np.uint8))


def normal(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return (text or "").encode().translate(NORMAL).split()


def pieces(phrase: str, n: int) -> list[tuple[int, str]]:
    """``n`` stretches of nearly equal length that make up the phrase, with their places."""
    cut = [round(i * len(phrase) / n) for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Scanner:
    """Seeds and verifiers of a list of notices."""

    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for at, piece in pieces(n.phrase, n.edits + 1):
                places.setdefault(piece, []).append((i, at))
        for piece, owners in places.items():
            self.seeds.add_word(piece, (len(piece), owners))
        self.seeds.make_automaton()
        self.verify = [regex.compile(f"(?b)(?<= )(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}(?= )") for n in notices]

    def spans(self, line: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of all matches in ``line``: words joined by blanks, a blank at both ends.

        Each seed is verified by itself, so that neighbours don't hide one another; those that
        would put a notice at the same place are verified once.
        """
        found: list[tuple[int, int, int, int]] = []
        near: dict[int, list[tuple[int, int, int]]] = {}
        asked: dict[int, set[int]] = {}
        for last, (size, owners) in self.seeds.iter(line):
            for i, at in owners:
                n = self.notices[i]
                begin = last + 1 - size - at
                end = begin + len(n.phrase)
                if not n.edits:  # the seed is the notice: only its borders are open
                    if line[begin - 1] == " " and line[end] == " ":
                        found.append((i, begin, end, 0))
                    continue
                known = asked.setdefault(i, set())
                if begin in known:
                    continue
                known.add(begin)
                if begin > 0 and line.startswith(n.phrase, begin) and line[begin - 1] == " " and line[end] == " ":
                    near.setdefault(i, []).append((0, begin, end))
                    continue
                low, high = max(0, begin - n.edits - 1), min(len(line), end + n.edits + 1)
                if m := self.verify[i].search(line, low, high):
                    near.setdefault(i, []).append((sum(m.fuzzy_counts), m.start(), m.end()))
        for i, spans in near.items():
            starts: list[int] = []
            ends: dict[int, int] = {}
            for edits, begin, end in sorted(set(spans)):
                k = bisect.bisect_left(starts, end)  # the last that begins before this one's end
                if k and ends[starts[k - 1]] > begin:
                    continue
                starts.insert(k, begin)
                ends[begin] = end
                found.append((i, begin, end, edits))
        return sorted(found, key=lambda x: (x[1], x[0], x[2]))


SPAN = "array<struct<label string, phrase string, base boolean, first_word long, last_word long, edits int, similarity double>>"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = BASE + FUZZY) -> DataFrame:
    """key, n_words and the spans of all notices (in words, from 0) of each whole text.

    Null and empty texts have no words and no spans. Repeated keys give repeated rows.
    One pass, no shuffle; memory is one text and its words.
    """
    ship_package(df.sparkSession)
    kind = dict(df.dtypes)[key]
    span_type = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, spans = [], []
                for t in part.column(1):
                    found = normal(t.as_py())
                    counts.append(len(found))
                    line = f" {b' '.join(found).decode()} "
                    rows, first, to = [], -1, 0
                    for i, begin, end, edits in scanner.spans(line):
                        n, first, to = notices[i], first + line.count(" ", to, begin), begin
                        rows.append({"label": n.label, "phrase": n.phrase, "base": n.base, "first_word": first, "last_word": first + line.count(" ", begin, end), "edits": edits, "similarity": 1 - edits / len(n.phrase)})
                    spans.append(rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(spans, span_type)], [key, "n_words", "spans"])

    return df.selectExpr(f"`{key}`", f"`{text}`").mapInArrow(lean(run), f"`{key}` {kind}, n_words long, spans {SPAN}")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, places and labels of each text: those of the base phrases, and of all notices."""
    return found.selectExpr(f"`{key}`", "n_words", "spans", "filter(spans, s -> s.base) AS base").selectExpr(
        f"`{key}`",
        "n_words",
        "cast(size(base) AS long) AS n_base",
        "array_min(base.first_word) AS first_word",
        "array_max(base.first_word) AS last_word",
        "array_join(array_sort(array_distinct(base.label)), ',') AS base_labels",
        "array_join(array_sort(array_distinct(spans.label)), ',') AS labels",
        "coalesce(array_max(spans.similarity), cast(0 AS double)) AS score",
        "cast(size(spans) AS long) AS n_spans",
    )
