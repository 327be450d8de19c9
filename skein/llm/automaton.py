"""BPE by a tokenization automaton: merge gadgets, table-driven encoding, arc labels back to text.

The automaton reads *tokens* and accepts exactly the token strings that BPE makes. It
starts as one state with an arc for each base symbol, back to itself. For each merge
``u v -> w``, in rank order, a gadget is added: the state that ``u`` leads to is copied
without its ``v`` arc, all ``u`` arcs are sent to the copy, and each state with a ``u``
arc gets a ``w`` arc to where ``v`` leads. All arcs with one label lead to one state, so
the automaton is four flat tables, one entry for a label or a gadget, instead of
states x labels:

* ``target[label]``: the state that its arcs lead to;
* ``born[label]`` and ``left[label]``: the gadget that made the label, and its ``u``;
* ``parent[state]`` and ``cut[state]``: the state it is a copy of, and the arc left out.

A state has an arc if, going back through these tables, no copy left it out. The paths
that spell a string are found by transitions over its prefixes; exactly one is accepted,
and its labels are the tokens. Decoding emits the arc labels' strings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.arrays import KEPT, lean
from skein.session import ship_package

MAX_WORDS = 250_000
#: The vocabulary's pre-split pattern, a fixed value; the same for the standard library's
#: faster engine, whose classes differ only where ``ODD`` finds something. Texts without such
#: characters are also composed already, and lower-cased alike by Python and the library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+"
ODD = "[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


@cache
def unassigned() -> Callable[[str], re.Match | None]:
    """Search for a code point that Python's Unicode tables don't know. Letters that are newer than these
    are known to some engines and not to others, so texts with one are split by the library itself.
    """
    ranges, code = [], 0
    for unknown, run in groupby(range(0x110000), lambda c: category(chr(c)) == "Cn"):
        n = sum(1 for _ in run)
        if unknown:
            ranges.append(f"{chr(code)}-{chr(code + n - 1)}")
        code += n
    return re.compile(f"[{''.join(ranges)}]").search


_BYTE_OF = {c: b for b, c in enumerate(byte_symbols())}


def library_words(pre_tokenizer, text: str) -> list[str]:
    """The words that a byte-level pre-tokenizer of the library splits a text into, as they are in the text."""
    return [bytes(map(_BYTE_OF.__getitem__, piece)).decode() for piece, _ in pre_tokenizer.pre_tokenize_str(text)]


class Automaton:
    """The tables, made by successive merge gadgets, and their use."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        n = max(vocab.values(), default=-1) + 1
        self.target, self.born, self.left = [0] * n, [0] * n, [-1] * n
        self.parent, self.cut = [0], [-1]
        made = set()
        for u, v in merges:
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            if w in made:
                raise ValueError(f"two merges make {u + v!r}")
            made.add(w)
            self._gadget(a, b, w)
        self.label = [""] * n
        for s, i in vocab.items():
            self.label[i] = s
        #: a token's string to its label, or -1 if it only begins longer ones
        self.spelled: dict[str, int] = {}
        for s, i in vocab.items():
            for k in range(1, len(s)):
                self.spelled.setdefault(s[:k], -1)
        for s, i in vocab.items():
            if self.left[i] >= 0 or len(s.removesuffix(end) or end) == 1:
                self.spelled[s] = i
        self._arcs: dict[int, bool] = {}
        self._size = n

    def _gadget(self, u: int, v: int, w: int) -> None:
        state = len(self.parent)
        self.born[w], self.left[w], self.target[w] = state, u, self.target[v]
        self.parent.append(self.target[u])
        self.cut.append(v)
        self.target[u] = state

    def has_arc(self, state: int, label: int) -> bool:
        while True:
            if self.born[label] < state:  # the label is older than the state: as in the state it copies, but for the arc left out
                if self.cut[state] == label:
                    return False
                state = self.parent[state]
            elif self.born[label] > state or state:  # younger: the gadget that made it gave it to each state with a u arc
                label = self.left[label]
            else:
                return True

    def step(self, state: int, label: int) -> int | None:
        """The state after an arc, None if there is none."""
        key = state * self._size + label
        found = self._arcs.get(key)
        if found is None:
            if len(self._arcs) > 400_000:
                self._arcs.clear()
            found = self._arcs[key] = self.has_arc(state, label)
        return self.target[label] if found else None

    def tokens(self, symbols: list[str]) -> list[int]:
        """Labels of the one accepted path that spells the symbols."""
        n = len(symbols)
        state, back, label_at = [0] + [-1] * n, [0] * (n + 1), [0] * (n + 1)
        spelled, arcs, size, target = self.spelled.get, self._arcs, self._size, self.target
        for i in range(n):
            row = state[i] * size
            text = ""
            for j in range(i + 1, n + 1):
                text += symbols[j - 1]
                label = spelled(text)
                if label is None:
                    break
                if label >= 0 and state[j] < 0:
                    found = arcs.get(row + label)
                    if found is None:
                        found = self.step(state[i], label) is not None
                    if found:
                        state[j], back[j], label_at[j] = target[label], i, label
        out = []
        i = n
        while i:
            out.append(label_at[i])
            i = back[i]
        return out[::-1]


class WordBpe:
    """Encoding and decoding as the tokenizers library does with a lower-casing BPE that marks word ends."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], self.end)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace("\\s", "\\p{White_Space}")).findall
        self.plain = re.compile(PLAIN).findall if pattern == PATTERN else self.split
        self.odd = re.compile(ODD).search
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.symbol = byte_symbols()
        self.path, self._library = path, None
        self.label = list(self.automaton.label) + [""] * (max(self.added.values(), default=0) + 1 - len(self.automaton.label))
        for s, i in self.added.items():
            self.label[i] = s
        outer = self

        class Known(dict):
            def __missing__(self, word: str) -> tuple[bytes, bytes]:
                if len(self) >= MAX_WORDS:
                    self.clear()
                ids = outer.word(word)
                got = self[word] = np.array(ids, "<u4").tobytes(), " ".join(outer.label[i] for i in ids).encode()
                return got

        self.known = Known()

    def word(self, word: str) -> list[int]:
        symbols = [self.symbol[b] for b in word.encode()]
        symbols[-1] += self.end
        return self.automaton.tokens(symbols)

    def words(self, text: str) -> list[str]:
        """The pre-split words of the composed and lower-cased text."""
        if not self.odd(text):
            return self.plain(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        text = self._library.normalizer.normalize_str(text)
        return library_words(self._library.pre_tokenizer, text) if unassigned()(text) else self.split(text)

    def pieces(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from map(self.known.__getitem__, self.words(text[at : m.start()]))
            yield np.array([self.added[m[0]]], "<u4").tobytes(), m[0].encode()
            at = m.end()
        yield from map(self.known.__getitem__, self.words(text[at:] if at else text))

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        got = list(map(self.known.__getitem__, self.words(text))) if not any(s in text for s in self.added) else list(self.pieces(text))
        return b"".join([x[0] for x in got]), b" ".join([x[1] for x in got])

    def decode(self, ids: np.ndarray) -> str:
        """Arc labels, separated by blanks, as the library decodes without a decoder."""
        return " ".join([self.label[i] for i in ids])


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One automaton for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    KEPT["automaton"] = _LOADED.clear
    return _LOADED[path]


def encode_decode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", keep: Callable[[bytes, bytes], tuple] | None = None, schema: str = "ids binary, decoded string") -> DataFrame:
    """A row for each text: its key and its ids and decoded text, or what ``keep`` makes of them.

    Null text is encoded as empty: no ids, an empty decoded text. Repeated keys give
    repeated rows. One pass, no shuffle; memory is one text's ids beside the known words.
    """
    ship_package(df.sparkSession)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for t in part.column(1):
                    ids, decoded = bpe.encode(t.as_py() or "")
                    rows.append(keep(ids, decoded) if keep else (ids, decoded.decode()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows]) for i in range(len(names)))], [key, *names])

    kind = dict(df.dtypes)[key]
    return df.selectExpr(f"`{key}`", f"`{text}`").mapInArrow(lean(run, "automaton"), f"`{key}` {kind}, {schema}")


