"""All character and word counts of a text in one pass: what reports and the gate need, on Arrow batches.

The built-in expressions of ``skein.functions.text`` say the same and serve where one measure is
wanted; here a text is looked at once, by arrays over its code points, instead of by one
regular expression for each count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.config import Gate, Profile

COUNTS = ("bytes", "chars", "words", "alpha", "digit", "blank", "cyrillic", "diacritic", "clean_words", "low_cyrillic", "low_diacritic", "tokens", "stops")
LETTER, DIGIT, BLANK = 1, 2, 4
PIECE = 1 << 21


@cache
def kinds() -> np.ndarray:
    """For each code point whether it is a letter, a decimal digit, a blank (bits)."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = category(chr(c))
        if k[0] == "L":
            out[c] = LETTER
        elif k == "Nd":
            out[c] = DIGIT
        elif k[0] == "Z":
            out[c] = BLANK
    out[[*range(9, 14), *range(28, 33), 0x85]] |= BLANK
    return out


def member(letters: str) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in letters]] = True
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and where each text begins (one entry more)."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4"), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def sums(mark: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many marks each text has."""
    total = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    return total[begin[1:]] - total[begin[:-1]]


def runs(mark: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marks that don't cross texts."""
    n = len(mark)
    first, last = mark.copy(), mark.copy()
    first[1:] &= ~mark[:-1]
    last[:-1] &= ~mark[1:]
    cut = begin[(begin > 0) & (begin < n)]
    first[cut] = mark[cut]
    last[cut - 1] = mark[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def measure(docs: DataFrame, profile: Profile, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the ``COUNTS`` of each text. Null texts have null counts. One pass, no shuffle;
    a batch is taken in runs of about ``PIECE`` bytes.
    """
    letters, diacritics = profile.letters, profile.diacritics

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = kinds()
        clean = member("".join(map(chr, [*range(65, 91), *range(97, 123)])) + letters + letters.upper() + "-")
        marked, low_marked = member(diacritics + diacritics.upper()), member(diacritics)
        token_letter = member("".join(map(chr, range(97, 123))) + letters)
        longest = max(map(len, profile.stopwords))
        stop = np.sort(np.array([sum(ord(c) << 16 * k for k, c in enumerate(w)) for w in profile.stopwords if len(w) <= 4], np.uint64))
        long_stops = {w for w in profile.stopwords if len(w) > 4}

        def counts(texts: list[str]) -> list[np.ndarray]:
            c, begin = code_points(texts)
            k = kind[c]
            filled = (k & BLANK) == 0
            start, end = runs(filled, begin)
            odd = np.concatenate([[0], np.cumsum(~clean[c], dtype=np.int64)])
            owner = np.searchsorted(begin, start, side="right") - 1
            n = len(texts)
            out = [
                np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts]), np.diff(begin), np.bincount(owner, minlength=n), sums(k & LETTER > 0, begin), sums(k & DIGIT > 0, begin), sums(~filled, begin),
                sums((c >= 0x400) & (c <= 0x4FF), begin), sums(marked[c], begin), np.bincount(owner[odd[end] == odd[start]], minlength=n),
            ]
            low_texts = [t.lower() for t in texts]
            low, at = code_points(low_texts)
            a, b = runs(token_letter[low], at)
            packed = np.zeros(len(a), np.uint64)
            for j in range(4):
                here = a + j < b
                packed[here] |= low[a[here] + j].astype(np.uint64) << np.uint64(16 * j)
            hit = np.isin(packed, stop) & (b - a <= 4)
            if long_stops:
                whole = "".join(low_texts)
                for i in np.flatnonzero((b - a > 4) & (b - a <= longest)).tolist():
                    hit[i] = whole[a[i] : b[i]] in long_stops
            token_owner = np.searchsorted(at, a, side="right") - 1
            out += [sums((low >= 0x400) & (low <= 0x4FF), at), sums(low_marked[low], at), np.bincount(token_owner, minlength=n), np.bincount(token_owner[hit], minlength=n)]
            return out

        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = column.to_pylist()
            done: list[list[np.ndarray]] = []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= PIECE):
                    size += len(texts[j] or "")
                    j += 1
                done.append(counts([t or "" for t in texts[i:j]]))
                i = j
            missing = np.array([t is None for t in texts], bool)
            columns = [pa.array(np.concatenate(x), pa.int64(), mask=missing) for x in zip(*done, strict=True)] if done else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*keep, *(f"n_{c}" for c in COUNTS)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields), *(f"n_{c} long" for c in COUNTS)])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) == 0, F.lit(0.0)).otherwise(F.col(part).cast("double") / F.col(whole))


def signals() -> dict[str, Column]:
    """The gate's signals from the counts."""
    return {"alpha": ratio("n_clean_words", "n_words"), "cyrillic": ratio("n_low_cyrillic", "n_chars"), "diacritic": ratio("n_low_diacritic", "n_chars"), "stopword": ratio("n_stops", "n_tokens")}


def reason(gate: Gate) -> Column:
    """The first reason against a text, as ``skein.functions.text.gate_reason`` gives it; null if it passes."""
    s = signals()
    first = F.when(F.coalesce(F.col("n_chars") - F.col("n_blank"), F.lit(0)) == 0, "empty").when(s["alpha"] < gate.min_alpha, "alpha")
    return first.when(s["cyrillic"] > gate.max_cyrillic, "cyrillic").when(s["diacritic"] < gate.min_diacritic, "diacritic").when(s["stopword"] < gate.min_stopword, "stopword")
