"""Counts of words and of adjacent words, by their 64-bit hashes, summed up in each task before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD = 2_000_000


def word_hash(word: Column) -> Column:
    """The hash that ``gram_counts`` gives a word: XXH64 of its UTF-8 bytes, seed 42."""
    return F.xxhash64(word)


def gram_counts(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """(a, n) or (a, b, n): how often each word, or each pair of adjacent words of a text, stands in what a task has
    read; partial counts, to be summed up. Words are those of the lower-cased text.
    """
    names = ["a", "b"][:width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode(), 42) for w in known), np.uint64, len(known)).view(np.int64)
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            parts = [grams >> 32, grams & 0xFFFFFFFF][2 - width :]
            return pa.RecordBatch.from_arrays([*(pa.array(hashes[p]) for p in parts), pa.array(n)], [*names, "n"])

        for batch in batches:
            for x in batch.column(0):
                words = (x.as_py() or "").lower().split()
                ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
                grams = ids if width == 1 else ids[:-1] << 32 | ids[1:]
                if len(grams):
                    held.append(grams)
                    size += len(grams)
                if size > HELD:
                    yield flush()
                    known, held, size = {}, [], 0
        if held:
            yield flush()

    return docs.select(F.col(text).alias("t")).mapInArrow(run, ", ".join([*(f"{c} long" for c in names), "n long"]))
