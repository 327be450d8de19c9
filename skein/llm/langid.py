"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's bytes are mapped to 128 classes and cut into windows of fixed length. Filters of
several widths run over each window, the largest response of each filter in a window is
kept (max pooling), and a softmax layer gives the window's languages. A text's language is
the largest mean log-probability over all its windows, weighted by their letters.

A filter of width w is a table (w, classes): its response at a byte is a sum of w entries.
For prediction, tables of neighbouring bytes are added up beforehand, so that a filter of
width 2, 3 or 4 needs one or two look-ups for a byte. Only the text is ever an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.arrays import buffers, lean, slices
from skein.session import ship_package

CLASSES = 128
WIDTHS = (2, 3, 4)
WINDOW = 256
PIECE = 4096 * WINDOW
UNDETERMINED = "und"


def _classes() -> np.ndarray:
    """0 pads; letters without case, blank, digit, other ASCII; bytes beyond ASCII by themselves or in pairs."""
    c = np.full(256, 29, np.uint8)
    c[:32] = 31
    c[9:14] = c[32] = 27
    c[39] = 30
    c[48:58] = 28
    c[65:91] = c[97:123] = np.arange(1, 27)
    c[128:192] = np.arange(32, 96)
    c[192:256] = 96 + np.arange(64) // 2
    return c


CLASS_OF = _classes()
#: classes that count as letters when windows are weighted
LETTER = np.zeros(CLASSES, bool)
LETTER[1:27] = LETTER[96:] = True


@dataclass
class Network:
    """``tables[k]``: (width, classes, filters); then biases, the softmax layer and its labels."""

    labels: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    def __post_init__(self):
        pair = lambda a, b: (a[:, None] + b[None, :]).reshape(CLASSES * CLASSES, -1)
        two, three, four = self.tables
        self.pairs = pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1]), pair(four[2], four[3])
        self.single = np.ascontiguousarray(three[2])

    def windows(self, classes: np.ndarray) -> np.ndarray:
        """Log-probabilities of (windows, WINDOW + 3) classes, the last three being padding."""
        n = len(classes)
        pair = classes[:, :-1].astype(np.int32) * CLASSES + classes[:, 1:]
        pooled = [self.pairs[0][pair[:, :WINDOW]].max(axis=1)]
        three = self.pairs[1][pair[:, :WINDOW]]
        three += self.single[classes[:, 2 : WINDOW + 2]]
        pooled.append(three.max(axis=1))
        np.take(self.pairs[2], pair[:, :WINDOW], axis=0, out=three)
        three += self.pairs[3][pair[:, 2 : WINDOW + 2]]
        pooled.append(three.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return log_softmax(hidden @ self.weight + self.offset).reshape(n, -1)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(classes: np.ndarray, target: np.ndarray, labels: list[str], filters: int = 16, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit on (windows, WINDOW + 3) classes. Adam; the same rows always give the same network."""
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.3, (w, CLASSES, filters)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros(filters * len(WIDTHS), np.float32)
    weight = rng.normal(0, 0.2, (len(bias), len(labels))).astype(np.float32)
    offset = np.zeros(len(labels), np.float32)
    params = [*tables, bias, weight, offset]
    moment = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(classes))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, n = classes[rows], len(rows)
            pooled, where = [], []
            for table, w in zip(tables, WIDTHS, strict=True):
                response = table[0][x[:, :WINDOW]]
                for k in range(1, w):
                    response += table[k][x[:, k : WINDOW + k]]
                best = response.argmax(axis=1)
                where.append(best)
                pooled.append(np.take_along_axis(response, best[:, None, :], axis=1)[:, 0])
            before = np.concatenate(pooled, axis=1) + bias
            hidden = np.maximum(before, 0)
            wrong = np.exp(log_softmax(hidden @ weight + offset))
            wrong[np.arange(n), target[rows]] -= 1
            wrong /= n
            back = (wrong @ weight.T) * (before > 0)
            grads = []
            for t, (table, w) in enumerate(zip(tables, WIDTHS, strict=True)):
                g, part = np.zeros_like(table), back[:, t * filters : (t + 1) * filters]
                for k in range(w):
                    seen = np.take_along_axis(x[:, k : WINDOW + k], where[t], axis=1)
                    np.add.at(g[k], (seen, np.arange(filters)[None, :]), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]
            step += 1
            for p, g, m, s in zip(params, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        rate *= 0.8
    return Network(labels, tables, bias, weight, offset)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, padded with class 0, and the first window of each text."""
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    first = np.concatenate([[0], np.cumsum(counts)])
    grid = np.zeros((int(first[-1]), WINDOW + 3), np.uint8)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], lengths) + np.repeat(first[:-1] * WINDOW, lengths)
    grid[at // WINDOW, at % WINDOW] = CLASS_OF[data]
    return grid, first


def fit(labelled: DataFrame, label: str = "lang", text: str = "text", order: str = "doc_id", max_documents: int = 1600, windows: int = 4, **options) -> Network | None:
    """Train on a bounded sample of labelled rows; None if there are none.

    ``max_documents`` bounds the rows that reach the driver, dealt evenly to the labels, and
    ``windows`` the windows of each (evenly spaced over the whole text). Which rows: those
    with the smallest hash of ``order``; a first pass counts the labels, so that the second
    sends little more than the sample. Null labels and texts aren't used.
    """
    rows = labelled.selectExpr(f"cast(`{label}` AS string) AS label", f"`{text}` AS text", f"xxhash64(cast(`{order}` AS string)) AS h").filter("label IS NOT NULL AND text IS NOT NULL")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return None
    each = max(1, max_documents // len(counts))
    span = 1 << 62
    limits = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(int(span * min(1.0, (2.0 * each + 20) / n))))))
    taken = rows.filter(F.expr(f"pmod(h, {span})") <= limits[F.col("label")])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            grid, first = cut_windows(data, offsets)
            out = []
            for i in range(batch.num_rows):
                n = int(first[i + 1] - first[i])
                at = first[i] + np.unique(np.linspace(0, n - 1, min(n, windows)).astype(np.int64)) if n else []
                out.append(b"".join(grid[k].tobytes() for k in at))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["label", "h", "grid"])

    got = sorted(taken.mapInArrow(lean(pick), "label string, h long, grid binary").collect(), key=lambda r: (r.label, r.h % span, r.h, bytes(r.grid)))
    labels = sorted(counts)
    kept: dict[str, int] = dict.fromkeys(labels, 0)
    grids, target = [], []
    for r in got:
        if kept[r.label] < each:
            kept[r.label] += 1
            grid = np.frombuffer(bytes(r.grid), np.uint8).reshape(-1, WINDOW + 3)
            grid = grid[LETTER[grid].any(axis=1)]
            grids.append(grid)
            target += [labels.index(r.label)] * len(grid)
    if not target:
        return None
    return train(np.concatenate(grids), np.array(target), labels, **options)


def predict_texts(network: Network | None, column: pa.Array, has_letter) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a column."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    if network is None:
        return [UNDETERMINED] * n, np.zeros(n)
    full, total = np.zeros((n, len(network.labels))), np.zeros(n)
    lengths = np.diff(offsets)
    pieces = -(-lengths // PIECE)
    owner = np.repeat(np.arange(n), pieces)  # a long text is taken in pieces of whole windows
    begin = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    end = np.minimum(begin + PIECE, offsets[1:][owner])
    i = 0
    while i < len(owner):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + PIECE, side="right")))
        grid, first = cut_windows(data[begin[i] : end[j - 1]], np.append(begin[i:j], end[j - 1]) - begin[i])
        weight = LETTER[grid].sum(axis=1) + 1e-3
        scores = np.empty((len(grid), len(network.labels)))
        for k in range(0, len(grid), 256):
            scores[k : k + 256] = network.windows(grid[k : k + 256])
        np.add.at(full, owner[i:j], np.add.reduceat(scores * weight[:, None], first[:-1], axis=0))
        np.add.at(total, owner[i:j], np.add.reduceat(weight, first[:-1]))
        i = j
    mean = full / np.maximum(total, 1e-9)[:, None]
    p = np.exp(log_softmax(mean))
    best = p.argmax(axis=1)
    lang, score = [], p[np.arange(n), best]
    for i, text in enumerate(column):
        known = text.is_valid and has_letter(text.as_py()) is not None
        lang.append(network.labels[best[i]] if known else UNDETERMINED)
        if not known:
            score[i] = 0.0
    return lang, score


def predict(df: DataFrame, network: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all), lang_pred and score of each row.

    Of languages with equal scores the first in alphabetical order is taken. Null text and text without a letter: ``und``, score 0. An input column called
    lang_pred or score is replaced. One pass, no shuffle; the network (some 0.1 MB) is
    sent as a broadcast.
    """
    ship_package(df.sparkSession)
    names = [c for c in (keep if keep is not None else df.columns) if c not in ("lang_pred", "score")]
    schema = df.select(*(F.col(f"`{c}`") for c in names)).schema
    sent = df.sparkSession.sparkContext.broadcast((network.labels, network.tables, network.bias, network.weight, network.offset) if network else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        has_letter = regex.compile(r"\p{L}").search
        net = Network(*sent.value) if sent.value else None
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                lang, score = predict_texts(net, part.column(part.num_columns - 1), has_letter)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), "lang_pred string", "score double"])
    return df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").alias("__text")).mapInArrow(lean(run), spec)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: a language is given and crc32(doc_id as text) mod 4 is not 2."""
    return docs.filter("lang IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2")
