"""Information-theoretic sanitisation of personal data.

Base patterns find protected entities (e-mail, IP, card, phone) in whole texts. Corpus
co-occurrence then tells how strongly a term reveals an entity. With document frequencies
over all N documents, an entity c carries IC(c) = -log2(df(c) / N) bits and a term t in a
document of it reveals PMI(c; t) = log2(N df(c, t) / (df(c) df(t))) of them. The disclosure
is PMI / IC: 1 if the term occurs with the entity only. At ``generalise`` and more the term
is replaced by what kind of term it is (a number, a name, a word), at ``remove`` and more it is taken out; both wherever it stands in
the documents of that entity. A term must be in ``support`` documents of an entity to be
judged, or in all of them if the entity has fewer: a term in the one document of an entity
reveals IC(t) / IC(c). No entity that is in all documents carries any information. Function
words (the stopwords of the language profile) are no terms, others are of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import WESTERN
from skein.llm.arrays import ALNUM, buffers, distinct_by_owner, hash_spans, lean, slices, words
from skein.llm.rows import TEXT_HASH
from skein.session import Scratch, ship_package

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(65, 91)}
_FUNCTION = frozenset(WESTERN.stopwords)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, in linear time: grown from each @ instead of each letter."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, end := m.end()))
        at = text.find("@", at + 1)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Each four dotted numbers in a row, from the left of a dotted run; kept if none is over 255."""
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


FINDERS = (emails, addresses, cards, phones)


def find_base(text: str, digits: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted. ``digits``: how many the text has."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if digits >= 4:
        found += [(s, 1, e) for s, e in addresses(text)]
        if digits >= 9 and "+" in text:
            found += [(s, 3, e) for s, e in phones(text)]
        if digits >= 12:
            found += [(s, 2, e) for s, e in cards(text)]
    return sorted(found)


def entity(kind: int, value: str) -> int:
    """What a span stands for, whatever its punctuation or case, as a signed 64-bit hash."""
    value = value.lower() if kind == 0 else value if kind == 1 else _NOT_DIGIT.sub("", value)
    return int(np.uint64(xxhash.xxh64_intdigest(f"{KINDS[kind]}:{value}")).astype(np.int64))


def context(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, bytes]]:
    """(start, end, folded bytes) of a text's terms: its words, but function words and those that touch a base span."""
    out, k, last = [], 0, 0
    for m in _TERM.finditer(text.translate(_FOLD)):
        a, b = m.span()
        while k < len(spans) and spans[k][0] < b:
            last = max(last, spans[k][2])
            k += 1
        if last <= a and m[0] not in _FUNCTION:
            out.append((a, b, m[0].encode()))
    return out


FOUND = "doc_id {kind}, text_hash long, spans array<struct<start:int,kind:int,stop:int>>, entities array<long>, terms array<struct<term:long,start:int,stop:int>>, term long, df long"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
_WHO = pa.list_(pa.int64())
_TERMS = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]))
_NAMES = ["doc_id", "text_hash", "spans", "entities", "terms", "term", "df"]


def search(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over all texts. A row for each document: its base spans, entities and, if it has any, terms;
    and rows (term, df) with each task's document frequencies of all words, merged every few million.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None
        seen: list[np.ndarray] = []
        held = 0

        def counted() -> pa.RecordBatch:
            terms, df = np.unique(np.concatenate(seen), return_counts=True)
            n = len(terms)
            return pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, _SPAN), pa.nulls(n, _WHO), pa.nulls(n, _TERMS), pa.array(terms.view(np.int64)), pa.array(df)], _NAMES)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch, "text"):
                data, offsets = buffers(part.column(2))
                starts, ends, first = words(data, offsets, ALNUM)
                n = part.num_rows
                terms, _ = distinct_by_owner(hash_spans(data, starts, ends), np.repeat(np.arange(n), np.diff(first)))
                seen.append(terms)
                held += len(terms)
                digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])[offsets]
                spans, who, said = [], [], []
                for i, t in enumerate(part.column(2)):
                    value = (t.as_py() or "") if digit[i + 1] - digit[i] >= 4 or b"@" in data[offsets[i] : offsets[i + 1]].tobytes() else ""
                    found = find_base(value, int(digit[i + 1] - digit[i]))
                    spans.append([{"start": s, "kind": k, "stop": e} for s, k, e in found])
                    who.append(sorted({entity(k, value[s:e]) for s, k, e in found}))
                    around = context(value, found) if found else []
                    if around:
                        b, o = buffers(pa.array([x[2] for x in around], pa.binary()))
                        ids = hash_spans(b, o[:-1], o[1:]).view(np.int64).tolist()
                        said.append([{"term": h, "start": x[0], "stop": x[1]} for x, h in zip(around, ids, strict=True)])
                    else:
                        said.append([])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, _SPAN), pa.array(who, _WHO), pa.array(said, _TERMS), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], _NAMES)
                if held > 4_000_000:
                    yield counted()
                    seen, held = [], 0
        if seen:
            yield counted()

    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.expr(TEXT_HASH.format(text=text)).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(lean(run), FOUND.format(kind=kind))


def disclosures(found: DataFrame, n: int, support: int, generalise: float, scratch: Scratch) -> DataFrame:
    """(row, term, disclosure): the terms of each document that reveal ``generalise`` of one of its entities or more.

    Counts are of documents, over all of them, and are summed up in each task first. Only a
    term in at most N^(1 - generalise) df(c)^generalise documents can reveal so much of c;
    the others go before terms meet entities. Entities of one document need no such meeting.
    """
    rows = found.filter("df IS NULL")
    held = rows.selectExpr("row", "explode(entities) AS entity")
    sizes = held.groupBy("entity").agg(F.count("*").alias("df_entity")).filter(f"df_entity < {n}")
    held = scratch.table(held.join(sizes, "entity"), "held")
    most = lambda df: f"pow({n}D, {1 - generalise}) * pow({df}, {generalise}) * 1.000001D"
    around = held.groupBy("row").agg(F.max("df_entity").alias("most"), F.min("df_entity").alias("least"))
    words = found.filter("df IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df_term"))
    said = rows.filter("size(entities) > 0").selectExpr("row", "explode(array_distinct(terms.term)) AS term")
    rare = scratch.table(said.join(around, "row").join(words, "term").filter(f"df_term <= {most('most')}").select("row", "term", "df_term", "least"), "rare")
    alone = rare.filter("least = 1").selectExpr("row", "term", f"log2({n}D / df_term) / log2({n}D) AS disclosure")
    meet = rare.join(held.filter("df_entity > 1"), "row").filter(f"df_term <= {most('df_entity')}")
    joint = meet.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("df_entity").alias("df_entity"), F.first("df_term").alias("df_term")).filter(f"both >= least({support}, df_entity)")
    ratio = f"log2({n}D * both / (cast(df_entity AS double) * df_term)) / -log2(df_entity / {n}D)"
    told = joint.selectExpr("entity", "term", f"{ratio} AS disclosure").filter(F.col("disclosure") >= generalise)
    shared = meet.select("row", "entity", "term").join(told, ["entity", "term"]).select("row", "term", "disclosure")
    return alone.filter(F.col("disclosure") >= generalise).unionByName(shared).groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))


def find(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = 3, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """key, text_hash, spans: all spans of each row as (start, kind, stop, action), sorted.

    Actions: ``remove`` for base spans and terms over that threshold, else ``generalise``.
    Null text counts as empty; a document without personal data has no spans. Rows are told
    apart even if their keys are equal or null; a repeated row counts as a document of its own.
    Only the pass over the texts is written to the shared folder; no text is shuffled, and what
    is joined are hashes of the terms of documents with an entity, so an entity that many
    documents hold is spread over its terms.
    """
    ship_package(spark)
    scratch = Scratch(spark, "privacy")
    found = scratch.table(search(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "found")
    rows = found.filter("df IS NULL")
    n = rows.count()
    told = scratch.table(disclosures(found, max(n, 1), support, generalise, scratch), "disclosures")
    terms = (
        rows.selectExpr("row", "explode(terms) AS x")
        .selectExpr("row", "x.term", "x.start", "x.stop")
        .join(told, ["row", "term"])
        .groupBy("row")
        .agg(F.collect_list(F.expr(f"struct(start, 4 AS kind, stop, if(disclosure >= {remove}, 'remove', 'generalise') AS action)")).alias("told"))
    )
    base = "transform(spans, s -> struct(s.start, s.kind, s.stop, 'remove' AS action))"
    joined = rows.select("row", "doc_id", "text_hash", "spans").join(terms, "row", "left")
    return joined.selectExpr(f"doc_id AS `{key}`", "text_hash", f"array_sort(if(told IS NULL, {base}, concat({base}, told))) AS spans")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    name = "element_at(array('email', 'ip', 'card', 'phone', 'term'), s.kind + 1)"
    said = f"s -> concat_ws(':', {name}, cast(s.start AS string), cast(s.stop AS string))"
    counts = [f"cast(size(filter(spans, s -> s.kind = {i})) AS long) AS n_{k}" for i, k in enumerate(KINDS)]
    return found.selectExpr(
        f"`{key}`",
        *counts[:4],
        f"sha2(array_join(transform(filter(spans, s -> s.kind < 4), {said}), ','), 256) AS base_sha256",
        f"array_join(transform(spans, {said}), ',') AS spans",
        counts[4],
        "cast(size(filter(spans, s -> s.kind = 4 AND s.action = 'generalise')) AS long) AS n_generalised",
    )


def sanitise(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their spans taken out or generalised to their kind in brackets.

    Spans that overlap are treated as one, removed if one of them is. Only documents with
    spans meet in the join, by key and text; the rest keep their text. A column that is called
    ``__key``, ``__hash`` or ``__spans`` would clash.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def rewrite(texts, spans):
        return texts.combine(spans, lambda t, s: _rewritten(t, s))

    some = found.filter("size(spans) > 0").select(F.col(f"`{key}`").alias("__key"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")).dropDuplicates(["__key", "__hash"])
    joined = docs.join(some, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.expr(TEXT_HASH.format(text=text)) == F.col("__hash")), "left")
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(f"`{text}`")).otherwise(rewrite(F.col(f"`{text}`"), F.col("__spans")))).drop("__key", "__hash", "__spans")


def general(term: str) -> str:
    """What kind of term it is: a number if it has a digit, a name if it begins with a capital, else a word."""
    return "number" if any(c.isdigit() for c in term) else "name" if term[:1].isupper() else "word"


def _rewritten(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    out, at, i = [], 0, 0
    spans = sorted(((s["start"], s["stop"], s["kind"], s["action"]) for s in spans))
    while i < len(spans):
        start, stop, kind, action = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < stop:
            stop = max(stop, spans[i][1])
            action = "remove" if "remove" in (action, spans[i][3]) else action
            kind = min(kind, spans[i][2])
            i += 1
        out.append(text[at:start] + ("" if action == "remove" and kind == 4 else f"[{KINDS[kind] if kind < 4 else general(text[start:stop])}]"))
        at = stop
    return "".join(out) + text[at:]
