"""Semantics on hand-written rows that the tables don't have."""

import random

import pytest
from pyspark.sql import functions as F
from skein.config import POLISH, POLISH_GATE
from skein.functions import stats
from skein.functions import text as T
from skein.operators import ordering
from skein.plans import textual


def one(spark, column, *values, schema="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {schema}")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]




def test_lines(spark):
    X = F.col("x")  # noqa: N806
    assert one(spark, T.is_garbage(X, POLISH), "NH BEC BPE Ha U JMR TW", "A SR ckw l ki nn UR", "A b c d ckw", "=.", "", "Zwykły wiersz tekstu") == [True, False, True, True, False, False]
    assert one(spark, T.is_page_furniture(X), "- 12 -", "Nr 7", "Rok pański", "Tom II 3", "zwykły", "12345") == [True, True, False, True, False, False]
    assert one(spark, T.is_digitisation(X), "Digitized by X", "ISBN 83", "misbnx", "domena publiczna", "zwykły") == [True, True, False, True, False]
    assert one(spark, T.is_junk(X), "12 - 13", "Digitized  by  Google", "google", "rok 12", "", "--") == [True, True, True, False, False, False]


def test_token_reasons(spark):
    X = F.col("x")  # noqa: N806
    tokens = ["SoKoła", "ledaKcji", "bezgraniczn3rm", "w^szystko", "krwczk", "ABC", "dom", "1918"]
    r = T.token_reasons(X, POLISH)
    got = [[k for k, v in zip(r, row, strict=True) if v] for row in zip(*(one(spark, c, *tokens) for c in r.values()), strict=True)]
    assert got == [["midcaps"], ["midcaps"], ["digit_mix"], ["symbol"], ["no_vowel"], [], [], []]


def test_cleaners(spark):
    X = F.col("x")  # noqa: N806
    assert one(spark, T.dehyphenate(X), "prze-\ncież a-\n  b", "x-\n1") == ["przecież ab", "x-\n1"]
    assert one(spark, T.reflow(X), "a\nb\n\n\nc  d \n e") == ["a b\n\nc d e"]
    columns = "\n".join(f"l{i}|r{i}" for i in range(6))
    assert one(spark, T.split_columns(X), columns, "a|b\nc") == ["\n".join(f"l{i}" for i in range(6)) + "\n\n" + "\n".join(f"r{i}" for i in range(6)), "a b\nc"]
    assert one(spark, T.unwrap(X), "za-\ndanie\ndrugie\n\n\n\ntrzecie\n") == ["zadanie drugie\n\ntrzecie"]
    assert one(spark, T.cut_head(X), "a\nGoogle b\nc\nd", "a\nb", "google") == ["c\nd", "a\nb", ""]
    assert one(spark, T.normalise(X, footer=True), " a\r\nb\n\n\n\nc\n---\nfoot\n") == ["a\nb\n\nc\n"]
    assert one(spark, T.nfc(T.normalise_characters(X)), "źa​©b\tc") == ["źa b\tc"]
    assert one(spark, T.strip_colophon(X, F.lit(True)), "tekst\nISBN 12\nkoniec") == ["tekst\nkoniec"]


def test_gate(spark):
    X = F.col("x")  # noqa: N806
    ok = "się że nie jest który była było żółć gęś kość " * 3
    assert one(spark, T.gate_reason(X, POLISH, POLISH_GATE), ok, "The English text of a book", " \n", None) == [None, "diacritic", "empty", "empty"]
    assert one(spark, T.in_language(X, POLISH, POLISH_GATE), ok, "plain") == [True, False]


def test_years_and_orthography(spark):
    X = F.col("x")  # noqa: N806
    assert one(spark, T.digit_runs(X, 1920, 2099), "x11936 1936 1940a 1919") == [["1936", "1940"]]
    assert one(spark, T.context_years(X), "w r. 1936 i 1940 r. oraz 1950") == [["1936", "1940"]]
    m, p = T.orthography(X)
    assert (one(spark, m, "Francja stacyi poezja"), one(spark, p, "Francja stacyi poezja")) == ([2], [1])


def test_identifiers(spark):
    X = F.col("x")  # noqa: N806
    ids = ["jbc.bj.uj.edu.pl.NDIGCZAS017303-1", "47920560R.nlm.nih.gov", "abc00goog", "plain", "123.pl"]
    assert one(spark, T.uploader(X), *ids) == ["jbc.bj.uj.edu.pl", "nlm.nih.gov", "google-books", "other", "pl"]
    assert one(spark, textual.place_of(X), "[Lwów] (Ukraina); pl", "pl ; Kraków.", "miejsce nieznane", "pl") == ["Lwów", "Kraków", None, None]
    assert one(spark, textual.title_of(X), "Czas. 1888, nr 100", "[Gazeta Lwowska] 1899", "Kurjer : dziennik") == ["Czas", "Gazeta Lwowska", "Kurjer"]
    b, d = textual.life_years(X)
    assert (one(spark, b, "Prus, B. (1847-1912)", "x"), one(spark, d, "Prus, B. (1847-1912)", "x")) == ([1847, None], [1912, None])
    v = textual.as_list(F.parse_json(X))
    assert one(spark, v, '["a", "b"]', '"a"', "null") == [["a", "b"], ["a"], []]
    c = textual.collection_class(F.split(X, ","), F.lit("idgoog"), ("fav",), ("lib",))
    assert one(spark, c, "a,fav", "opensource", "lib") == ["modern_scan", "community_upload", "google_books"]


def test_wilson_and_kappa(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (5, 10)], "k long, n long")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = [(round(r.l, 4), round(r.h, 4)) for r in df.select(low.alias("l"), high.alias("h")).collect()]
    assert rows == [(0.0, 1.0), (0.0, 0.2775), (0.2366, 0.7634)]
    low, _ = stats.wilson(F.col("k"), F.col("n"), empty=None)
    assert df.select(low.alias("l")).first().l is None
    assert one(spark, stats.kappa(F.lit(1.0), F.lit(1.0)), "x") == [1.0]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distances(spark):
    rng = random.Random(1)
    pairs = [(" ".join(rng.choices(["ą", "b", "cc", "Ł"], k=rng.randint(0, 9))), " ".join(rng.choices(["ą", "b", "cc", "Ł"], k=rng.randint(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", textual.word_distances("a", "b").alias("w"), F.levenshtein("a", "b").alias("c")).collect()
    for r in rows:
        assert (r.w, r.c) == (levenshtein(r.a.split(), r.b.split()), levenshtein(r.a, r.b))


def test_character_error_rate_takes_whole_turns(spark, tmp_path):
    rng = random.Random(2)
    turns = [(c, t, "user", "".join(rng.choices("aąb c", k=rng.choice([150, 260, 420])))) for c in range(4) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for r in textual.character_error_rate(spark, str(tmp_path)).collect():
        own = [x[3] for x in turns if x[0] == r.conv_id]
        edits, chars = sum(map(levenshtein, own, own[1:])), sum(map(len, own[:-1]))
        assert (r.pairs, r.edits, r.chars, r.cer) == (3, edits, chars, round(edits / chars, 6))


@pytest.mark.parametrize("n", [0, 1, 57])
def test_global_order_in_ranges(spark, n):
    values = list(range(n))
    random.Random(n).shuffle(values)
    df = spark.createDataFrame([(v, v % 5 + 1) for v in values], "k long, w long").repartition(3)
    assert sorted((r.k, r.ordinal) for r in ordering.ordinals(spark, df, ["k"]).collect()) == [(i, i) for i in range(n)]
    assert sorted((r.k, r.before) for r in ordering.running(spark, df, ["k"], "w").collect()) == [(i, sum(j % 5 + 1 for j in range(i))) for i in range(n)]
    assert sorted((r.k, r.following) for r in ordering.following(spark, df, ["k"], "k").collect()) == [(i, i + 1 if i + 1 < n else None) for i in range(n)]
