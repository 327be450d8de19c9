"""Column functions over texts: words, lines, metrics, cleaners. All are built-in expressions.

Blanks are Unicode's, as Python's ``str.split`` takes them. Functions take a column (or
its name) and return a column, so that Catalyst sees one expression for each text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein import config
from skein.config import Gate, Profile

BLANK = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD = f"[^{BLANK}]+"
#: the same characters one by one, for trimming
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Runs of anything but Unicode blanks."""
    return F.regexp_extract_all(col(text), F.lit(f"({WORD})"), F.lit(1))


def lines(text: Column | str) -> Column:
    return F.split(col(text), "\n", -1)


def strip(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def count_of(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern)).cast("long")


def count_without(text: Column | str, rest: str) -> Column:
    """Characters that are left when runs of ``rest`` are taken out: fewer matches than counting one by one."""
    return F.length(F.regexp_replace(col(text), f"{rest}+", "")).cast("long")


def count_letters(text: Column | str) -> Column:
    return count_without(text, r"\P{L}")


def count_filled(text: Column | str) -> Column:
    """Characters that aren't blank."""
    return count_without(text, f"[{BLANK}]")


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 if there is nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def matching(items: Column, pattern: str) -> Column:
    return F.size(F.filter(items, lambda x: x.rlike(pattern))).cast("long")


# ---- measures of one text


def clean_word_share(text: Column | str, profile: Profile, w: Column | None = None) -> Column:
    """Words of nothing but the profile's letters and hyphens, among all words (``w`` if they are known)."""
    w = words(text) if w is None else w
    letters = profile.letters + profile.letters.upper()
    return share(matching(w, f"^[A-Za-z{letters}-]+$"), F.size(w))


def letter_share(text: Column | str) -> Column:
    """Letters among all characters that aren't blank."""
    return share(count_letters(text), count_filled(text))


def one_char_share(text: Column | str, w: Column | None = None) -> Column:
    w = words(text) if w is None else w
    return share(F.size(F.filter(w, lambda x: F.length(x) == 1)).cast("long"), F.size(w))


def caps_share(text: Column | str, profile: Profile, w: Column | None = None) -> Column:
    """Words of one to four capitals among all words: what garbled headings look like."""
    w = words(text) if w is None else w
    return share(matching(w, f"^[A-Z{profile.letters.upper()}]{{1,4}}$"), F.size(w))


def noise_score(text: Column | str) -> Column:
    """Three times the share of characters that are no letters, plus twice that of one-character words."""
    return (F.lit(1.0) - letter_share(text)) * 3 + one_char_share(text) * 2


def language_signals(text: Column | str, profile: Profile) -> dict[str, Column]:
    """Cyrillic and diacritic characters of all, and stop words among the profile's words."""
    low = F.lower(col(text))
    n = F.length(low)
    tokens = F.regexp_extract_all(low, F.lit(f"([a-z{profile.letters}]+)"), F.lit(1))
    stops = F.array(*map(F.lit, profile.stopwords))
    return {
        "cyrillic": share(count_of(low, "[Ѐ-ӿ]"), n),
        "diacritic": share(count_of(low, f"[{profile.diacritics}]"), n),
        "stopword": share(F.size(F.filter(tokens, lambda t: F.array_contains(stops, t))).cast("long"), F.size(tokens)),
    }


def gate_reason(text: Column | str, profile: Profile, gate: Gate) -> Column:
    """The first reason against a text: empty, alpha, cyrillic, diacritic, stopword; null if it passes."""
    s = language_signals(text, profile)
    return (
        F.when(F.coalesce(F.length(strip(col(text))), F.lit(0)) == 0, "empty")
        .when(clean_word_share(text, profile) < gate.min_alpha, "alpha")
        .when(s["cyrillic"] > gate.max_cyrillic, "cyrillic")
        .when(s["diacritic"] < gate.min_diacritic, "diacritic")
        .when(s["stopword"] < gate.min_stopword, "stopword")
    )


def in_language(text: Column | str, profile: Profile, gate: Gate) -> Column:
    """All three signals of the language at once."""
    s = language_signals(text, profile)
    return (s["cyrillic"] <= gate.max_cyrillic) & (s["diacritic"] >= gate.min_diacritic) & (s["stopword"] >= gate.min_stopword)


def character_classes(text: Column | str, profile: Profile) -> dict[str, Column]:
    c = col(text)
    return {
        "bytes": F.octet_length(c).cast("long"),
        "chars": F.length(c).cast("long"),
        "words": F.size(words(c)).cast("long"),
        "alpha": count_letters(c),
        "digit": count_without(c, r"\P{Nd}"),
        "blank": F.length(c).cast("long") - count_filled(c),
        "cyrillic": count_of(c, "[Ѐ-ӿ]"),
        "diacritic": count_of(c, f"[{profile.diacritics}{profile.diacritics.upper()}]"),
    }


def substring_count(text: Column, stem: str) -> Column:
    """Occurrences that don't overlap."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(stem), F.lit("")))
    return (gone / len(stem)).cast("long")


def snippet(text: Column, low: Column, stem: str, reach: int = 60) -> Column:
    """The first occurrence with ``reach`` characters on both sides, on one line."""
    at = F.instr(low, stem)
    start = F.greatest(at - reach, F.lit(1))
    return F.translate(F.substring(text, start, at + len(stem) + reach - start), "\n", " ")


def digit_runs(text: Column | str, low: int, high: int) -> Column:
    """Numbers of exactly four digits from ``low`` to ``high``, as strings, in order."""
    runs = F.regexp_extract_all(col(text), F.lit("([0-9]+)"), F.lit(1))
    return F.filter(runs, lambda r: (F.length(r) == 4) & (r >= str(low)) & (r <= str(high)))


def context_years(text: Column | str) -> Column:
    """Years 1920 to 2099 written as dates: after ``r.``, ``rok``, ``roku``, ``w r.``, or before ``r.``."""
    pattern = r"(?:(?<![\p{L}\p{N}_])(?:r\.|roku|rok|w\s+r\.)\s{1,2}((?:19[2-9][0-9]|20[0-9][0-9])(?![0-9]))|(?<![0-9])((?:19[2-9][0-9]|20[0-9][0-9]))\s{1,2}r\.)"
    found = F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda x: F.regexp_extract(x, "([0-9]{4})", 1))


def word_runs(text: Column | str) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(col(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def orthography(text: Column | str) -> tuple[Column, Column]:
    """Words with -cja, -sja, -zja after their first letter, and with the older -cya, -sya, -zya."""
    w = word_runs(text)
    has = lambda glide: matching(w, rf"(?iu)^.+[csz]{glide}[aeięąo]")
    return has("j"), has("y")


# ---- suspicion of tokens


def strip_edges(token: Column) -> Column:
    cut = "[" + "".join("\\" + c if c in "[]-^\\\"" else c for c in config.EDGE_PUNCTUATION) + "]+"
    return F.regexp_replace(token, f"^{cut}|{cut}$", "")


def token_reasons(token: Column, profile: Profile) -> dict[str, Column]:
    """Why a token looks misread: foreign symbols, digits beside letters, a capital after a small
    letter, no vowel. Words of letters alone can't have the first two, others not the last.
    """
    symbols = "[" + "".join("\\" + c if c in "[]-^\\&~|" else c for c in config.NOISE_SYMBOLS) + "]"
    alphabetic = token.rlike(r"^\p{L}+$")
    mixed_case = (F.lower(token) != token) & (F.upper(token) != token)
    return {
        "symbol": ~alphabetic & token.rlike(symbols),
        "digit_mix": ~alphabetic & token.rlike(r"\p{Nd}\p{L}|\p{L}\p{Nd}"),
        "midcaps": mixed_case & token.rlike(r"\p{Ll}.*\p{Lu}"),
        "no_vowel": alphabetic & (F.length(token) >= 4) & ~F.lower(token).rlike(f"[{profile.vowels}]"),
    }


# ---- judgement of lines


def is_page_furniture(line: Column) -> Column:
    s = strip(line)
    return s.rlike(config.PAGE_NUMBER) | ((F.length(s) <= 14) & s.rlike("(?iu)" + config.RUNNING_HEAD))


def is_garbage(line: Column, profile: Profile, w: Column | None = None) -> Column:
    """Short symbols, capitals in pieces, single letters, symbol soup. ``w``: the line's words, if they are known."""
    s = strip(line) if w is None else line
    w = words(s) if w is None else w
    n, size = F.size(w), F.length(s)
    few = letter_share(s) < F.when(size <= 6, 0.5).otherwise(0.45)
    return (size > 0) & ((((size <= 6) | (size >= 8)) & few) | ((n >= 3) & (caps_share(s, profile, w) > 0.5)) | ((n >= 4) & (one_char_share(s, w) > 0.45)))


def is_masthead(line: Column, pattern: str = config.MASTHEAD) -> Column:
    return (F.length(strip(line)) < 65) & line.rlike("(?iu)" + pattern)


def is_digitisation(line: Column, pattern: str = config.DIGITISATION) -> Column:
    return line.rlike("(?iu)" + pattern)


def is_junk(line: Column) -> Column:
    """Watermarks, archive addresses, and lines of numbers without a letter."""
    s = strip(line)
    low = F.array_join(words(F.lower(s)), " ")
    marked = s.rlike("(?i)digitized|archive|google") & (low.contains("digitized by") | low.contains("archive.org") | (low == "google"))
    return (F.length(s) > 0) & (marked | (~s.rlike(r"\p{L}") & s.rlike(r"\p{Nd}")))


def keeps_line(line: Column, profile: Profile, gate: Gate, w: Column | None = None) -> Column:
    w = words(line) if w is None else w
    return ~is_junk(line) & ((F.size(w) < gate.line_min_words) | (clean_word_share(line, profile, w) >= gate.line_min_alpha))


def good_lines(text: Column | str, profile: Profile, gate: Gate) -> Column:
    """The lines that ``keeps_line`` keeps; each line's words are found once."""
    known = F.transform(lines(text), lambda x: F.struct(x.alias("l"), words(x).alias("w")))
    return F.transform(F.filter(known, lambda x: keeps_line(x["l"], profile, gate, x["w"])), lambda x: x["l"])


# ---- cleaners


def unify_newlines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "\r\n?", "\n")


def normalise(text: Column | str, footer: bool = False) -> Column:
    """Newlines unified, three and more made two, a footer after a rule of hyphens cut, one newline at the end."""
    t = unify_newlines(text)
    if footer:
        t = F.regexp_replace(t, r"(?s)\n-{3,}\n.*", "")
    return F.concat(strip(F.regexp_replace(t, "\n{3,}", "\n\n")), F.lit("\n"))


def cut_head(text: Column, mark: str = "google", within: int = 300) -> Column:
    """Without everything up to the last line with ``mark`` among the first lines."""
    ls = lines(text)
    cut = F.array_max(F.transform(F.slice(ls, 1, within), lambda x, i: F.when(F.lower(x).contains(mark), i + 1).otherwise(0)))
    return F.array_join(F.slice(ls, cut + 1, F.greatest(F.size(ls), F.lit(1))), "\n")


def filter_lines(text: Column, keep) -> Column:
    return F.array_join(F.filter(lines(text), keep), "\n")


def unwrap(text: Column) -> Column:
    """Paragraphs on one line each; a hyphen at a line's end joins without a blank."""
    joined = lambda acc, x: F.when(x == "", acc).when(acc == "", x).when(acc.endswith("-"), F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), x)).otherwise(F.concat_ws(" ", acc, x))
    paragraphs = F.transform(F.split(text, "\n\n", -1), lambda p: F.aggregate(F.transform(lines(p), strip), F.lit(""), joined))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def clean_fetched(text: Column | str, profile: Profile, gate: Gate) -> Column:
    """The cleaner of fetched scans, as one expression."""
    t = cut_head(unify_newlines(text))
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    t = unwrap(F.array_join(good_lines(t, profile, gate), "\n"))
    t = filter_lines(t, lambda x: ~is_junk(x))
    return F.concat(strip(F.regexp_replace(t, "[ \t]{2,}", " ")), F.lit("\n"))


def normalise_characters(text: Column | str) -> Column:
    """Newlines unified, copyright signs blanked, control and unassigned characters gone. NFC is ``functions.nfc``."""
    return F.regexp_replace(F.replace(unify_newlines(text), F.lit("©"), F.lit(" ")), r"[\p{C}&&[^\n\t]]", "")


def split_columns(text: Column) -> Column:
    """Left halves, a blank line, right halves where bars part columns; else bars are blanked."""
    ls = lines(text)
    filled = F.size(F.filter(ls, lambda x: F.length(strip(x)) > 0))
    inner = F.size(F.filter(ls, lambda x: strip(x).rlike(r"(?s)^.+\|.+$")))
    left = F.transform(ls, lambda x: F.substring_index(x, "|", 1))
    right = F.transform(F.filter(ls, lambda x: x.contains("|")), lambda x: F.regexp_replace(x, r"^[^|]*\|", ""))
    apart = F.concat(F.array_join(left, "\n"), F.lit("\n\n"), F.array_join(right, "\n"))
    return F.when((filled == 0) | (inner < F.greatest(F.lit(5.0), filled * 0.15)), F.translate(text, "|", " ")).otherwise(apart)


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(\p{L})[-¬]\n[ \t]*(\p{L})", "$1$2")


def reflow(text: Column) -> Column:
    """One line for each paragraph."""
    t = F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n")
    t = F.replace(F.translate(F.regexp_replace(t, r"\n{2,}", "\u0001"), "\n", " "), F.lit("\u0001"), F.lit("\n\n"))
    return strip(F.regexp_replace(t, "[ \t]{2,}", " "))


def clean_layout(text: Column, profile: Profile) -> Column:
    """Columns, furniture lines, hyphens and paragraphs of normalised text, as one expression.

    Each line is stripped and split once; the tests that follow read those fields.
    """
    known = F.transform(F.transform(lines(split_columns(text)), lambda x: F.struct(x.alias("l"), strip(x).alias("s"))), lambda x: F.struct(x["l"].alias("l"), x["s"].alias("s"), words(x["s"]).alias("w")))
    furniture = lambda s: s.rlike(config.PAGE_NUMBER) | ((F.length(s) <= 14) & s.rlike("(?iu)" + config.RUNNING_HEAD))
    masthead = lambda s: (F.length(s) < 65) & s.rlike("(?iu)" + config.MASTHEAD)
    drop = lambda x: (F.length(x["s"]) > 0) & (furniture(x["s"]) | is_garbage(x["s"], profile, x["w"]) | masthead(x["s"]) | is_digitisation(x["s"]))
    kept = F.transform(F.filter(known, lambda x: ~drop(x)), lambda x: F.when(x["s"] == "", "").otherwise(x["l"]))
    return reflow(dehyphenate(F.array_join(kept, "\n")))


def route(cleaned: Column, max_score: float = 0.55, min_len: int = 200) -> Column:
    """clean, short or noise for a cleaned text."""
    return F.when(F.length(cleaned) < min_len, "short").when(noise_score(cleaned) > max_score, "noise").otherwise("clean")


def strip_colophon(text: Column, trusted: Column, pattern: str = config.DIGITISATION) -> Column:
    """Texts of a trusted source lose their digitisation lines; others stay."""
    return F.when(trusted, filter_lines(text, lambda x: ~is_digitisation(x, pattern))).otherwise(text)


def scoring_form(text: Column | str) -> Column:
    return strip(F.regexp_replace(col(text), f"[{BLANK}]+", " "))


def highlight(text: Column | str, pattern: str) -> Column:
    """HTML-escaped text with matches marked."""
    t = col(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return F.regexp_replace(t, f"({pattern})", "<mark>$1</mark>")


def mark_spans(text: Column | str, spans: Column) -> Column:
    """HTML-escaped text with ``<mark>`` around spans (structs of start and stop, from 0): in order, those that
    overlap an earlier one left out. Escaping comes first, so that no mark is escaped.
    """

    def safe(t: Column) -> Column:
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            t = F.replace(t, F.lit(raw), F.lit(entity))
        return t

    t = col(text)
    cut = lambda a, b: safe(F.substring(t, (a + 1).cast("int"), (b - a).cast("int")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def add(acc: Column, s: Column) -> Column:
        a, b = s["start"].cast("long"), s["stop"].cast("long")
        marked = F.concat(acc["out"], cut(acc["at"], a), F.lit("<mark>"), cut(a, b), F.lit("</mark>"))
        return F.when(a >= acc["at"], F.struct(marked.alias("out"), b.alias("at"))).otherwise(acc)

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: F.concat(acc["out"], cut(acc["at"], F.length(t).cast("long"))))


def route_reason(cleaned: Column, max_score: float = 0.55, min_len: int = 200) -> Column:
    """Why ``route`` sends a text where it does, in words; null for a clean one."""
    n, score = F.length(cleaned), noise_score(cleaned)
    return F.when(n < min_len, F.format_string(f"length %d under {min_len}", n)).when(score > max_score, F.format_string(f"noise %.3f over {max_score}", score))


def wrapped(text: str, width: int = 92) -> list[str]:
    """Greedy lines of at most ``width`` visible characters; ANSI escapes take no room, longer words stand alone."""
    out: list[str] = []
    size = 0
    for word in text.split():
        seen = len(re.sub(r"\x1b\[[0-9;]*m", "", word))
        if out and size + 1 + seen <= width:
            out[-1] += f" {word}"
            size += 1 + seen
        else:
            out.append(word)
            size = seen
    return out


def uploader(identifier: Column) -> Column:
    """The library's domain at the head of a dotted identifier, without its accession labels;
    google-books by its ending, else other.
    """
    tlds = F.array(*map(F.lit, config.DOMAINS))
    labels = F.split(identifier, r"\.", -1)
    known = F.transform(labels, lambda x: F.array_contains(tlds, F.lower(x)))
    first = F.array_position(known, True)
    after = F.array_position(F.slice(known, F.greatest(first, F.lit(1)).cast("int"), F.size(known)), False)
    last = F.when(after == 0, F.size(labels).cast("long")).otherwise(first + after - 2)
    domain = F.filter(F.slice(labels, 1, F.greatest(last, F.lit(0)).cast("int")), lambda x: ~x.rlike(r"\p{Nd}"))
    named = F.when(F.size(domain) > 0, F.array_join(domain, ".")).otherwise("other")
    return F.when(first > 0, named).when(identifier.endswith("goog"), "google-books").otherwise("other")


@F.pandas_udf(StringType())
def nfc(texts):
    """Canonical composition; Spark has no built-in for it, so it is an Arrow-batched function."""
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))
