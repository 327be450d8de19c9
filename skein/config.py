"""Settings that are part of the results: language profiles, thresholds, batteries of markers."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    """What a language's clean text looks like."""

    name: str
    letters: str
    diacritics: str
    vowels: str
    stopwords: tuple[str, ...]


# The Polish profile, its 20 stop words and its letters.
POLISH = Profile(
    "pl",
    "ąćęłńóśźż",
    "ąćęłńóśźż",
    "aeiouyąęó",
    ("się", "że", "nie", "jest", "który", "była", "było", "oraz", "przez", "jego", "ich", "tylko", "już", "dla", "tego", "żeby", "aby", "więc", "aż", "lub"),
)
#: for corpora in English and its neighbours: no diacritic is asked for
WESTERN = Profile(
    "western",
    "àâäáçéèêëíîïñóôöúùûüßœæ",
    "àâäáçéèêëíîïñóôöúùûüßœæ",
    "aeiouyàâäáéèêëíîïóôöúùûü",
    ("the", "of", "and", "to", "in", "la", "de", "et", "le", "les", "der", "die", "und", "el", "que", "en", "is", "that", "for", "des"),
)


@dataclass(frozen=True)
class Gate:
    """Thresholds of the acceptance gate and of line judgement."""

    min_alpha: float = 0.60
    min_diacritic: float = 0.04
    min_stopword: float = 0.03
    max_cyrillic: float = 0.005
    line_min_alpha: float = 0.55
    line_min_words: int = 4
    cleaning: str = "v1"


POLISH_GATE = Gate()
WESTERN_GATE = Gate(min_alpha=0.70, min_diacritic=0.0, min_stopword=0.03)

# Noise symbols and edge punctuation of tokens.
NOISE_SYMBOLS = "^~|\\«»°*§¶`_=+<>{}[]@#$%&"
EDGE_PUNCTUATION = ".,;:!?\"'()[]{}—–-…«»„”“‚’·•"

# The stems of the audit batteries (substring match on lower-cased text).
MODERN_STEMS = ("internet", "smartfon", "komputer", "telewiz", "telefon komórk", "digitized by", "www.", "http", "hitler", "gestapo", "nkwd", "kołchoz", "kolchoz", "faszyzm", "faszyst", "międzywojenn", "miedzywojenn", "copyright", "wszelkie prawa zastrze", "mikrofilm")
PERIOD_STEMS = ("telefon", "automobil", "aeroplan", "samochod", "samochód", "samolot", "lotnisk", "czołg", "bolszewi", "sowiet", "radjo", "radiow")
MODERN_PATTERNS = {
    "isbn_number": r"(?:^|[^\p{L}\p{N}_])isbn[\s.:]{0,3}\d[\p{L}\p{N}_'’–-]{4,}",
    "druga_wojna_światowa": r"(?:drugiej|drugą|druga|(?:^|[^\p{L}\p{N}_])ii)\s+wojn[\p{L}\p{N}_]*\s+światow",
    "domena_publiczna": r"domen[\p{L}\p{N}_]*\s+publiczn",
}


@dataclass(frozen=True)
class Battery:
    """Named stems and patterns; ``control`` stems belong to the period and measure false alarms."""

    stems: tuple[str, ...]
    control: tuple[str, ...] = ()
    patterns: dict[str, str] = field(default_factory=dict)


POLISH_BATTERY = Battery(MODERN_STEMS, PERIOD_STEMS, MODERN_PATTERNS)
#: the same audit for the western corpus: rights and web furniture against ordinary words
WESTERN_BATTERY = Battery(("license", "copyright", "rights reserved", "http", "www.", "@", "worthless", "password"), ("the", "tion", "eau"), {"version_number": r"version [0-9]", "ipv4": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"})

# What marks digitisation, page furniture and mastheads in Polish scans.
DIGITISATION = r"https?://|www\.[a-z]|(?:^|[^\p{L}\p{N}_])ISBN(?:[^\p{L}\p{N}_]|$)|creative commons|(?:^|[^\p{L}\p{N}_])CC[ -]?BY|wolne lektury|wolnelektur|archive\.org|internet archive|domen[\p{L}\p{N}_]* +publiczn[\p{L}\p{N}_]*|public domain|wszelkie prawa zastrze|copyright|praw[\p{L}\p{N}_]* +autorski[\p{L}\p{N}_]*|digiti[sz]ed by|zdigitalizowa|biblioteka cyfrowa|fundacja nowoczesna"
MASTHEAD = r"prenumerat|og[łl]oszeni|redakcj|redakcy|administracj|administracy|wychodzi w|r[eę]kopis|nie zwraca|dodatek (tygodniow|do)|ekspedycj|expedycy|adres redak|cena (numeru|egzempl|pojedynczego)|za wiersz|halerz|kopiejek|prenum\.|kalendarzyk|okna dziennika|wsch[óo]d s[łl]o[ńn]|zach[óo]d s[łl]o[ńn]|wsch[óo]d ksi[eę][żz]|godzin[ieę]? +[0-9]+ +minut|^dzi[śs]([^\p{L}\p{N}_]|$)"
RUNNING_HEAD = r"^(Rok|Nr|No|Str|Tom|Cz[eę][sś][cć])([^\p{L}\p{N}_].*)?[0-9]"
PAGE_NUMBER = r"^[^\p{L}\p{N}]*[0-9]{1,4}[^\p{L}\p{N}]*$"
#: licence and rights lines of the western corpus
RIGHTS = r"licen[sc]e|copyright|rights reserved|spdx"

# How catalogue fields are written (places, a title's issue, years of life), and the
# domains that end a library's name in an identifier.
PLACES_APART = r"\s*;\s*"
PLACE_NOTE = r"\(.*?\)"
PLACE_DOUBT = r"[\[\]?]"
COUNTRY_CODE = "^[a-z]{2}$"
UNKNOWN_PLACE = "miejsce nieznane"
ISSUE = r"(?s)(?:\.\s|\s:\s|\s\d{4}|, nr|\[).*"
LIFE = r"(?<!\d)(1[5-9]\d\d)\s*[-–—]\s*(1[6-9]\d\d|20[0-2]\d)(?!\d)"
DOMAINS = ("pl", "gov", "org", "com", "net", "edu", "info", "de", "cz", "uk", "ru")
