"""Problem 9: personal information in free text, found by labelers whose votes a model weighs, and replaced by placeholders.

Every text is scanned for candidate spans of five kinds. Labelers (patterns, word lists, the words around a span) vote on each candidate.
Over the candidates of the whole table, expectation-maximisation estimates how reliable each labeler is and with it how likely each candidate
is what its kind says; a classifier over hashed features of the span and its surroundings is trained on these likelihoods. Every candidate is
then judged by the classifier: those of half a chance or more are found, of overlapping ones the likeliest.

Texts are read twice: for the counts of words that the lexicon is made of, and, with it, for the candidates, which are kept. Votes and
features are all that is fitted on, so equal ones are counted, and the sums over them are exact: a model doesn't depend on how rows are spread.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.durable import durable
from voxmill.llm import logistic

KINDS = ("email", "phone", "id_number", "address", "name")
#: Up to so many documents a word in lower case counts from 10 of them on, and a single one bars it as a companion of a name; in larger tables in proportion.
FEW_DOCS = 12_000
#: Buckets of hashed features; a feature is kept in two bytes.
BUCKETS = 1 << 16
#: Rounds of the classifiers' descent, and different candidates in a task of it, about.
FIT_ROUNDS = 60
FIT_ROWS = 200_000
#: Different words, or candidates, that a task counts before it hands the counts on.
COUNTED = 200_000
#: Characters on either side that are read as the surroundings of a span.
AROUND = 64
#: Characters from a word that may be a name within which the rest of the name is looked for.
NEAR = 64
#: A candidate this likely is found.
LEAST = 0.5
#: Rounds of expectation-maximisation.
ROUNDS = 25
#: What is expected of a labeler before any vote is seen, of true and of false candidates: shares of no vote, votes for and votes against; and the
#: weight of that, as a share of the candidates. It keeps the two classes apart where nearly all candidates are of one.
LEANS = ((0.35, 0.6, 0.05), (0.35, 0.1, 0.55))
FIRMNESS = 0.1
#: Documents judged at a time within a batch.
ROWS = 128

# fixed values: words that introduce or follow a piece, by kind, in en, de, fr, es, pt, ru and uk
CUES = {
    "email": ["mail", "e-mail", "email", "contact", "reach", "reply-to", "write", "send", "file to", "erreichbar", "unter", "datei bitte an", "kontakt", "fichier", "envoyez", "courriel",
              "correo", "archivo", "escriba", "contato", "arquivo", "почта", "почты", "файл", "пишите", "пошта", "надішліть"],
    "phone": ["call", "phone", "tel", "number is", "contact", "ring", "anrufen", "bitte", "nummer ist", "telefon", "appelez", "numéro est", "téléphone", "llame", "número es", "teléfono",
              "ligue", "número é", "telefone", "звоните", "номер", "телефон", "телефонуйте", "дзвоніть"],
    "phone after": ["if the line", "i pick up", "is noted on", "anrufen", "ab sechs", "falls die", "si la ligne", "après", "si se corta", "contesto", "se a linha", "atendo", "если связь", "отвечаю", "якщо", "відповідаю"],
    "id_number": ["passport", "security number", "insurance no", "insurance number", "identity", "id card", "licence", "steuer-id", "ausweisnummer", "personalausweis", "dni", "nie", "documento",
                  "cpf", "rg", "identité", "sécurité sociale", "passeport", "снилс", "паспорт", "инн", "податковий номер", "рнокпп"],
    "id_number after": ["was read out", "twice", "wurde laut", "a été lu", "se leyó", "foi lido", "прозвучал", "пролунав"],
    "not a number": ["tape", "shelf", "box", "ticket", "catalogue", "build", "take", "episode", "row", "seat", "lane", "rms", "peak", "sha1", "runs from", "audio"],
    "address": ["lives at", "moved to", "tapes to", "address", "studio", "post", "wohnt", "jetzt in", "gehen an", "adresse", "maintenant au", "bandes au", "habite", "ahora en", "cintas a",
                "vive en", "fica em", "fitas para", "mora", "адрес", "переехала", "живёт", "адресу", "переїхала", "живе"],
    "name": ["my name is", "by", "thanks to", "then", "name ist", "von", "übernimmt", "dank an", "m'appelle", "par", "ensuite", "merci à", "me llamo", "por", "luego", "gracias a", "meu nome é",
             "depois", "obrigado a", "зовут", "сделал", "подходит", "спасибо", "звати", "зробив", "підходить", "дякуємо"],
    "name after": ["takes over", "for the old tapes", "and i read", "übernimmt", "und ich lese", "et je lis", "prend le micro", "y leo", "toma el", "e leio", "assume o", "я читаю", "за старые", "за старі"],
}
# fixed values: what introduces a full name, in the same languages; the single words only by themselves
_SAID = (
    "my name is", "recorded by", "thanks to", "then", "mein name ist", "aufgenommen von", "danach übernimmt", "je m'appelle", "enregistré par", "ensuite", "me llamo", "grabado por", "luego", "meu nome é", "gravado por", "depois",
    "меня зовут", "запись сделал", "к микрофону подходит", "мене звати", "запис зробив", "до мікрофона підходить",
)
# each with its last word, where that is a word by itself
INTRODUCTIONS = {i: i.rpartition(" ")[2] if " " in i else "" for i in _SAID}
INTRODUCED = re.compile("(?:" + "|".join(i if " " in i else rf"\b{i}" for i in _SAID) + r")\s+")
INTRODUCING = {w for k in ("name", "name after", "phone", "email", "address", "id_number") for c in CUES[k] for w in c.split()}
# fixed values: digits as words, by language
DIGITS = [
    "zero oh one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve", "um dois três quatro seis sete oito nove", "ноль один два три четыре пять шесть семь восемь девять",
    "нуль один два три чотири п'ять шість сім вісім дев'ять", "plus",
]
# fixed values: kinds of streets and what goes with them
BEHIND = r"street|st|road|rd|lane|ln|row|avenue|ave|drive|dr|close|court|ct|way|square|sq|terrace|crescent|boulevard|blvd|hill|gardens"
JOINED = r"str|straße|strasse|weg|platz|gasse|allee"
BEFORE = (
    r"rue|allée|allee|avenue|av|bd|boulevard|place|chemin|impasse|quai|route|cours|calle|c/|avda|avenida|plaza|paseo|camino|carrera|rua|travessa|praça|alameda|largo|estrada"
    r"|ул|улица|пер|переулок|пр|проспект|бульвар|набережная|шоссе|площадь|вул|вулиця|пров|провулок|просп|площа|шосе"
)
FLAT = r"flat|apt|apartment|unit|suite|hinterhaus|wohnung|whg|appt|appartement|bât|piso|apto|apartamento|bloco|кв|квартира|корп|офис|офіс"

SPACING = re.compile(r"[^\S\n]{2,}")
TYPES = re.compile(rf"{BEHIND}|{BEFORE}|{FLAT}|bis|ter|дом|буд|будинок|des|del", re.I)

LETTER = r"[^\W\d_]"
WORD = re.compile(rf"{LETTER}+(?:['’-]{LETTER}+)*")
_S = r"[^\S\n]"
_HOUSE = rf"\d{{1,4}}(?:{_S}?{LETTER}\b)?(?:{_S}+(?:bis|ter)\b)?(?:[-/]\d{{1,4}})?(?!\d)"
_NAMES = rf"{LETTER}[\w'’-]*(?:{_S}+{LETTER}[\w'’-]*){{0,2}}"
_ROOM = rf"(?:,?{_S}*(?:{FLAT})\.?{_S}*\d{{1,4}}{LETTER}?\b)"
_PLACE = rf"(?:,{_S}*(?:\d{{4,6}}(?:-\d{{3}})?,?{_S}+)?(?:(?:г|м|с)\.{_S}*)?(?P<town>{LETTER}[\w'’-]+)(?:,?{_S}+[A-Z]{{2}}\b(?=,?{_S}+\d))?(?:,?{_S}+\d{{4,6}}(?:-\d{{3}})?\b)?)"
_OF = rf"(?:(?:de|du|des|de{_S}+la|do|da|dos|del){_S}+|d['’])"
# one pattern per order of the elements
STREETS = [
    re.compile(rf"(?<!\w)(?:(?:{FLAT})\.?{_S}*\d{{1,4}}{LETTER}?,{_S}*)?{_HOUSE}{_S}+{_NAMES}?{_S}+(?:{BEHIND})\b\.?{_ROOM}?{_PLACE}?", re.I),
    re.compile(rf"(?<!\w)(?:am{_S}+|an{_S}der{_S}+|im{_S}+)?{LETTER}[\w'’-]*?(?:-|{_S})?(?:{JOINED})\b\.?{_S}+{_HOUSE}{_ROOM}?{_PLACE}?", re.I),
    re.compile(rf"(?<!\w){_HOUSE},?{_S}+(?:{BEFORE})\b\.?{_S}+{_OF}?(?P<street>{_NAMES}){_ROOM}?{_PLACE}?", re.I),
    re.compile(
        rf"(?<!\w)(?:\d{{4,6}},{_S}*)?(?:(?:(?:г|м|с)\.{_S}*)?(?P<first>{LETTER}[\w'’-]+),{_S}*)?(?<!\w)(?:{BEFORE})(?:\.|\b|(?<=/)){_S}*{_OF}?{_NAMES},?{_S}*(?:(?:д|дом|буд|будинок|nº|n)\.?{_S}*)?{_HOUSE}{_ROOM}?{_PLACE}?", re.I
    ),
]

_AT = rf"(?:{_S}{{0,4}}@{_S}{{0,4}}|{_S}{{0,4}}[(\[]{_S}?at{_S}?[)\]]{_S}{{0,4}}|{_S}+at{_S}+)"
_DOT = rf"(?:\.|{_S}{{0,4}}[(\[]{_S}?dot{_S}?[)\]]{_S}{{0,4}}|{_S}+dot{_S}+)"
EMAIL = re.compile(rf"(?<![\w.+%-])(?P<local>[\w+%-]+(?:\.[\w+%-]+)*){_AT}(?P<domain>[a-z0-9-]+(?:{_DOT}[a-z][a-z0-9-]*)*)", re.I)
SIGN, AT_SIGN = re.compile("@"), re.compile(r"@|at(?=[^\S\n]|[)\]])")
NUMBER = re.compile(r"(?<![\w.+])(?<!\d[-:/])(?:\+\s?)?(?:\(\d{1,5}\)|\d)(?:(?:[^\S\n]|[.()/-]){0,6}\d){6,15}(?!\d|\w|[.:-]\d)")
_SPOKEN = "|".join(sorted({re.escape(w) for line in DIGITS for w in line.split()}, key=len, reverse=True))
SPOKEN = re.compile(rf"(?<!\w)(?:{_SPOKEN})(?:[\s,-]+(?:{_SPOKEN})){{6,17}}(?!\w)", re.I)
IDENTITY = re.compile(
    rf"(?<![\w.+])(?<!\d[-:/])(?:{LETTER}{{1,2}}[^\S\n]{{0,3}}\d(?:(?:[^\S\n]|[.-]){{0,3}}\d){{4,10}}(?:[^\S\n]{{0,3}}-?{LETTER}\b)?|\d{{2}}{LETTER}{{2}}\d{{5}}|\d(?:(?:[^\S\n]|[.-]){{0,3}}\d){{1,5}}[^\S\n]{{0,3}}№[^\S\n]{{0,3}}\d{{4,8}}|\d(?:(?:[^\S\n]|[.-]){{0,3}}\d){{6,14}}(?:-?{LETTER}\b)?)(?!\d|\w|[.:-]\d)"
)
# what every match of either has in it
DENSE = re.compile(r"\d(?:[\s().№/-]{0,7}\d){4,}")
# days and decimal fractions are no candidates
PLAIN = re.compile(rf"(?:{LETTER}{{1,2}}\s?)?\d{{4}}-\d\d-\d\d|\d\.\d+")
# formats of numbers that are numbers of phones and of papers, as labelers see them
PHONE_SHAPE = re.compile(
    r"\+ ?\d{1,3}.*|00\d{1,2}[ ]?[1-9].*|1[. -]\d{3}[. -]\d{3}[. -]\d{4}|\(?0\d{2,4}\)?[ /.-]\d{3,8}(?:[ -]\d{3,4})?|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[- ]\d{3}[- ]\d{4}|\d{3} \d{3} \d{2} \d{2}|0\d(?:[ .-]?\d{2}){4}|0[1-9]\d{8,9}"
)
PAPER_SHAPE = re.compile(
    rf"(?:\d{{3}}[- ]\d{{2}}[- ]\d{{4}}|{LETTER}{{2}}\s?(?:\d\s?){{6}}{LETTER}?|{LETTER}{{2}}\s?\d{{4}}\s?\d{{3}}{LETTER}?|{LETTER}\d{{7,8}}(?:-?{LETTER})?|\d{{2}}\s?\d{{3}}\s?\d{{3}}\s?\d{{3}}|\d{{2}}\.?\d{{3}}\.?\d{{3}}-?{LETTER}"
    rf"|\d(?:\s?\d{{2}}){{3}}\s?\d{{3}}\s?\d{{3}}(?:\s?\d{{2}})?|\d{{2}}{LETTER}{{2}}\d{{5}}|\d{{3}}[.-]\d{{3}}[.-]\d{{3}}[- ]\d{{2}}|\d{{3}} \d{{3}} \d{{3}} \d{{2}}|\d{{2}}\s\d{{2}}\s\d{{6}}|\d{{4}}\s?№\s?\d{{6}}|\d{{10,13}})"
)

OTHER_NUMBERS = {"tape", "ticket", "catalogue", "shelf", "box", "build", "take", "episode", "row", "seat", "lane", "sha1"}
# words that a text must have for a pattern to be looked for
SPOKEN_WORDS = {w for line in DIGITS for w in line.split()}
WORDS_BEHIND, WORDS_BEFORE = set(BEHIND.split("|")), set(BEFORE.replace("c/", "c").split("|"))
STREET_ENDS = tuple(JOINED.split("|"))

Span = tuple[str, int, int, tuple[int, ...], tuple[int, ...]]  # kind, start, end, votes, hashed features


def value_of(piece: str) -> str:
    """A piece as it is reported: lower-cased, letters and digits only."""
    return "".join(c for c in piece.lower() if unicodedata.category(c)[0] in "LN")


def composed(text: str) -> tuple[str, list[int] | None]:
    """The text with composed letters, and where each of its characters starts in the original (None where nothing changes)."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return text, None
    out, at = [], []
    for m in re.finditer(r"[^̀-ͯ][̀-ͯ]*|[̀-ͯ]+", text, re.S):
        c = unicodedata.normalize("NFC", m.group())
        out.append(c)
        at += [m.start()] * len(c)
    return "".join(out), [*at, len(text)]


@dataclass
class Lexicon:
    """Words learnt from the sample, lower-cased: given names and surnames, towns, words that are often written in lower case, and words too common to be names."""

    given: dict[str, int] = field(default_factory=dict)
    surname: dict[str, int] = field(default_factory=dict)
    towns: set[str] = field(default_factory=set)
    plain: set[str] = field(default_factory=set)
    common: set[str] = field(default_factory=set)


def lowered(text: str) -> str:
    """The text in lower case, of the same length (a few letters change theirs and stay)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def dense(text: str) -> list[tuple[int, int]]:
    """The stretches outside of which there is no match of NUMBER or IDENTITY, with room for what comes before the digits and what must not follow."""
    out: list[tuple[int, int]] = []
    for m in DENSE.finditer(text):
        a, b = max(0, m.start() - 6), m.end() + 12
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def lines(low: str, words: Iterable[str], ends: bool = False) -> list[tuple[int, int]]:
    """Where the lines are that have a digit and one of the words, with no letter or digit beside it; ``ends``: or as the end of a word before a space or a point."""
    out = set()
    for w in words:
        i = low.find(w)
        while i >= 0:
            at = i + len(w)
            after = low[at : at + 1]
            if after == "." or after.isspace() if ends else not (after.isalnum() or after == "_" or i and (low[i - 1].isalnum() or low[i - 1] == "_")):
                at = low.find("\n", i)
                at = len(low) if at < 0 else at
                out.add((low.rfind("\n", 0, i) + 1, at))
            i = low.find(w, at)
    return sorted(line for line in out if DIGIT.search(low, *line))


def streets(text: str, low: str, words: set[str]) -> Iterator[tuple[int, re.Match[str]]]:
    """Matches of the patterns of STREETS, with their numbers; none goes beyond its line, and only lines are looked at that have the words for it."""
    parts = {p for w in words if not w.isalpha() for p in re.split("['’-]", w)}
    before = lines(low, words & WORDS_BEFORE | parts & WORDS_BEFORE)
    for order, (pattern, own) in enumerate(zip(STREETS, (lines(low, words & WORDS_BEHIND | parts & WORDS_BEHIND), lines(low, STREET_ENDS, True), before, before))):
        for line in own:
            for m in pattern.finditer(text, *line):
                yield order, m


SEEN, SMALL, GIVEN, SURNAME, TOWN, PAIR, DOCS = range(7)
# every letter in upper case, for which regular expressions have no name
_UPPER = "[" + "".join(chr(c) for c in range(0x20000) if chr(c).isupper() and chr(c).isalpha()) + "]"
FULL = re.compile(rf"({LETTER}+),?\s+(?:{LETTER}\.\s*)?({LETTER}+(?:-{LETTER}+)?)")
HEAD = re.compile(rf"(?:{LETTER}\.)?({_UPPER}{LETTER}*(?:-{LETTER}+)?)")
TAIL = re.compile(rf"(?<!{LETTER})({_UPPER}{LETTER}*)(,?)$")
INITIAL = re.compile(rf"{LETTER}\.")
DIGIT = re.compile(r"\d")


@dataclass
class Token:
    """What stands between spaces: its words in lower case, those that are so written, and the words in capitals that it begins and ends with."""

    words: list[str]
    small: list[str]
    head: str | None
    tail: str | None
    comma: bool
    initial: bool


NOTHING = Token([], [], None, None, False, False)


class Tokens:
    """The tokens of texts; they are kept, since most come again."""

    def __init__(self) -> None:
        self.kept: dict[str, Token] = {}
        #: Those that are one word in lower case.
        self.bare: set[str] = set()

    def of(self, text: str) -> Token:
        if (token := self.kept.get(text)) is None:
            low = lowered(text)
            words = WORD.findall(low)
            if not words:
                if len(text) < 4:
                    self.kept[text] = NOTHING
                return NOTHING
            head, tail = (HEAD.match(text), TAIL.search(text)) if text != low else (None, None)
            small = words if text == low else WORD.findall(text)
            token = Token(words, [w for w in small if w.islower()], head and head[1].lower(), tail and tail[1].lower(), bool(tail and tail[2]), bool(INITIAL.fullmatch(text)))
            if len(self.kept) < 100_000 and len(text) < 100:
                self.kept[text] = token
                if token.words == token.small == [text]:
                    self.bare.add(text)
        return token

    def split(self, tokens: set[str]) -> tuple[set[str], dict[str, Token]]:
        """Which are one word in lower case, as far as they are kept, and what the others are."""
        get = self.kept.get
        bare = tokens & self.bare
        return bare, {t: get(t) or self.of(t) for t in tokens - bare}

    def words(self, text: str) -> set[str]:
        bare, others = self.split(set(text.split()))
        return bare.union(*[t.words for t in others.values()])


def count_words(text: str, tokens: Tokens, counts: list[Counter[str]]) -> None:
    """Adds what a text says about words: that they stand in it, also in lower case, names from introductions, towns from addresses, pairs of words in capitals."""
    low = lowered(text)
    line = text.split()
    bare, others = tokens.split(set(line))
    own = bare.union(*[t.words for t in others.values()])
    counts[DOCS][""] += 1
    counts[SEEN].update(own)
    if not text.islower():
        counts[SMALL].update(bare.union(*[t.small for t in others.values()]))
    ends = {t for t, token in others.items() if token.tail}
    for i in [i for i, t in enumerate(line[:-1], 1) if t in ends] if ends else []:
        token, after = others[line[i - 1]], tokens.of(line[i])
        # an initial may stand between the two
        if after.initial and i + 1 < len(line):
            after = tokens.of(line[i + 1])
        if after.head:
            counts[PAIR][f"{after.head} {token.tail}" if token.comma else f"{token.tail} {after.head}"] += 1
    for i, last in INTRODUCTIONS.items():
        at = low.find(i) if not last or last in own else -1
        while at >= 0:
            if (m := INTRODUCED.match(low, at)) and (p := FULL.match(text, m.end())) and p[1][0].isupper() and p[2][0].isupper():
                a, b = (p[2], p[1]) if "," in p[0] else (p[1], p[2])
                counts[GIVEN][a.lower()] += 1
                counts[SURNAME].update(b.lower().split("-"))
            at = low.find(i, at + len(i))
    for _, m in streets(text, low, own):
        for g in ("town", "first"):
            if (town := m.groupdict().get(g)) and town[0].isupper() and town[1:].islower():
                counts[TOWN][town.lower()] += 1


def first_names(given: dict[str, int], surname: dict[str, int], common: set[str]) -> tuple[dict[str, int], dict[str, int]]:
    """Given names and surnames from how often words stand as the one and as the other in introductions."""
    name = lambda own, other: {w: n for w, n in own.items() if n > other.get(w, 0) and w not in common and len(w) > 2}
    return name(given, surname), name(surname, given)


def companions(pair: str, n: int, words: Lexicon) -> Iterator[tuple[int, str, int]]:
    """What a pair, given name before surname, says about a word beside one that is known."""
    a, b = pair.split(" ")
    if a in words.given and b not in words.common:
        yield from ((SURNAME, w, n) for w in b.split("-") if w not in words.given and len(w) > 2)
    if b.split("-")[0] in words.surname and a not in words.common and a not in words.surname and len(a) > 2:
        yield GIVEN, a, n


_CUE = {k: re.compile("(?<!\\w)(?:" + "|".join(re.escape(c) for c in v) + ")(?!\\w)") for k, v in CUES.items()}


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else 2 if no else 0


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) % BUCKETS


def _mask(piece: str) -> str:
    return re.sub(rf"{LETTER}", "a", re.sub(r"\d", "0", re.sub(r"\s+", " ", piece)))


def _addressable(m: re.Match[str]) -> bool:
    """Whether the local part has a letter and the domain a point; a bare word for the sign needs the word for the point too."""
    spelled = re.search(r"dot", m["domain"], re.I)
    return bool(re.search(LETTER, m["local"]) and (spelled or ("." in m["domain"] and re.search(r"[@(\[]", m[0]))))


class Finder:
    """Candidate spans of a text, with the labelers' votes and the classifier's features."""

    def __init__(self, words: Lexicon):
        self.words = words
        self.tokens = Tokens()
        self.seen: dict[str, tuple[bool, bool]] = {}
        self.dull: set[str] = set()
        #: Whether the text at hand is all in lower or all in upper case.
        self.all_low = self.all_high = False
        # beginnings and ends that several names of a table share
        self.ends = [(self._shared(w[:3] for w in t), self._shared(w[-3:] for w in t)) for t in (words.given, words.surname)]

    @staticmethod
    def _shared(parts: Iterator[str]) -> set[str]:
        return {p for p, n in Counter(parts).items() if n >= 2}

    def alike(self, word: str, which: int) -> bool:
        """Whether a word begins and ends as given names (0) or surnames (1) do."""
        begins, ends = self.ends[which]
        return word[:3] in begins and word[-3:] in ends

    def kinds_of(self, word: str) -> tuple[bool, bool]:
        """Whether a word, or a part of it, is a given name and a surname: by the lexicon or by its beginning and end."""
        if (known := self.seen.get(word)) is None:
            parts = [] if word in INTRODUCING else word.split("-")
            kind = lambda i, t: word in t and bool(parts) or any(p in t or self.alike(p, i) for p in parts if len(p) > 4 and p not in self.words.common)
            known = kind(0, self.words.given), kind(1, self.words.surname)
            if len(self.seen) < 200_000:
                self.seen[word] = known
        return known

    def spans(self, text: str) -> list[Span]:
        """Every candidate of every kind."""
        low = lowered(text)
        own = self.tokens.words(low)
        self.all_low, self.all_high = text.islower(), text.isupper()
        out: list[Span] = []
        if "@" in text or "dot" in own or "(at" in low or "[at" in low:
            out += [self._email(text, low, *m.span()) for m in self._addressed(text, low)]
        # what a word for another kind of number introduces is no candidate
        other = lambda a: low[max(0, a - 12) : a].rpartition("\n")[2].strip(" =#").rpartition(" ")[2] in OTHER_NUMBERS
        near = dense(text)
        numbers, papers = ({m.span() for a, b in near for m in pattern.finditer(text, a, b) if not PLAIN.fullmatch(m[0]) and not other(m.start())} for pattern in (NUMBER, IDENTITY))
        for a, b in sorted(numbers):
            if text[a] == "(" and (inner := text[a:b]).count("(") > inner.count(")"):
                a += 1
            out.append(self._number("phone", text, low, a, b))
        if (spoken := own & SPOKEN_WORDS) and sum(map(low.count, spoken)) > 6 and sum(map(SPOKEN_WORDS.__contains__, WORD.findall(low))) > 6:
            for m in SPOKEN.finditer(text):
                out.append(self._number("phone", text, low, *m.span()))
        # a word in lower case before it is no part of it, unless all is in lower case
        for a, b in list(papers):
            if (k := re.match(rf"({LETTER}{{1,2}})\s+", text[a:b])) and (k[1].islower() or text[a - 1 : a] == "-"):
                if sum(map(str.isdigit, text[a:b])) > 6:
                    papers.add((a + k.end(), b))
                if not self.all_low:
                    papers.discard((a, b))
        for a, b in sorted(papers):
            out.append(self._number("id_number", text, low, a, b))
        out += self._addresses(text, low, own)
        if not own <= self.dull and (rare := [w for w in own - self.dull if not self.boring(w)]):
            for a, b in self._near(text, low, rare):
                out += self._names(text, low, a, b)
        return out

    @staticmethod
    def _addressed(text: str, low: str) -> Iterator[re.Match[str]]:
        """Matches of EMAIL that can be one: each begins where the characters begin that stand before a sign. What can't be one takes nothing from what follows ("at a@b.org")."""
        end = 0
        for sign in (AT_SIGN if "dot" in low or "(" in low or "[" in low else SIGN).finditer(low):
            # spaces and a bracket may stand between
            if (a := sign.start()) < end:
                continue
            while a > end and (text[a - 1].isspace() or text[a - 1] in "(["):
                a -= 1
            while a > end and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
                a -= 1
            if (m := EMAIL.match(text, a)) and _addressable(m):
                end = m.end()
                yield m

    def _near(self, text: str, low: str, words: list[str]) -> list[tuple[int, int]]:
        """The stretches within NEAR characters of the words that are known as names or begin with a capital, merged, whose ends cut no word."""
        at = []
        for w in words:
            known = any(self.kinds_of(w))
            i = low.find(w)
            while i >= 0:
                if known or text[i].isupper():
                    at.append((i - NEAR, i + len(w) + NEAR))
                i = low.find(w, i + len(w))
        out: list[tuple[int, int]] = []
        for a, b in sorted(at):
            a, b = max(0, a), min(len(low), b)
            while 0 < a and low[a - 1].isalpha():
                a -= 1
            while b < len(low) and low[b].isalpha():
                b += 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def boring(self, word: str) -> bool:
        """Whether a word can't be part of a name."""
        if word in self.dull:
            return True
        if len(word) > 2 and (word not in self.words.common and word not in INTRODUCING or any(self.kinds_of(word))):
            return False
        if len(self.dull) < 200_000:
            self.dull.add(word)
        return True

    @staticmethod
    def _around(low: str, a: int, b: int) -> tuple[str, str]:
        left, right = low[max(0, a - AROUND) : a], low[b : b + AROUND]
        left, right = left[left.rfind("\n") + 1 :], right.split("\n", 1)[0]
        return (SPACING.sub(" ", left), SPACING.sub(" ", right)) if "  " in left or "  " in right else (left, right)

    def _features(self, kind: str, votes: tuple[int, ...], left: str, right: str, own: list[str]) -> tuple[int, ...]:
        l, r = WORD.findall(left)[-3:], WORD.findall(right)[:2]  # noqa: E741
        near = [f"l1 {l[-1] if l else ''}", f"l2 {' '.join(l[-2:])}", f"l3 {' '.join(l)}", f"r1 {r[0] if r else ''}", f"r2 {' '.join(r)}", f"lc {left.rstrip()[-1:]}", f"rc {right.lstrip()[:1]}"]
        return tuple(_hash(f"{kind} {x}") for x in ["", *near, *own, *(f"v{i} {v}" for i, v in enumerate(votes))])

    def _email(self, text: str, low: str, a: int, b: int) -> Span:
        piece = low[a:b]
        left, right = self._around(low, a, b)
        local, domain = re.split(_AT, piece, maxsplit=1)
        dotted = re.split(_DOT, domain)
        whole = len(dotted) > 1 and dotted[-1].isalpha() and len(dotted[-1]) > 1
        votes = (
            _vote(bool(re.fullmatch(r"[\w.+%-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}", piece)), not whole),
            _vote("@" not in piece and whole, "@" not in piece and not whole),
            _vote(bool(_CUE["email"].search(left)) or bool(re.search(r"[|:]\s*$", left))),
            _vote(any(w in self.words.surname or w in self.words.given for w in re.split(r"[^a-zа-яё]+", local)), local in self.words.common),
        )
        return "email", a, b, votes, self._features("email", votes, left, right, [f"d {dotted[-1]}", f"n {len(dotted)}", f"at {'@' in piece}", f"w {whole}"])

    def _number(self, kind: str, text: str, low: str, a: int, b: int) -> Span:
        piece = text[a:b]
        left, right = self._around(low, a, b)
        spoken = not any(c.isdigit() for c in piece)
        other = "id_number" if kind == "phone" else "phone"
        even = re.sub(r"\s+", " ", piece)
        own, rivals = (PHONE_SHAPE, PAPER_SHAPE) if kind == "phone" else (PAPER_SHAPE, PHONE_SHAPE)
        fits, fits_other = bool(spoken or own.fullmatch(even)), bool(not spoken and rivals.fullmatch(even))
        close = left[-30:]
        strong, rival, barred = (bool(_CUE[k].search(close)) for k in (kind, other, "not a number"))
        after, after_rival = bool(_CUE[f"{kind} after"].search(right[:24])), bool(_CUE[f"{other} after"].search(right[:24]))
        lined = bool(re.search(rf"{LETTER}+\s*[|:]\s*$", left)) and not barred
        digits = re.sub(r"\D", "", piece)
        votes = (
            # what could be either is a phone unless something says that it is a paper's number
            _vote(fits and (not fits_other or kind == "phone" and bool(re.match(r"0[1-9]", digits))), not fits or (kind == "id_number" and fits_other and not strong and not after)),
            _vote(strong and not (rival and not after), (rival and not strong) or barred),
            _vote(after, after_rival),
            _vote(kind == "phone" and (piece.lstrip("(").startswith("+") or lined), kind == "id_number" and (piece.startswith("+") or (lined and not strong))),
            _vote(False, barred or bool(re.search(r"\d[.:/-]$|[#=]\s*$", left)) or not spoken and (len(set(digits)) < 2 or kind == "phone" and len(digits) < 9)),
        )
        return kind, a, b, votes, self._features(kind, votes, left, right, [f"m {_mask(piece) if not spoken else 'spoken'}", f"n {len(digits)}", f"p {piece[:2].lower()}"])

    def _addresses(self, text: str, low: str, words: set[str]) -> list[Span]:
        out = []
        for order, m in streets(text, low, words):
            a, b = m.span()
            got = m.groupdict()
            if town := got.get("town"):
                at = m.start("town")
                if not self._is_town(text, town, at):
                    # what follows the comma is no town: the address ends before it
                    b = text.rfind(",", a, at)
                    b = b if b > 0 else at
                    if re.search(r"\d{4,6}(?:-\d{3})?,?\s*$", text[a:at]) and text[a:at].rstrip(", ").endswith(tuple("0123456789")):
                        b = a + len(text[a:at].rstrip(", "))
                    town = None
            if (street := got.get("street")) and m.end() == m.end("street") and (short := self._street(street)) != street:
                # the words that follow belong to the next sentence
                b, town = m.start("street") + len(short), None
            if (first := got.get("first")) and not self._is_town(text, first, m.start("first")):
                if not re.search(r"(?:г|м|с)\.\s*$", text[a : m.start("first")], re.I):
                    a = m.end("first") + re.match(r",\s*", text[m.end("first") :]).end()
                    first = None
            a, b = self._trim(text, a, b, order)
            if b <= a:
                continue
            piece = low[a:b]
            left, right = self._around(low, a, b)
            ends = not re.match(r"\w|[-/]\d|,? \d{4}", text[b : b + 6])
            names = [w for w in WORD.findall(text[a:b]) if len(w) > 2 and not TYPES.fullmatch(w)]
            # the words of the name are written with capitals where the text isn't all of one case
            proper = self.all_low or piece.isupper() or text[a:b].isupper() or sum(w[0].isupper() for w in names) * 2 >= len(names)
            votes = (
                _vote(ends and proper, not ends or not proper),
                _vote(bool(town or first)),
                _vote(bool(re.search(rf"(?:{FLAT})\.?\s*\d|\d{{5}}", piece))),
                _vote(bool(_CUE["address"].search(left)), bool(re.search(r"(?:episode|shelf|take|tape)\W+[\w\s]*$", left))),
                _vote(not any(w.lower() in self.words.plain for w in names if w.islower() or self.all_high), len(names) > 9),
            )
            out.append(("address", a, b, votes, self._features("address", votes, left, right, [f"o {order}", f"t {bool(town or first)}", f"w {len(WORD.findall(piece))}", f"f {piece.split()[0] if not piece[0].isdigit() else '0'}"])))
        return out

    def _is_town(self, text: str, word: str, at: int) -> bool:
        low = word.lower()
        if low in self.words.towns:
            return True
        if re.search(r"(?:\d|г\.|м\.)\s+$", text[max(0, at - 4) : at]) and low not in self.words.plain and not self.all_low:
            return True
        return word[0].isupper() and not word.isupper() and low not in self.words.plain

    def _street(self, words: str) -> str:
        """The name of a street of which the end is open: its first word, and others that are no common words and are written alike."""
        found = list(re.finditer(r"\S+", words))
        end = found[0].end()
        for m in found[1:]:
            w = m.group()
            if w.lower() in self.words.plain or w[0].isupper() != found[0].group()[0].isupper():
                break
            end = m.end()
        return words[:end]

    def _trim(self, text: str, a: int, b: int, order: int) -> tuple[int, int]:
        """Without the words before the street's name that are common words in lower case, and without trailing marks."""
        if order == 1:
            m = re.match(rf"({LETTER}[\w'’-]*\s)(?!{JOINED})", text[a:b], re.I)
            while m and m[1].lower().strip() not in ("am", "an", "im", "der") and re.search(rf"{JOINED}", text[a + m.end() : b], re.I):
                a += m.end()
                m = re.match(rf"({LETTER}[\w'’-]*\s)(?!{JOINED})", text[a:b], re.I)
        while b > a and (text[b - 1] in " ,;\n\t" or re.search(rf"{LETTER}{{4,}}\.$", text[a:b])):
            b -= 1
        return a, b

    def _names(self, text: str, low: str, begin: int, end: int) -> list[Span]:
        given, surname, common = self.words.given, self.words.surname, self.words.common
        tokens = [m.span() for m in WORD.finditer(text, begin, end)]
        out: list[Span] = []
        n = len(tokens)

        def sure(i: int, table: dict[str, int]) -> bool:
            return self.kinds_of(low[slice(*tokens[i])])[table is surname]

        def plausible(i: int) -> bool:
            a, b = tokens[i]
            return b - a > 2 and text[a].isupper() and not text[a + 1].isupper() and low[a:b] not in common and low[a:b] not in INTRODUCING

        def initial(i: int) -> bool:
            a, b = tokens[i]
            return b - a == 1 and text[b : b + 1] == "."

        def gap(i: int, j: int) -> str:
            return text[tokens[i][1] : tokens[j][0]]

        dull = [low[a:b] in self.dull or self.boring(low[a:b]) for a, b in tokens]
        for i in range(n - 1):
            j = i + 1
            # of two words in a row neither can be dull, except for an initial before or after the first
            if (dull[i] or dull[j]) and not (initial(i) and not dull[j]) and not (not dull[i] and initial(j)):
                continue
            if initial(i):
                # initial and surname
                if re.fullmatch(r"\.\s{0,4}", gap(i, j)) and (sure(j, surname) or plausible(j)) and not (i and (sure(i - 1, given)) and re.fullmatch(r"\s{1,4}", gap(i - 1, i))):
                    out.append(self._name(text, low, tokens[i][0], tokens[j][1], None, j, tokens, "initial", sure(j, surname), sure(j, surname)))
                continue
            known_i, known_j = sure(i, given) or sure(i, surname), sure(j, given) or sure(j, surname)
            likely_i = known_i or plausible(i)
            if not likely_i:
                continue
            if initial(j) and j + 1 < n and re.fullmatch(r"\s{1,4}", gap(i, j)) and re.fullmatch(r"\.\s{0,4}", gap(j, j + 1)):
                known_k = sure(j + 1, surname)
                if (known_k or plausible(j + 1)) and (known_i or known_k):
                    out.append(self._name(text, low, tokens[i][0], tokens[j + 1][1], i, j + 1, tokens, "middle", sure(i, given), known_k))
                continue
            between = gap(i, j)
            if not (known_j or plausible(j)):
                continue
            if re.fullmatch(r"\s{1,4}", between) and "\n" not in between and (known_i and known_j or text[tokens[i][0]].isupper() and text[tokens[j][0]].isupper() and not text[tokens[i][0] : tokens[j][1]].isupper()):
                out.append(self._name(text, low, tokens[i][0], tokens[j][1], i, j, tokens, "plain" if not (sure(i, surname) and sure(j, given)) else "turned", sure(i, given) or sure(j, given), sure(j, surname) or sure(i, surname)))
            elif re.fullmatch(r",\s{1,4}", between) and "\n" not in between and sure(i, surname) and (sure(j, given) or (plausible(j) and not sure(j, surname))):
                out.append(self._name(text, low, tokens[i][0], tokens[j][1], j, i, tokens, "comma", sure(j, given), True))
        return out

    def _name(self, text: str, low: str, a: int, b: int, g: int | None, s: int, tokens: list[tuple[int, int]], shape: str, is_given: bool, is_surname: bool) -> Span:
        left, right = self._around(low, a, b)
        sur = low[slice(*tokens[s])]
        giv = low[slice(*tokens[g])] if g is not None else ""
        start = bool(re.search(r"(?:^|[.!?:>\]…]\s*|\d\d:\d\d \w+ |- )$", left))
        cased = all(text[x].isupper() and text[x + 1 : y].islower() or "-" in text[x:y] for x, y in ([tokens[g]] if g is not None else []) + [tokens[s]])
        rare = sur not in self.words.common and giv not in self.words.common
        votes = (
            _vote(is_given or shape == "initial" and is_surname, not is_given and shape != "initial"),
            _vote(is_surname, not is_surname),
            _vote(bool(_CUE["name"].search(left[-16:])) or bool(_CUE["name after"].search(right[:20])), bool(re.search(r"(?<!\w)(?:the|der|die|das|le|la|el|o|a|rd|street)\s$", left))),
            _vote(start and bool(re.match(r"\s*(?:[|:]|$)", right)), not rare),
            _vote(cased and rare and (is_given or is_surname), text[a:b].istitle() and not (is_given or is_surname)),
        )
        own = [f"s {shape}", f"g {is_given}", f"u {is_surname}", f"gu {is_given} {is_surname}", f"b {start}", *(f"gp {giv[:k]}" for k in (2, 4) if giv), *(f"gs {giv[-k:]}" for k in (3, 5) if giv), f"sp {sur[:4]}", f"ss {sur[-3:]}", f"ss {sur[-5:]}"]
        return "name", a, b, votes, self._features("name", votes, left, right, own)


def reliabilities(votes: np.ndarray, rounds: int = ROUNDS, times: np.ndarray | None = None) -> np.ndarray:
    """Likelihood of each candidate, by expectation-maximisation over labelers whose votes (0 none, 1 for, 2 against; one column each) depend only on whether it is true.

    ``times``: how many candidates each row stands for, else one.
    """
    k = votes.shape[1]
    if not len(votes):
        return np.zeros(0)
    times = np.ones(len(votes)) if times is None else times
    n = times.sum()
    firm = 4 + FIRMNESS * n
    agree, against = (votes == 1).sum(1), (votes == 2).sum(1)
    p = np.clip((agree + 0.5) / (agree + against + 1.0), 0.05, 0.95)
    for _ in range(rounds):
        true, false = p * times, (1 - p) * times
        prior = np.clip(true.sum() / n, 0.01, 0.99)
        yes, no = np.full(len(votes), np.log(prior)), np.full(len(votes), np.log(1 - prior))
        for j in range(k):
            for v in range(3):
                at = votes[:, j] == v
                yes[at] += np.log((true[at].sum() + firm * LEANS[0][v]) / (true.sum() + firm))
                no[at] += np.log((false[at].sum() + firm * LEANS[1][v]) / (false.sum() + firm))
        top = np.maximum(yes, no)
        p = np.exp(yes - top) / (np.exp(yes - top) + np.exp(no - top))
    return p


Judged = tuple[str, int, int, float]  # kind, start, end, probability


@dataclass
class Model:
    """The lexicon and one classifier per kind."""

    words: Lexicon
    classifiers: dict[str, logistic.Logistic]

    def __post_init__(self) -> None:
        self.finder = Finder(self.words)

    def chosen(self, spans: Iterator[tuple[str, int, int, np.ndarray]]) -> list[Judged]:
        """The pieces among the candidates of a text, each with its features, in their order; of overlapping ones the likeliest, of equals the longest."""
        judged = []
        for kind, a, b, features in spans:
            if model := self.classifiers.get(kind):
                p = float(model.score(model.weights[features].sum()))
                if p >= LEAST:
                    judged.append((round(p, 2), b - a, kind, a, b, p))
        # an address or an e-mail address holds what looks like a name or number inside it
        rank = {"email": 0, "address": 1}
        judged.sort(key=lambda x: (rank.get(x[2], 2), 0.0 if x[2] == "address" else -x[0], -x[1], x[3]))
        starts: list[int] = []
        ends: list[int] = []
        out = []
        for _, _, kind, a, b, p in judged:
            i = bisect_left(starts, a)
            # what is taken doesn't overlap, so only the neighbours can be in the way
            if (i and ends[i - 1] > a) or (i < len(starts) and starts[i] < b):
                continue
            starts.insert(i, a)
            ends.insert(i, b)
            out.append((kind, a, b, p))
        return sorted(out, key=lambda x: x[1])

    def found(self, text: str | None) -> list[Judged]:
        """``kind, start, end, probability`` of the pieces in a text."""
        if not text:
            return []
        whole, at = composed(text)
        out = self.chosen((kind, a, b, np.array(features)) for kind, a, b, _, features in self.finder.spans(whole))
        return [(kind, at[a], at[b], p) for kind, a, b, p in out] if at else out


_COUNTS = "what tinyint, word string, n bigint"
_EXAMPLES = "kind tinyint, votes smallint, features binary, n bigint"
_SCANNED = "doc_id bigint, text string, kinds binary, votes binary, places binary, lengths binary, features binary, values array<string>"


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    types = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    fields = [f.split(" ") for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    counts: list[Counter[str]] = [Counter() for _ in range(7)]
    for batch in chain(_pieces_of(batches), [None]):
        for t in batch.column(0).to_pylist() if batch else []:
            if t:
                count_words(composed(t)[0], tokens, counts)
        if not batch or sum(map(len, counts)) > COUNTED:
            yield _rows([(what, w, n) for what, own in enumerate(counts) for w, n in own.items()], _COUNTS)
            counts = [Counter() for _ in range(7)]


def _beside(batches: Iterator[pa.RecordBatch], words: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _rows([x for pair, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in companions(pair, n, words)], _COUNTS)


def lexicon(texts: DataFrame) -> Lexicon:
    """The lexicon of all texts: names from introductions and, in a second round, from their companions; towns from addresses; common words by their documents."""
    sums = lambda rows: rows.groupBy("what", "word").agg(F.sum("n").alias("n"))
    counts = durable(sums(texts.select("text").mapInArrow(_counted, _COUNTS)))
    small = counts.where(F.col("what") == SMALL).select("word", F.col("n").alias("small"))
    of = lambda what, least=1: {r.word: r.n for r in counts.where((F.col("what") == what) & (F.col("n") >= least)).collect()}
    docs = of(DOCS).get("", 0)
    more_docs = max(1.0, docs / FEW_DOCS)

    def rarely_small(rows: DataFrame, least: float) -> DataFrame:
        """Words with at least two, in lower case in fewer documents than that."""
        return rows.where(F.col("n") >= 2).join(small.where(F.col("small") >= least), "word", "left_anti")

    # words that stand in this many documents are words of the language
    common = set(of(SEEN, max(20, docs // 60)))
    words = Lexicon(*first_names(of(GIVEN), of(SURNAME), common), common=common)
    words.plain = set(of(SMALL, 10 * more_docs))
    words.towns = {r.word for r in rarely_small(counts.where(F.col("what") == TOWN), 10 * more_docs).collect()}
    pairs = counts.where(F.col("what") == PAIR).select("word", "n")
    more = rarely_small(sums(pairs.mapInArrow(partial(_beside, words=words), _COUNTS)), more_docs).collect()
    given, surname = dict(words.given), dict(words.surname)
    for r in sorted(more):
        own, other = (given, surname) if r.what == GIVEN else (surname, given)
        if r.word not in other:
            own[r.word] = own.get(r.word, 0) + r.n
    words.given, words.surname = given, surname
    return words


def _code(votes: tuple[int, ...]) -> int:
    return sum(v * 3**i for i, v in enumerate(votes))


#: Labelers of each kind; their votes are kept as one number to the base of 3.
LABELERS = {k: 4 if k == "email" else 5 for k in KINDS}


def _scan(batches: Iterator[pa.RecordBatch], words: Lexicon, texts: bool) -> Iterator[pa.RecordBatch]:
    """The candidates of each text, in one row: with the text, or with the value of each."""
    finder = Finder(words)
    for batch in _pieces_of(batches):
        out = []
        for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            whole, at = composed(t) if t else ("", None)
            spans = finder.spans(whole) if whole else []
            if spans or texts:
                out.append((
                    doc, t if texts else None, bytes(KINDS.index(s[0]) for s in spans), bytes(_code(s[3]) for s in spans), np.array([s[1:3] for s in spans], np.int64).tobytes(), bytes(len(s[4]) for s in spans),
                    np.array([f for s in spans for f in s[4]], np.uint16).tobytes(), [] if texts else [value_of(t[at[s[1]] : at[s[2]]] if at else t[s[1] : s[2]]) for s in spans],
                ))
        yield _rows(out, _SCANNED)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[int, int, bytes]] = Counter()
    for batch in chain(batches, [None]):
        for kinds, votes, lengths, features in zip(*(c.to_pylist() for c in batch.columns)) if batch else []:
            at = 0
            for kind, vote, length in zip(kinds, votes, lengths):
                counts[kind, vote, features[at : at + 2 * length]] += 1
                at += 2 * length
        if not batch or len(counts) > COUNTED:
            yield _rows([(*k, n) for k, n in counts.items()], _EXAMPLES)
            counts.clear()


def _packed(batches: Iterator[pa.RecordBatch], labels: np.ndarray) -> logistic.Packed:
    """The candidates of a task, with the likelihoods of their votes: buckets of each kind behind those of the kinds before it, the last ones for what a kind has in all of them."""
    kinds, votes, features, times = [], [], [], []
    for batch in batches:
        for kept, column in zip((kinds, votes, features, times), batch.columns):
            kept += column.to_pylist()
    kind = np.array(kinds, np.int64)
    lengths = np.array([len(f) // 2 for f in features], np.int64)
    rows = np.repeat(np.arange(len(kind)), lengths)
    own = np.frombuffer(b"".join(features), np.uint16).astype(np.int64) + kind[rows] * BUCKETS
    return logistic.Packed(np.concatenate([rows, np.arange(len(kind))]), np.concatenate([own, len(KINDS) * BUCKETS + kind]), labels[kind, np.array(votes, np.int64)], np.array(times, np.float64))


_SUMS = "bucket int, total double"


def _gradient(batches: Iterator[pa.RecordBatch], labels: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    sums = _packed(batches, labels).sums(weights)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["bucket", "total"])


def _descended(batches: Iterator[pa.RecordBatch], labels: np.ndarray, descent: logistic.Descent) -> Iterator[pa.RecordBatch]:
    """All rounds within one task."""
    packed = _packed(batches, labels)
    for _ in range(FIT_ROUNDS):
        descent.step(packed.sums(descent.weights))
    at = np.flatnonzero(descent.weights)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(descent.weights[at])], names=["bucket", "total"])


def classifiers(scanned: DataFrame, rows: int = FIT_ROWS) -> dict[str, logistic.Logistic]:
    """The classifiers of all candidates, trained on what the labelers' reliabilities make of them; no text is labelled by hand.

    Up to ``rows`` different candidates are one task, which goes through all rounds by itself; beyond, every round is a job of several tasks, with the same outcome.
    """
    keys = ["kind", "votes", "features"]
    counted = scanned.select("kinds", "votes", "lengths", "features").mapInArrow(_examples, _EXAMPLES).groupBy(keys).agg(F.sum("n").alias("n"))
    examples = durable(counted)
    patterns = sorted((r.kind, r.votes, r.n, r.different) for r in examples.groupBy("kind", "votes").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect())
    labels, sizes = np.zeros((len(KINDS), 3**5)), np.zeros(len(KINDS))
    for kind, name in enumerate(KINDS):
        if own := [p for p in patterns if p[0] == kind]:
            codes, times = np.array([p[1] for p in own]), np.array([p[2] for p in own], np.float64)
            votes = codes[:, None] // 3 ** np.arange(LABELERS[name]) % 3
            labels[kind, codes], sizes[kind] = reliabilities(votes, times=times), times.sum()
    tasks = -(-sum(p[3] for p in patterns) // rows)
    descent = logistic.Descent(np.concatenate([np.repeat(sizes, BUCKETS), sizes]), np.repeat([1e-5, 0.0], [len(KINDS) * BUCKETS, len(KINDS)]), rate=0.3)
    if tasks == 1:
        got = examples.coalesce(1).mapInArrow(partial(_descended, labels=labels, descent=descent), _SUMS).toArrow()
        descent.weights[got["bucket"].to_numpy()] = got["total"].to_numpy()
    elif tasks:
        parts = examples.coalesce(tasks)
        for _ in range(FIT_ROUNDS):
            got = parts.mapInArrow(partial(_gradient, labels=labels, weights=descent.weights), _SUMS).groupBy("bucket").agg(F.sum("total").alias("total")).toArrow()
            descent.step(np.bincount(got["bucket"].to_numpy(), got["total"].to_numpy(), len(descent.weights)))
    weights, own = descent.weights[: len(KINDS) * BUCKETS].reshape(len(KINDS), BUCKETS), descent.weights[len(KINDS) * BUCKETS :]
    return {name: logistic.Logistic(weights[i].copy(), float(own[i])) for i, name in enumerate(KINDS) if sizes[i]}


def _fitted(df: DataFrame, texts: bool = False) -> tuple[Model, DataFrame]:
    """The model of a table, and the candidates of its documents, with which it was fitted."""
    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    words = lexicon(rows.where(F.col("text").isNotNull()))
    scanned = durable((rows if texts else rows.where(F.col("text").isNotNull())).mapInArrow(partial(_scan, words=words, texts=texts), _SCANNED))
    return Model(words, classifiers(scanned)), scanned


def fitted(df: DataFrame) -> Model:
    """The model of a table ``doc_id, text``, fitted on all of its texts."""
    return _fitted(df)[0]


def _kept(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[int | None, str | None, list[str], dict[tuple[int, int, str], int], list[Judged]]]:
    """Of each row of candidates: key, text, values, the place of each candidate among them, and the pieces."""
    for doc, text, kinds, _, places, lengths, features, values in zip(*(c.to_pylist() for c in batch.columns)):
        ends = np.cumsum(np.frombuffer(lengths, np.uint8), dtype=np.int64).tolist()
        own = np.split(np.frombuffer(features, np.uint16), ends[:-1]) if ends else []
        spans = [(KINDS[k], a, b, f) for k, (a, b), f in zip(kinds, np.frombuffer(places, np.int64).reshape(-1, 2).tolist(), own)]
        yield doc, text, values, {(a, b, k): i for i, (k, a, b, _) in enumerate(spans)}, model.chosen(iter(spans))


def _kept_values(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in _pieces_of(batches):
        rows = {(doc, kind, values[at[a, b, kind]]) for doc, _, values, at, pieces in _kept(batch, model) for kind, a, b, _ in pieces}
        yield _rows(sorted(rows), "doc_id bigint, kind string, value string")


def _kept_texts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in _pieces_of(batches):
        out = []
        for doc, text, _, _, pieces in _kept(batch, model):
            at = composed(text)[1] if pieces else None
            out.append((doc, replaced(text, [(kind, at[a], at[b], p) for kind, a, b, p in pieces] if at else pieces)))
        yield _rows(out, "doc_id bigint, text string")


def _values(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in _pieces_of(batches):
        rows = {(d, kind, value_of(t[x:y])) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for kind, x, y, _ in model.found(t)}
        yield _rows(sorted(rows), "doc_id bigint, kind string, value string")


def replaced(text: str | None, pieces: list[Judged]) -> str | None:
    """The text with ``[KIND]`` in place of each piece."""
    if not pieces:
        return text
    out, last = [], 0
    for kind, a, b, _ in pieces:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def redacted(text: str | None, model: Model) -> str | None:
    """The text with ``[KIND]`` in place of each piece; null stays null."""
    return replaced(text, model.found(text))


def _texts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in _pieces_of(batches):
        yield _rows([(d, redacted(t, model)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], "doc_id bigint, text string")


def personal_pieces(df: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, kind, value``: the distinct pieces of each document. Whole texts; a row whose key is null is left out, repeated keys are judged by row. Without a model, by that of the table."""
    if model is None:
        model, scanned = _fitted(df)
        return scanned.where(F.col("doc_id").isNotNull()).mapInArrow(partial(_kept_values, model=model), "doc_id bigint, kind string, value string")
    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(partial(_values, model=model), "doc_id bigint, kind string, value string")


def redacted_texts(df: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, text``: every document with typed placeholders in place of its personal information; null and empty texts as they are."""
    if model is None:
        model, scanned = _fitted(df, texts=True)
        return scanned.mapInArrow(partial(_kept_texts, model=model), "doc_id bigint, text string")
    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_texts, model=model), "doc_id bigint, text string")
