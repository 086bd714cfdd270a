"""What a question asks to be covered, and whether a text that was read covers it.

A text is cut into folded tokens once. Rules are short phrases of words and token classes, kept in a table; what they find are
typed needs, and each kind of need has its own test against a passage.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

from corvid.functions.text import MONTHS

#: Number words, and the vocabulary of needs.
NUMBER_WORDS = {"quince": "15", "dieciseis": "16", "cincuenta": "50"}
PERIOD_TERMS = ("diario", "mensual", "anual")
LEGAL_ACTIONS = ("declaratoria de utilidad pública", "decreto de expropiación")
SMALL_WORDS = frozenset("al de del digna dignas el en la las los".split())
ASSERTING = ("reform", "expid", "derog", "establec", "dispus", "comprend", "correspond", "consta", "incluy", "vigent", "formado", "formada")
NOT_FOUND = ("no se encontro|localizo|hallo", "no fue posible encontrar|localizar", "evidencia disponible? insuficiente", "chunk|chunks leido|leidos? no contiene|contienen|muestra|muestran")


def fold(text: str) -> str:
    """Case and marks folded, number words as digits, white space single."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return " ".join(re.sub(r"\w+", lambda m: NUMBER_WORDS.get(m[0], m[0]), plain).split())


@dataclass(frozen=True)
class Token:
    """A word, number, period or identifier with its place; ``glue`` is what stands between it and the token before."""

    word: str
    start: int
    end: int
    glue: str


def tokenise(text: str) -> list[Token]:
    out: list[Token] = []
    end = 0
    for m in re.finditer(r"\w+(?:[-.]\w+)*", text):
        out.append(Token(fold(m[0]), m.start(), m.end(), text[end : m.start()]))
        end = m.end()
    return out


def _matches(shape: str) -> Callable[[str], bool]:
    return lambda word: re.fullmatch(shape, word) is not None


#: Classes of tokens that rules name in angle brackets; what they match is captured.
CLASSES: dict[str, Callable[[str], bool]] = {
    "year": _matches(r"(?:19|20)\d\d"),
    "int": str.isdigit,
    "period": _matches(r"(?:19|20)\d\d-(?:19|20)\d\d"),
    "month": MONTHS.__contains__,
    "decimal": _matches(r"\d+\.\d+"),
    "norm": _matches(r"(?:nom|nmx)-\d{3}(?:-[a-z]\w*)*(?:-\d{4})?"),
}


@dataclass(frozen=True)
class Rule:
    """A phrase: words with ``|`` between alternatives, ``<class>``, a question mark after what may be missing, and ``*n`` for up
    to n tokens of any kind. Its tokens have only white space between them."""

    phrase: str

    @cached_property
    def steps(self) -> tuple[tuple[str, bool], ...]:
        return tuple((p.rstrip("?"), p.endswith("?")) for p in self.phrase.split())

    def at(self, tokens: list[Token], place: int) -> tuple[int, tuple[str, ...]] | None:
        """Where a match from ``place`` ends, and what it captured."""
        return self._from(tokens, place, 0, place)

    def _from(self, tokens: list[Token], place: int, step: int, first: int) -> tuple[int, tuple[str, ...]] | None:
        if step == len(self.steps):
            return place, ()
        want, optional = self.steps[step]
        if want.startswith("*"):
            for skipped in range(int(want[1:]) + 1):
                if found := self._from(tokens, place + skipped, step + 1, first):
                    return found
                if place + skipped >= len(tokens) or tokens[place + skipped].glue.strip():
                    return None
            return None
        if place < len(tokens) and (place == first or not tokens[place].glue.strip()):
            word, named = tokens[place].word, want.startswith("<")
            if CLASSES[want[1:-1]](word) if named else word in want.split("|"):
                if found := self._from(tokens, place + 1, step + 1, first):
                    return found[0], ((word,) if named else ()) + found[1]
        return self._from(tokens, place, step + 1, first) if optional else None

    def all(self, tokens: list[Token]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(begin, end, captures) of all matches, none within another."""
        place = 0
        while place < len(tokens):
            if found := self.at(tokens, place):
                yield place, found[0], found[1]
                place = max(found[0], place + 1)
            else:
                place += 1


@dataclass(frozen=True)
class Need:
    """One thing that a question asks for: its kind, and its value as text."""

    kind: str
    value: str

    def __str__(self) -> str:
        return LABELS[self.kind].format(self.value)


#: How needs are shown, in the order in which they are listed.
LABELS = {
    "year": "{}",
    "hasta": "rango hasta {}",
    "entre": "rango entre {}",
    "más de": "rango más de {}",
    "term": "término {}",
    "plan": "tema PND {}",
    "norm": "tema {}",
    "action": "tema {}",
    "reform": "tema reforma: {}",
    "published": "publicación {}",
    "transitory": "transitorio",
    "numeral": "numeral {}",
}
_SIMPLE = [
    ("year", Rule("de <year> a <year>")),
    ("year", Rule("entre <year> y <year>")),
    ("hasta", Rule("hasta <int>")),
    ("entre", Rule("entre <int> y <int>")),
    ("más de", Rule("mas de <int>")),
    ("norm", Rule("<norm>")),
    *(("action", Rule(fold(action))) for action in LEGAL_ACTIONS),
]
_PLAN = [Rule("plan nacional de desarrollo <period>"), Rule("pnd <period>")]
_DATED = [Rule("publicado|publicada en? el? dof? el? <int> de <month> de <year>"), Rule("decreto|acuerdo|resolucion|reforma del <int> de <month> de <year>")]
_MONTHLY = Rule("reforma|decreto|acuerdo|resolucion *6 de <month> de <year>")
_REFORM, _MONTH, _AND = Rule("reforma constitucional? de"), Rule("de <month> de <year>"), Rule("y la|el")
_ACTION_NAMES = {fold(action): action for action in LEGAL_ACTIONS}


def _reforms(text: str, tokens: list[Token]) -> Iterator[Need]:
    """What a reform is of: up to its date, another subject, a mark or the end; not where that is but its date."""
    for _, place, _ in _REFORM.all(tokens):
        end = place
        while end < len(tokens) and not (end > place and set(tokens[end].glue) & set("?;,")) and not _MONTH.at(tokens, end) and not (end > place and _AND.at(tokens, end)):
            end += 1
        if end > place and not (tokens[place].word in MONTHS and end - place in (1, 3)):
            yield Need("reform", " ".join(text[tokens[place].start : tokens[end - 1].end].split()))


def _published(tokens: list[Token]) -> Iterator[Need]:
    days = [f"{year}-{MONTHS.index(month) + 1:02d}-{int(day):02d}" for rule in _DATED for _, _, (day, month, year) in rule.all(tokens)]
    months = [f"{year}-{MONTHS.index(month) + 1:02d}" for _, _, (month, year) in _MONTHLY.all(tokens)]
    yield from (Need("published", d) for d in days)
    yield from (Need("published", m) for m in months if not any(d.startswith(m) for d in days))


def _provisions(tokens: list[Token]) -> Iterator[Need]:
    """Numbered provisions that a question about transitory articles lists, each after the word or after one another."""
    if not any("transitorio" in t.word for t in tokens):
        return
    listing, found = False, []
    for t in tokens:
        listing = t.word in ("numeral", "numerales") or listing and not set(t.glue) & set(":;?")
        if listing and CLASSES["decimal"](t.word):
            found.append(Need("numeral", t.word))
    if found:
        yield Need("transitory", "")
        yield from found


def needs(question: str) -> list[Need]:
    """What a question asks for by name, each once: compared years, ranges, terms, plans, norms, acts, reforms, dates, provisions."""
    tokens = tokenise(question)
    found: list[Need] = []
    for kind, rule in _SIMPLE:
        for begin, end, captured in rule.all(tokens):
            if kind == "year":
                found += [Need(kind, y) for y in captured]
            elif kind == "norm":
                found.append(Need(kind, captured[0].upper()))
            elif kind == "action":
                found.append(Need(kind, _ACTION_NAMES[rule.phrase]))
            else:
                found.append(Need(kind, " y ".join(captured)))
    named = [term for term in PERIOD_TERMS if any(term in t.word for t in tokens)]
    found += [Need("term", term) for term in named] if len(named) > 1 else []
    for rule in _PLAN:
        for _, end, (period,) in rule.all(tokens):
            found.append(Need("plan", period))
            while end < len(tokens) and (tokens[end].word == "y" or CLASSES["period"](tokens[end].word)):
                found += [Need("plan", tokens[end].word)] if tokens[end].word != "y" else []
                end += 1
    found += [*_reforms(question, tokens), *_published(tokens), *_provisions(tokens)]
    order = list(LABELS)
    return list(dict.fromkeys(sorted(found, key=lambda n: order.index(n.kind))))


@dataclass
class Passage:
    """A text that was read, and what is known of it."""

    text: str
    path: str = ""
    title: str = ""
    publication_date: str | None = None
    heading_path: tuple[str, ...] = ()
    years: frozenset[str] = field(default_factory=frozenset)

    @cached_property
    def tokens(self) -> list[Token]:
        return tokenise(self.text)

    @cached_property
    def source(self) -> str:
        """The text with its title and path, folded."""
        return fold("\n".join((self.title, self.path, self.text)))

    def says(self, phrase: str) -> bool:
        return next(Rule(phrase).all(self.tokens), None) is not None

    @cached_property
    def line_starts(self) -> set[str]:
        """The folded first words of the lines, without marks of quotes and bold type."""
        firsts = (line.replace("*", " ").replace(">", " ").split() for line in self.text.splitlines())
        return {fold(w[0]).rstrip(".") for w in firsts if w}


def _long_words(phrase: str) -> list[str]:
    return [t.word for t in tokenise(phrase) if len(t.word) > 3 and t.word not in SMALL_WORDS]


def _published_when(value: str, p: Passage) -> bool:
    return (p.publication_date or "")[: len(value)] == value


def _reformed(value: str, p: Passage) -> bool:
    return "reform" in p.source and any(w[:7] in p.source for w in _long_words(value))


def _all_words(value: str, p: Passage) -> bool:
    return bool(words := _long_words(value)) and all(w in p.source for w in words)


def _has_plan(value: str, p: Passage) -> bool:
    return value in p.source and ("plan nacional de desarrollo" in p.source or "pnd" in re.findall(r"\w+", p.source))


def _is_transitory(value: str, p: Passage) -> bool:
    return any("transitorio" in h.casefold() for h in p.heading_path) or bool({"primero", "segundo"} & p.line_starts)


#: How each kind of need is tested.
TESTS: dict[str, Callable[[str, Passage], bool]] = {
    "year": lambda value, p: value in p.years,
    "hasta": lambda value, p: p.says(f"hasta {value}"),
    "entre": lambda value, p: p.says(f"entre {value}"),
    "más de": lambda value, p: p.says(f"mas de {value}"),
    "term": lambda value, p: any(value in t.word for t in p.tokens),
    "plan": _has_plan,
    "norm": lambda value, p: fold(value) in p.source,
    "action": _all_words,
    "reform": _reformed,
    "published": _published_when,
    "transitory": _is_transitory,
    "numeral": lambda value, p: value in p.line_starts,
}


def covers(need: Need, passage: Passage) -> bool:
    """Whether a text that was read meets a need."""
    return TESTS[need.kind](need.value, passage)


_NOT_FOUND = [Rule(phrase) for phrase in NOT_FOUND]


def corrects(answer: str) -> bool:
    """Whether an answer to a false premise says in some clause what holds, and not only what doesn't or that nothing was found."""
    for clause in re.split("[.;]", answer):
        tokens = tokenise(clause)
        words = [t.word for t in tokens]
        if any(w.startswith(ASSERTING) for w in words):
            denies = words[0] == "no" or any(next(rule.all(tokens), None) for rule in _NOT_FOUND)
            if "sino" in words or not denies:
                return True
    return False


_ANCHORS = [Rule("articulo <int>"), Rule("articulo <decimal>"), Rule("numeral <int>"), Rule("numeral <decimal>"), Rule("<decimal>")]


def snippet(text: str, query: str, most: int) -> tuple[str, bool]:
    """At most ``most`` characters of a text, and whether that is less than all.

    The part begins a quarter before what the query names first (an article, a numeral, a number) where the text has it, else
    before the first word of four letters or more that is the query's too.
    """
    if len(text) <= most:
        return text, False
    body, asked = tokenise(text), tokenise(query)
    named = [Rule(" ".join(t.word for t in asked[a:b])) for rule in _ANCHORS for a, b, _ in rule.all(asked)]
    place = next((found[0] for rule in named if (found := next(rule.all(body), None))), None)
    if place is None:
        words = {t.word for t in asked if len(t.word) > 3}
        place = next((i for i, t in enumerate(body) if t.word in words), None)
    begin = 0 if place is None else max(0, min(body[place].start - most // 4, len(text) - most))
    before, after = "…" if begin else "", "…" if begin + most < len(text) else ""
    return before + text[begin + len(before) : begin + most - len(after)] + after, True
