"""Secrets in texts: fixed patterns, and credential values that are hard to guess."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import map_texts

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a shorter run holds no longer one, so this drops only failing ones
#: Where a credential is likely: a name for one, a sign of assignment, and a value: all up to the
#: closing quote on the same line, to the first blank or sign if that is missing, or without
#: quotes to the first blank or the end of a tag.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code|wort)?|pwd|secret|token|api[_-]?key|access[_-]?key|"""
    r"""private[_-]?key|client[_-]?key|credentials?|contrase(?:ñ|n)a|mot[_ ]de[_ ]passe|login|auth)"""
    r"""["'\])]{0,2}\s*(?:=>|:=|==?|:)\s*(?:"""
    r""""(?:(?:basic|bearer)\x20)?((?:\\.|[^"\\\r\n])+)"(?!\w)|"""
    r"""'(?:(?:basic|bearer)\x20)?((?:\\.|[^'\\\r\n])+)'(?!\w)|"""
    r"""["'](?:(?:basic|bearer)\x20)?([^\s"'<>,;()]+)|"""
    r"""\(?(?:(?:basic|bearer)\x20)?((?!["'])(?:(?!</)\S)+))""",
    re.IGNORECASE,
)
#: A call or an item of something that has a name: what stands for a value in program text.
CALL = re.compile(r"(?:new\s+)?[A-Za-z_][\w.]*(?=[(\[])")
#: An address without a password in it.
ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://[^\s@]*", re.IGNORECASE)
CLOSERS = {")": "(", "]": "[", "}": "{", ">": "<"}
#: Values shorter than this are no credentials.
MIN_VALUE = 6
#: Words of a phrase are guessed among that many, as a power of ten, if they are not fixed ones.
LOG10_VOCABULARY = 4.0
PHRASE_WORD = re.compile(r"(?<![^\W_])[^\W\d_]{2,}(?![^\W_])")
#: A value is a secret if the cheapest way to guess it takes this many guesses, as a power of ten:
#: set from planted random values of 8 characters against names and calls in clean program text.
MIN_LOG10_GUESSES = 13.0

# Words that guessers try first, the most frequent first.
WORDS = (
    "password 123456 12345678 qwerty abc123 monkey letmein dragon baseball iloveyou master sunshine "
    "ashley michael shadow superman football welcome admin login hello charlie freedom whatever "
    "princess starwars computer internet secret summer winter spring autumn default changeme change "
    "root test guest user demo example sample temp dummy null none true false placeholder your "
    "token key access private public server client service system database account manager "
    "google facebook amazon github docker mysql postgres oracle redis mongo windows linux ubuntu "
    "apple orange banana cheese coffee pepper cookie silver golden purple yellow black white green "
    "house money tiger lion eagle falcon phoenix thunder lightning hunter ranger soccer hockey "
    "jordan robert thomas daniel andrew joshua matthew jessica jennifer michelle nicole london "
    "paris berlin madrid the and you this that with from have love life time home work world "
    "one two three four five six seven eight nine zero my is not pass word insert here enter value"
).split()
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4831!0$57", "aaeb1iosst")


@lru_cache(maxsize=1)
def key_neighbours() -> dict[str, str]:
    """Keys beside each key; the rows of a keyboard lie half a key apart."""
    at = {c: (2 * x + y, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    near = lambda p, q: abs(p[1] - q[1]) <= 1 and abs(p[0] - q[0]) <= 2 and p != q
    return {c: "".join(d for d, q in at.items() if near(p, q)) for c, p in at.items()}


DATE = re.compile(
    r"(?P<y>(?:19|20)\d\d)(?P<s>[-/._]?)(?:0?[1-9]|1[0-2])(?P=s)(?:[12]\d|3[01]|0?[1-9])"
    r"|(?:0?[1-9]|[12]\d|3[01])(?P<t>[-/._]?)(?:0?[1-9]|[12]\d|3[01])(?P=t)(?:(?:19|20)\d\d|\d\d)"
    r"|(?:19|20)\d\d"
)


def _per_char(c: str, both_cases: bool) -> float:
    """Of brute force: the characters one has to try, as a power of ten."""
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return math.log10((26 if c.isascii() else 100) * (1 + both_cases))
    return math.log10(33)


def _alphabet(value: str) -> float:
    """The characters one has to try at each place of a value, as a power of ten: those of all
    kinds that occur in it."""
    kinds = (
        (10, any(c.isdigit() for c in value)),
        (26, any(c.isascii() and c.islower() for c in value)),
        (26, any(c.isascii() and c.isupper() for c in value)),
        (100, any(c.isalpha() and not c.isascii() for c in value)),
        (33, any(not c.isalnum() for c in value)),
    )
    return math.log10(max(2, sum(n for n, there in kinds if there)))


class GuessCost:
    """The least number of guesses for a value, as a power of ten.

    The value is cut into words (by rank, with capitals and look-alike digits), dates, repeats,
    walks over neighbouring keys, and single characters tried by brute force; guesses of parts
    multiply, and each part costs a factor two for the unknown way the parts are put together.
    Dynamic programming over the end of the last part finds the cheapest cut.
    """

    def __init__(self, words: tuple[str, ...] = tuple(WORDS)):
        self.rank = {w: k + 1 for k, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, self.rank), default=0)
        self.near = key_neighbours()

    def word(self, part: str) -> float | None:
        low = part.lower()
        rank, swapped = self.rank.get(low), 0
        if rank is None:
            plain = low.translate(LEET)
            rank = self.rank.get(plain)
            if rank is None:
                return None
            swapped = sum(a != b for a, b in zip(low, plain, strict=True))
        upper = sum(c.isupper() for c in part)
        lower = sum(c.islower() for c in part)
        ways = 1 if not upper else 2 if not lower or (upper == 1 and part[0].isupper()) else sum(
            math.comb(upper + lower, k) for k in range(1, min(upper, lower) + 1)
        )
        return math.log10(rank) + math.log10(ways) + swapped * math.log10(2)

    def parts(self, value: str) -> list[list[tuple[int, float]]]:
        """For each end, (start, cost) of the parts that end there, brute force apart."""
        n = len(value)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 2, min(n, i + self.longest) + 1):
                if (g := self.word(value[i:j])) is not None:
                    ends[j].append((i, g))
            if (m := DATE.match(value, i)) is not None:
                signs = any(not c.isdigit() for c in m.group())
                years = 130 if m.group() and m.end() - i > 4 else 1
                days = 365 if m.end() - i > 4 else 130
                ends[m.end()].append((i, math.log10(days * years) + signs * math.log10(4)))
        i, low = 0, value.lower()
        while i < n:  # walks, as far as they go; their beginnings are walks too
            j, turns, last = i + 1, 0, 0
            while j < n and low[j] in self.near.get(low[j - 1], ""):
                step = ord(low[j]) - ord(low[j - 1])
                turns += step != last
                last = step
                j += 1
                if j - i >= 3:
                    ends[j].append((i, math.log10(47 * (j - i)) + turns * math.log10(6)))
            i = max(j - 1, i + 1)
        return ends

    def whole(self, value: str) -> float:
        """As ``log10``, where brute force has to try the alphabet of the whole value at each of
        its places, and words between blanks are also guessed from a vocabulary."""
        return self.log10(value, per_char=_alphabet(value))

    def log10(self, value: str, repeats: bool = True, per_char: float | None = None) -> float:
        n = len(value)
        ends = self.parts(value)
        if per_char is not None and " " in value:
            for m in PHRASE_WORD.finditer(value):
                ends[m.end()].append((m.start(), LOG10_VOCABULARY + (not m.group().islower()) * math.log10(2)))
            for i, c in enumerate(value):
                if c == " ":
                    ends[i + 1].append((i, 0.0))
        if repeats:
            for i, j, unit in _repeats(value):
                ends[j].append((i, self.log10(unit, False, per_char) + math.log10((j - i) // len(unit))))
        best = [0.0] * (n + 1)
        both = value.lower() != value != value.upper()
        for j in range(1, n + 1):
            cost = best[j - 1] + (_per_char(value[j - 1], both) if per_char is None else per_char)
            for i, g in ends[j]:
                cost = min(cost, best[i] + g + math.log10(2))
            best[j] = cost
        return best[n]


def _repeats(value: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, unit) of units of up to 32 characters that follow one another."""
    n = len(value)
    for size in range(1, min(32, n // 2) + 1):
        i = 0
        while i + 2 * size <= n:
            j = i + size
            while j < n and value[j] == value[j - size]:
                j += 1
            times = (j - i) // size
            if times >= 2 and (size > 1 or times >= 3):
                yield i, i + times * size, value[i : i + size]
                i = i + times * size
            else:
                i = max(i + 1, j - size + 1)


def unquoted_end(value: str) -> int:
    """Where a value that ends at a blank really ends: a call or item of a name before its
    bracket, any other before quotes, commas, semicolons and brackets that it doesn't open. One
    mark that ends a sentence is the sentence's; several in a row are the value's."""
    if call := CALL.match(value):
        return call.end()
    end = len(value)
    while end:
        last = value[end - 1]
        alone = last in CLOSERS and value.count(last, 0, end) > value.count(CLOSERS[last], 0, end)
        if last not in "\"'`,;" and not alone:
            break
        end -= 1
    return end - 1 if re.search(r"(?<![.!?])[.!?]$", value[:end]) else end


Span = tuple[int, int, int, float | None]


def spans(text: str, cost: GuessCost, threshold: float = MIN_LOG10_GUESSES) -> list[Span]:
    """(start, kind, end, log10 guesses) by start, then kind; offsets are code points."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        base, at, reach = sorted(found, key=lambda s: s[:3]), 0, 0  # how far spans go that start at or before a place
        for m in CONTEXT.finditer(text):
            i, j = m.span(m.lastindex)
            if m.lastindex == 3:
                j = i + len(m.group(3).rstrip(".!?"))
            elif m.lastindex == 4:
                j = i + unquoted_end(m.group(4))
            while at < len(base) and base[at][0] <= i:
                reach = max(reach, base[at][2])
                at += 1
            if j - i < MIN_VALUE or j <= reach or ADDRESS.fullmatch(text, i, j):
                continue
            if (g := cost.whole(text[i:j])) >= threshold:
                found.append((i, 3, j, g))
    return sorted(found, key=lambda s: s[:3])


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: tuple[str, ...] = tuple(WORDS),
    min_log10_guesses: float = MIN_LOG10_GUESSES,
) -> DataFrame:
    """One row for each document: ``doc_id`` and ``spans``, an array of (kind, start, end,
    log10_guesses) by start, then kind as in ``KINDS``.

    Kinds assign, access and hex follow fixed patterns. Kind guess is the value of a credential
    context, not inside one of these, that takes ``10 ** min_log10_guesses`` guesses or more; a
    quoted value goes up to its closing quote on the same line, any other up to the first blank
    (see ``unquoted_end``). Addresses without a password are none.
    Null and empty texts have no spans; every row stands alone, so repeated rows and null ids are
    kept; an empty table gives no rows. Other columns are not read.
    """

    def work():
        cost = GuessCost(words)

        def of(texts: list[str]) -> list[list]:
            names = ("start", "kind", "end", "log10_guesses")
            found = [spans(text, cost, min_log10_guesses) for text in texts]
            return [[[dict(zip(names, (s, KINDS[k], e, g), strict=True)) for s, k, e, g in row] for row in found]]

        return of

    span = "struct<kind:string,start:int,end:int,log10_guesses:double>"
    return map_texts(docs, id_col, text_col, work, f"spans array<{span}>")


def span_list(found: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
