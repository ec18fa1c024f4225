"""Unicode normalisation (NFKC), capitals and case folding as column expressions, from tables built by rule.

The tables are those of the driver's Python, so one Unicode version holds for all that a session computes,
whatever the JVM knows. Everything runs on the JVM: most characters are exchanged one for one by ``translate``, the few that
become several are looked up, and only a character that is followed by marks (or jamo) is composed step by step. A
text is cut before each character that nothing before it can change, so every piece is normalised by itself.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hangul syllables follow a rule of the standard: 19 leads, 21 vowels, 27 tails (fixed values).
LEADS = "".join(map(chr, range(0x1100, 0x1113)))
VOWELS = "".join(map(chr, range(0x1161, 0x1176)))
TAILS = "".join(map(chr, range(0x11A8, 0x11C3)))
SYLLABLES = "".join(map(chr, range(0xAC00, 0xD7A4)))


@lru_cache(maxsize=1)
def characters() -> list[str]:
    """Every assigned character; the others stand for themselves in all tables."""
    return [c for c in map(chr, range(1, sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]



def character_class(characters: set[str], negated: bool = False) -> str:
    """A class of a regular expression that holds exactly these characters."""
    parts, points = [], sorted(map(ord, characters))
    start = 0
    for i, point in enumerate(points):
        if i + 1 == len(points) or points[i + 1] != point + 1:
            parts.append(f"\\x{{{points[start]:x}}}-\\x{{{point:x}}}")
            start = i + 1
    return f"[{'^' if negated else ''}{''.join(parts)}]"


class Exchange:
    """Characters that become other characters, each by itself."""

    def __init__(self, changed: dict[str, str]):
        single = {a: b for a, b in changed.items() if len(b) == 1}
        several = {a: b for a, b in changed.items() if len(b) != 1}
        self.several = several
        self.source, self.target = "".join(single), "".join(single.values())
        self.keys, self.values = "".join(several), list(several.values())
        self.has = character_class(set(several))
        self.cut = f"{self.has}|{character_class(set(several), negated=True)}+"

    def __call__(self, text: Column) -> Column:
        text = F.translate(text, self.source, self.target) if self.source else text
        return F.when(text.rlike(self.has), F.array_join(F.transform(_pieces(text, self.cut), self._long), "")).otherwise(text)

    def _long(self, piece: Column) -> Column:
        return F.coalesce(F.get(_table(self.values), F.instr(F.lit(self.keys), piece) - 1), piece)


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s){pattern}"), F.lit(0))


def _table(values: list[str]) -> Column:
    """A constant array of strings, as one literal."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


class Composition:
    """What joins a character before it, and how such a sequence is put together."""

    def __init__(self):
        pairs = {}
        for c in characters():
            parts = unicodedata.decomposition(c).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                a, b = (chr(int(p, 16)) for p in parts)
                if unicodedata.normalize("NFC", a + b) == c:
                    pairs[a + b] = c
        self.pair_keys, self.pair_values = "\x01".join(pairs), "".join(pairs.values())
        seconds = {p[1] for p in pairs} | set(VOWELS) | set(TAILS)

        def joins(c: str) -> bool:
            first = unicodedata.normalize("NFKD", c)[0]
            return unicodedata.combining(first) != 0 or first in seconds

        self.joining = {c for c in characters() if joins(c)}
        syllables = set(SYLLABLES)
        apart = {
            c: unicodedata.normalize("NFKD", c)
            for c in characters()
            if c not in syllables and not unicodedata.is_normalized("NFKD", c) and (c in self.joining or unicodedata.is_normalized("NFKC", c))
        }
        self.apart_keys, self.apart_values = "".join(apart), list(apart.values())
        marks = {c: unicodedata.combining(c) for c in characters() if unicodedata.combining(c)}
        self.marks, self.classes = "".join(marks), [str(n) for n in marks.values()]
        joined, free = character_class(self.joining), character_class(self.joining, negated=True)
        self.has = joined
        self.cut = f"{free}?{joined}+|{free}+(?!{joined})"

    def __call__(self, text: Column) -> Column:
        whole = F.transform(_pieces(text, self.cut), lambda p: F.when(p.rlike(self.has), self._compose(p)).otherwise(p))
        return F.when(text.rlike(self.has), F.array_join(whole, "")).otherwise(text)

    def _apart(self, c: Column) -> Column:
        known = F.get(_table(self.apart_values), F.instr(F.lit(self.apart_keys), c) - 1)

        def jamo(at: Column) -> Column:
            part = lambda of, n: F.substring(F.lit(of), (n + 1).cast("int"), F.lit(1))
            tail = at % 28
            return F.concat(part(LEADS, F.floor(at / 588)), part(VOWELS, F.floor(at % 588 / 28)), F.when(tail > 0, part(TAILS, tail - 1)).otherwise(""))

        place = F.instr(F.lit(SYLLABLES), c) - 1
        return F.coalesce(known, F.when(place >= 0, jamo(place)), c)

    def _class(self, c: Column) -> Column:
        return F.coalesce(F.get(_table(self.classes), F.instr(F.lit(self.marks), c) - 1).cast("int"), F.lit(0))

    def _joined(self, a: Column, b: Column) -> Column:
        """The character that a and b make, or null."""
        at = F.instr(F.lit(self.pair_keys), F.concat(a, b))
        known = F.when((at > 0) & (a != ""), F.substring(F.lit(self.pair_values), (F.floor((at - 1) / 3) + 1).cast("int"), F.lit(1)))
        lead, vowel = F.instr(F.lit(LEADS), a), F.instr(F.lit(VOWELS), b)
        open_syllable, tail = F.instr(F.lit(SYLLABLES), a), F.instr(F.lit(TAILS), b)
        syllable = lambda n: F.substring(F.lit(SYLLABLES), n.cast("int"), F.lit(1))
        made = F.when((a != "") & (lead > 0) & (vowel > 0), syllable(((lead - 1) * 21 + vowel - 1) * 28 + 1)).when(
            (a != "") & (open_syllable > 0) & ((open_syllable - 1) % 28 == 0) & (tail > 0), syllable(open_syllable + tail)
        )
        return F.coalesce(known, made)

    def _compose(self, piece: Column) -> Column:
        """One sequence taken apart, its marks in the standard's order, and put together again."""
        single = F.flatten(F.transform(F.split(piece, ""), lambda c: F.split(self._apart(c), "")))

        def ordered(chars: Column) -> Column:
            classes = F.transform(chars, self._class)

            def keyed(kinds: Column) -> Column:
                # marks keep their order within one class, and do not pass a character that is none
                run = lambda i: F.size(F.filter(F.slice(kinds, F.lit(1), i + 1), lambda k: k == 0))
                return F.array_sort(F.transform(chars, lambda c, i: F.struct(run(i).alias("run"), kinds[i].alias("kind"), i.alias("at"), c.alias("c"))))

            return _let(classes, keyed)

        def step(state: Column, mark: Column) -> Column:
            made = self._joined(state["first"], mark["c"])
            near = (state["marks"] == "") | (state["last"] < mark["kind"])
            keep = lambda done, first, marks, last: F.struct(
                done.alias("done"), first.alias("first"), marks.alias("marks"), last.cast("int").alias("last")
            )
            return F.when(near & made.isNotNull(), keep(state["done"], made, state["marks"], state["last"])).when(
                mark["kind"] == 0, keep(F.concat(state["done"], state["first"], state["marks"]), mark["c"], F.lit(""), F.lit(0))
            ).otherwise(keep(state["done"], state["first"], F.concat(state["marks"], mark["c"]), mark["kind"]))

        empty = F.struct(F.lit("").alias("done"), F.lit("").alias("first"), F.lit("").alias("marks"), F.lit(0).alias("last"))
        return F.aggregate(ordered(single), empty, step, lambda s: F.concat(s["done"], s["first"], s["marks"]))


@lru_cache(maxsize=1)
def _tables() -> tuple[Exchange, Composition, Exchange, Exchange]:
    composition = Composition()
    free = [c for c in characters() if c not in composition.joining and not unicodedata.is_normalized("NFKC", c)]
    changed = lambda new: Exchange({c: d for c, d in ((c, new(c)) for c in characters()) if c != d})
    tables = Exchange({c: unicodedata.normalize("NFKC", c) for c in free}), composition, changed(str.upper), changed(str.casefold)
    characters.cache_clear()
    return tables


def nfkc(text: Column) -> Column:
    exchange, composition, _, _ = _tables()
    return _let(_let(text, exchange), composition)


def upper(text: Column) -> Column:
    return _let(text, _tables()[2])


def casefold(text: Column) -> Column:
    return _let(text, _tables()[3])


def version() -> str:
    """The Unicode version of the tables."""
    return unicodedata.unidata_version

