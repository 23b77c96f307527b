"""How a text treats a precedent: phrase counts, the class that prevails, and the status it gives."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from functools import reduce

import ahocorasick
import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexcorpus.functions.dictionaries import TREATMENTS

CLASSES = tuple(TREATMENTS)


def counts(text: Column, phrases: Mapping[str, Sequence[str]] = TREATMENTS, lowered: bool = False) -> dict[str, Column]:
    """Occurrences of each class's phrases in any case; overlapping phrases count for themselves.

    A phrase is counted by how much shorter the text gets without it, far cheaper than a pattern.
    """
    low = text if lowered else F.lower(text)

    def count(phrase: str) -> Column:
        return ((F.length(low) - F.length(F.replace(low, F.lit(phrase.lower()), F.lit("")))) / len(phrase)).cast("int")

    return {c: F.coalesce(reduce(lambda a, b: a + b, map(count, some)), F.lit(0)) for c, some in phrases.items()}


def dominant(numbers: Mapping[str, Column]) -> Column:
    """The class with the largest count, the earlier one of equals; null if all are 0."""
    most = F.greatest(*numbers.values())
    return F.when(most > 0, F.coalesce(*[F.when(n == most, c) for c, n in numbers.items()]))


def prevailing(text: Column, phrases: Mapping[str, Sequence[str]] = TREATMENTS) -> Column:
    """`dominant` of the `counts` of a text; as a lambda's variable the lower-case text and each count are computed once a row."""
    counted = F.transform(F.array(text), lambda t: F.transform(F.array(F.lower(t)), lambda low: F.array(*counts(low, phrases, lowered=True).values())))
    first = lambda c: F.element_at(F.array(*map(F.lit, phrases)), F.array_position(c, F.array_max(c)).cast("int"))
    return F.get(F.transform(F.flatten(counted), lambda c: F.when(F.array_max(c) > 0, first(c))), F.lit(0))


def strength(followed: Column, distinguished: Column, doubted: Column, overruled: Column) -> Column:
    against = distinguished + doubted
    return F.when(overruled > 0, 0).when(followed + against == 0, 50).otherwise(F.least(F.lit(100), (F.lit(100.0) * followed / (followed + F.lit(1.5) * against)).cast("int")))


def status(followed: Column, distinguished: Column, doubted: Column, overruled: Column) -> Column:
    return F.when(overruled > 0, "overruled").when(followed > 0, "good_law").when(distinguished > 0, "distinguished").when(doubted > 0, "doubted").otherwise("unknown")


def label(followed: Column, distinguished: Column, doubted: Column, overruled: Column) -> Column:
    later = lambda n: F.concat(n.cast("string"), F.lit(" later case"), F.when(n > 1, "s").otherwise(""))
    return (
        F.when(overruled > 0, F.concat(F.lit("Overruled in "), later(overruled)))
        .when((followed > 0) & (distinguished + doubted == 0), F.concat(F.lit("Good law — followed in "), later(followed)))
        .when(followed > 0, F.concat(F.lit("Generally followed ("), followed.cast("string"), F.lit("×) but distinguished in some cases ("), distinguished.cast("string"), F.lit("×)")))
        .when(distinguished > 0, F.concat(F.lit("Distinguished in "), later(distinguished), F.lit(" — verify applicability")))
        .when(doubted > 0, F.concat(F.lit("Doubted in "), later(doubted), F.lit(" — treat with caution")))
        .otherwise("No later treatment found — status unknown")
    )


def proposition(snippet: Column, citation: Column) -> Column:
    """What follows a citation up to its sentence's end, at most 200 letters; empty unless over 10."""
    at = F.instr(F.lower(snippet), F.lower(citation))
    after = F.trim(F.substring(snippet, at + F.length(citation), F.length(snippet)))
    first = F.trim(F.regexp_replace(F.trim(F.split(after, r"(?<=[.!?])\s+", 2)[0]), r"^[,;:–—-]+\s*", ""))
    return F.when((at > 0) & (F.length(first) > 10), F.substring(first, 1, 200)).otherwise("")


_SPACE = np.array([ord(c) for c in " \t\n\x0b\f\r"], dtype=np.uint32)


class Scanner:
    """Counts treatment phrases around every name that one judgment cites, reading the judgment once.

    One automaton finds all names, another all phrases; what stands in the window of a name is then
    told by the phrases' places. Windows are `window` letters to either side, their white space joined;
    a name that the text does not hold, or null, gets the counts of the first `first` letters as they are.
    """

    def __init__(self, phrases: Mapping[str, Sequence[str]] = TREATMENTS, window: int = 1000, first: int = 3000):
        self.window, self.first, self.size = window, first, len(phrases)
        self.classes: dict[str, list[int]] = {}
        for k, some in enumerate(phrases.values()):
            for p in some:
                self.classes.setdefault(p.lower(), []).append(k)
        self.overlapping = {p for p in self.classes if any(p.endswith(p[:k]) for k in range(1, len(p)))}
        self.automaton = self._automaton(self.classes)

    @staticmethod
    def _automaton(words) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for w in words:
            made.add_word(w, w)
        made.make_automaton()
        return made

    def plain(self, text: str) -> list[int]:
        """The counts of a whole text; occurrences of one phrase do not overlap."""
        low, out = text.lower(), [0] * self.size
        for p, classes in self.classes.items():
            for k in classes:
                out[k] += low.count(p)
        return out

    def _count(self, phrase: str, starts: list[int], low: int, high: int) -> int:
        a, b = bisect_left(starts, low), bisect_right(starts, high - len(phrase))
        if phrase not in self.overlapping:
            return max(0, b - a)
        n, free = 0, low
        for at in starts[a:b]:
            if at >= free:
                n, free = n + 1, at + len(phrase)
        return n

    def read(self, text: str, names: Sequence[str | None]) -> list[list[int]]:
        """The counts for each name."""
        low = text.lower()
        asked = [None if n is None else n.lower() for n in names]
        places = {"": 0} if "" in asked else {}
        wanted = {n for n in asked if n}
        if wanted:
            for end, n in self._automaton(wanted).iter(low):
                if n not in places:
                    places[n] = end - len(n) + 1
                    if len(places) >= len(wanted) + ("" in places):
                        break
        other = self.plain(text[: self.first]) if len(places) < len({*asked}) else []
        if len(low) != len(text):  # places in the lower-case text are not those of the text
            cut = lambda n: text[max(0, places[n] - self.window) : places[n] + len(n) + self.window]
            return [self.plain(re.sub(r"[ \t\n\x0b\f\r]+", " ", cut(n))) if n in places else other for n in asked]
        letters = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        space = np.isin(letters, _SPACE)
        kept = ~space
        kept[:1] = True
        kept[1:] |= ~space[:-1]
        joined_at = np.cumsum(kept) - 1
        joined = np.where(space, np.uint32(32), letters)[kept].tobytes().decode("utf-32-le", "surrogatepass")
        starts: dict[str, list[int]] = {}
        for end, p in self.automaton.iter(joined):
            starts.setdefault(p, []).append(end - len(p) + 1)
        known: dict[str, list[int]] = {}
        for n, at in places.items():
            start, end = max(0, at - self.window), min(len(text), at + len(n) + self.window)
            out = [0] * self.size
            if start < end:
                for p, some in starts.items():
                    found = self._count(p, some, int(joined_at[start]), int(joined_at[end - 1]) + 1)
                    for k in self.classes[p]:
                        out[k] += found
            known[n] = out
        return [known.get(n, other) for n in asked]
