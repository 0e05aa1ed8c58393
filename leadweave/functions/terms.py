"""Tables of terms looked for in one pass over a text: an automaton with failure links, once a task."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

Table = tuple[tuple[str, tuple[str, ...]], ...]


def table(classes: Mapping[str, Iterable[str]]) -> Table:
    return tuple((name, tuple(words)) for name, words in classes.items())


def _in_word(text: str, i: int) -> bool:
    """Whether a word's character is there: letter, digit, underscore, or a mark upon one."""
    while 0 <= i < len(text):
        kind = unicodedata.category(text[i])
        if kind != "Mn":
            return text[i] == "_" or kind[0] == "L" or kind == "Nd"
        i -= 1
    return False


class Scorer:
    """Numbers of a text by class.

    held: how many of the class's distinct words are part of the text. counted: how many matches
    of the class's words, between ends of words, stand one after the other; of words that start
    together the first listed is taken.
    """

    def __init__(self, held: Table, counted: Table):
        import ahocorasick

        uses: dict[str, tuple[list[int], list[tuple[int, int]]]] = {}
        for c, (_, words) in enumerate(held):
            for w in dict.fromkeys(words):
                uses.setdefault(w, ([], []))[0].append(c)
        for c, (_, words) in enumerate(counted):
            for place, w in enumerate(dict.fromkeys(words)):
                uses.setdefault(w, ([], []))[1].append((len(held) + c, place))
        self.size = len(held) + len(counted)
        self.always = uses.pop("", ([], []))[0]  # the empty word is part of every text
        self.automaton = ahocorasick.Automaton()
        for w, (a, b) in uses.items():
            self.automaton.add_word(w, (w, a, b))
        if uses:
            self.automaton.make_automaton()
        self.some = bool(uses)

    def __call__(self, text: str) -> list[int]:
        out = [0] * self.size
        for c in self.always:
            out[c] += 1
        if not self.some:
            return out
        seen, matches = set(), []
        for end, (w, classes, places) in self.automaton.iter(text):
            if classes and w not in seen:
                seen.add(w)
                for c in classes:
                    out[c] += 1
            if places:
                start = end - len(w) + 1
                if _in_word(text, start - 1) != _in_word(text, start) and _in_word(text, end) != _in_word(text, end + 1):
                    matches += [(start, place, end, c) for c, place in places]
        past: dict[int, int] = {}
        for start, _, end, c in sorted(matches):
            if start > past.get(c, -1):
                past[c] = end
                out[c] += 1
        return out


@cache
def scores(held: Table, counted: Table = ()):
    """A function of a text column: array of the classes' numbers, held ones first; null as
    empty. Calls with the same tables share one pass in a plan."""

    @F.pandas_udf(ArrayType(LongType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(held, counted)
        for texts in batches:
            yield pd.Series([scorer(t or "") for t in texts], index=texts.index, dtype=object)

    return run
