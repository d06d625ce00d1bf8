"""Many patterns in one pass over a text: an Aho-Corasick automaton of the literals that they hold says which of them can match at all."""

from __future__ import annotations

import re
from re import _constants as kinds
from re import _parser as parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(pattern: str) -> str:
    """The longest run of characters that every match of the pattern holds; empty where there is none to see."""
    parsed = parser.parse(pattern)
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ""
    best, run = "", ""

    def walk(parts) -> None:
        nonlocal best, run
        for kind, value in parts:
            if kind is kinds.LITERAL:
                run += chr(value)
                best = max(best, run, key=len)
                continue
            if kind is kinds.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
                continue
            run = ""
            if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
                walk(value[2])  # once at least
                run = ""

    walk(parsed)
    return best


class Patterns:
    """Patterns with a name each; which names a text fits."""

    def __init__(self, named: dict[str, str]):
        self.compiled = [(re.compile(p), name) for p, name in named.items()]
        self.always, reached = [], {}
        for n, p in enumerate(named):
            if (held := literal(p)) != "":
                reached.setdefault(held, []).append(n)
            else:
                self.always.append(n)
        #: Patterns that are their literal match where it stands.
        self.plain = {n for n, p in enumerate(named) if literal(p) == p}
        self.automaton = ahocorasick.Automaton()
        for held, numbers in reached.items():
            self.automaton.add_word(held, numbers)
        if reached:
            self.automaton.make_automaton()
        self.empty = not reached

    def names(self, text: str) -> list[str]:
        """The names of the patterns that match somewhere in the text, each once, in the order of the patterns."""
        some = set(self.always)
        if not self.empty:
            for _, numbers in self.automaton.iter(text):
                some.update(numbers)
        return list(dict.fromkeys(self.compiled[n][1] for n in sorted(some) if n in self.plain or self.compiled[n][0].search(text)))


def names(text: Column, named: dict[str, str]) -> Column:
    """The names of the patterns (pattern -> name) that match in text, each once; a null text has none. One pass over the text whatever the number of patterns, in Arrow batches."""
    made: list[Patterns] = []  # one for each worker

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Patterns(named))
        return pd.Series([[] if t is None else made[0].names(t) for t in texts], dtype=object)

    return found(text)
