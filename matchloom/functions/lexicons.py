"""Lexicons of any size: all terms found in one pass over a text.

An Aho-Corasick automaton is built once per Python worker and applied to Arrow batches, so
the time of a text and the size of the plan do not grow with the lexicon. The terms travel
with the function; a lexicon is a parameter, whose size does not depend on the tables.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT = 4  # automata a worker keeps
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, terms: Sequence[str]) -> ahocorasick.Automaton:
    """Finds every occurrence of every term; its value is the term's place in the list."""
    if name not in _built:
        found = ahocorasick.Automaton()
        for n, term in enumerate(terms):
            found.add_word(term, n)
        found.make_automaton()
        while len(_built) >= KEPT:
            del _built[next(iter(_built))]
        _built[name] = found
    return _built[name]


def _finder(terms: Sequence[str], pick: Callable[[str, ahocorasick.Automaton, Sequence[str]], list[str]]):
    """A function of a text column without NULL."""
    unique = list(dict.fromkeys(t for t in terms if t))
    name = hashlib.sha256("\0".join(unique).encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if unique:
            machine = _automaton(name, unique)
        for texts in batches:
            yield texts.map(lambda t: pick(t, machine, unique) if unique else [])

    return find


def _anywhere(text: str, machine: ahocorasick.Automaton, terms: Sequence[str]) -> list[str]:
    return [terms[n] for n in sorted({n for _, n in machine.iter(text)})]


def substrings(text: Column, terms: Sequence[str]) -> Column:
    """Terms that occur anywhere in the text, in the order of the list, each once; an empty term occurs in all."""
    found = _finder(terms, _anywhere)(F.coalesce(text, F.lit("")))
    unique = list(dict.fromkeys(terms))
    if "" not in unique:
        return found
    before = [t for t in unique[:unique.index("")]]
    first = F.filter(found, lambda t: t.isin(before)) if before else F.array().cast("array<string>")
    return F.concat(first, F.array(F.lit("")), F.array_except(found, first))


def _letter(char: str) -> bool:
    kind = unicodedata.category(char)
    return kind[0] == "L" or kind == "Nd"


def _word(text: str, at: int) -> bool:
    """Whether a word reaches over place ``at``, as ``\\b`` of the JVM has it: letters, digits and ``_`` do, and
    marks above a letter or digit of the basic plane."""
    if text[at] == "_" or _letter(text[at]):
        return True
    while at >= 0 and text[at] < "\U00010000" and unicodedata.category(text[at]) == "Mn":
        at -= 1
        if at >= 0 and text[at] < "\U00010000" and _letter(text[at]):
            return True
    return False


def _edge(text: str, at: int) -> bool:
    return (at > 0 and _word(text, at - 1)) != (at < len(text) and _word(text, at))


def _whole(text: str, machine: ahocorasick.Automaton, terms: Sequence[str]) -> list[str]:
    """Leftmost occurrences that do not overlap; of those that begin at one place, the term listed first."""
    best: dict[int, int] = {}
    for end, n in machine.iter(text):
        start = end + 1 - len(terms[n])
        if best.get(start, n) >= n and _edge(text, start) and _edge(text, end + 1):
            best[start] = n
    out: dict[str, None] = {}
    free = 0
    for start in sorted(best):
        if start >= free:
            out[terms[best[start]]] = None
            free = start + len(terms[best[start]])
    return list(out)


def whole_words(text: Column, terms: Sequence[str]) -> Column:
    """Terms that stand as whole words in the text, in the order of the text, each once."""
    return _finder(terms, _whole)(F.coalesce(text, F.lit("")))
