"""A dictionary of phrases: one pass over a text finds all phrases of all tables, and where they stand.

Phrases are whole words in any script: letters, digits and marks of any alphabet, ``+`` and
``#`` next to a phrase make it part of another word. Blanks and hyphens stand for each other.
The dictionary is one automaton, built once in a task, so its size costs nothing per text;
texts go through it in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HITS = "array<struct<name: string, start: int, stop: int, clause: int, line: int, text: string>>"
#: Characters of text whose hits a task holds in Python at once.
AT_ONCE = 1_000_000
#: Words after a capital at a sentence's begin that leave it a name, and words before a single letter that make it one.
NAME_GOES_ON = {"and", "or", "is", "are", "experience", "knowledge", "skills", "required", "preferred", "programming", "development", "developer", "a"}
LETTER_FOLLOWS, JOINS = {"in", "with", "using", "language", "languages"}, {"and", "or", "like", "of"}


def _one_by_one(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _in_word(c: str) -> bool:
    return c.isalnum() or c in "+#" or unicodedata.category(c)[0] == "M"


class Phrases:
    """Tables of phrases by name. Names in ``cased`` are, where they are phrases themselves, found as they are written (or in capitals) only, and not where
    they begin a sentence as a plain word would; those of one letter only beside another name or in a list."""

    def __init__(self, tables: dict[str, list[str]], cased: set[str] = frozenset()):
        self.tables, self.cased = {n: list(p) for n, p in tables.items()}, set(cased)
        self.order = {n: i for i, n in enumerate(self.tables)}

    def _automaton(self):
        words = ahocorasick.Automaton()
        by: dict[str, list[tuple[str, str]]] = {}
        for name, phrases in self.tables.items():
            for p in phrases:
                p = re.sub(r"[\s-]+", " ", p).strip()
                by.setdefault(_one_by_one(p), []).append((name, p))
        for key, names in by.items():
            words.add_word(key, (len(key), names))
        words.make_automaton()
        return words

    def find(self, text: str, words=None) -> list[dict]:
        """The hits of one text in the order of their ends; ``start`` and ``stop`` count its characters with runs of blanks and hyphens as one."""
        words = words or self._automaton()
        shown = re.sub(r"[\s-]+", lambda m: "\n" if "\n" in m[0] else " ", text)
        flat = _one_by_one(shown).replace("\n", " ")
        out, marks, letters = [], None, []
        for end, (size, names) in words.iter(flat) if flat and self.tables else ():
            start, stop = end + 1 - size, end + 1
            if start and _in_word(flat[start - 1]) or stop < len(flat) and _in_word(flat[stop]):
                continue
            if marks is None:
                marks, breaks = [m.start() for m in re.finditer(r"[,.;:\n]", shown)], [m.start() for m in re.finditer("\n", shown)]
            own = shown[start:stop]
            for name, phrase in names:
                if name in self.cased and phrase == name and not self._as_name(shown, start, stop, phrase):
                    continue
                hit = {"name": name, "start": start, "stop": stop, "clause": bisect_left(marks, start), "line": bisect_left(breaks, start), "text": own}
                (letters if name in self.cased and len(phrase) == 1 else out).append(hit)
        for h in letters:
            before = (re.findall(r"\w+", flat[max(0, h["start"] - 30) : h["start"]]) or [""])[-1]
            listed = before in JOINS or re.search(r"[,/&(] ?$", flat[: h["start"]]) or re.match(r" ?[,/&)]", flat[h["stop"] :])
            beside = any(o["line"] == h["line"] and (-40 <= o["start"] - h["stop"] <= 40 or -40 <= h["start"] - o["stop"] <= 40) for o in out)
            if flat[h["stop"] : h["stop"] + 1] not in ("'", "’") and (before in LETTER_FOLLOWS or listed and beside):
                out.append(h)
        return sorted(out, key=lambda h: (h["stop"], h["start"], self.order[h["name"]])) if letters else out

    @staticmethod
    def _as_name(shown: str, start: int, stop: int, phrase: str) -> bool:
        own = shown[start:stop].replace("\n", " ")
        if own != phrase and not (len(phrase) > 2 and own == phrase.upper()):
            return False
        begins = re.search(r"(?:^|[.!?\n]\s?)$", shown[max(0, start - 2) : start]) is not None
        goes_on = re.match(r" ([a-z]+)", shown[stop : stop + 30])
        return not (begins and goes_on and goes_on[1] not in NAME_GOES_ON)

    def hits(self, text: Column) -> Column:
        """All hits of a text; none of a null one."""
        own = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            return own.found(batches)

        return F.pandas_udf(run, HITS)(text)

    def found(self, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """The hits of all texts in their order, in series of about ``AT_ONCE`` characters: hits take many times the room of their texts, so those of a whole batch are never held."""
        words = self._automaton()
        for texts in batches:
            out, size = [], 0
            for t in texts:
                out.append(self.find(t, words) if t else [])
                size += len(t or "") + 1
                if size >= AT_ONCE:
                    yield pd.Series(out)
                    out, size = [], 0
            if out:
                yield pd.Series(out)


def has(hits: Column, *names: str) -> Column:
    """Whether a phrase of one of the tables was found."""
    return F.exists(hits, lambda h: h["name"].isin(list(names)))


def near(hits: Column, first: str, then: str, most: int | None = None, within: str = "line") -> Column:
    """Whether a phrase of ``then`` begins at most so many characters after one of ``first``, in the same ``line`` or ``clause``."""

    def follows(a: Column, b: Column) -> Column:
        ok = (b["name"] == then) & (b["start"] >= a["stop"]) & (b[within] == a[within])
        return ok if most is None else ok & (b["start"] - a["stop"] <= most)

    return F.exists(hits, lambda a: (a["name"] == first) & F.exists(hits, lambda b: follows(a, b)))


def first_of(hits: Column, names: dict[str, str]) -> Column:
    """The value of the first table, in their order, of which a phrase was found."""
    return F.coalesce(*[F.when(has(hits, n), F.lit(v)) for n, v in names.items()], F.lit(None).cast("string"))


def named(hits: Column, names: list[str]) -> Column:
    """Those of ``names`` that were found, in their order."""
    found = F.transform(hits, lambda h: h["name"])
    return F.array_intersect(F.array(*map(F.lit, names)), found) if names else F.expr("CAST(array() AS array<string>)")
