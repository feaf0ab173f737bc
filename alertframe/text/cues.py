"""Cue phrases and the clauses they stand in: what the parsers judge a value's surroundings by."""

from __future__ import annotations

import re
from collections.abc import Iterable

_STOP = re.compile(r"[.!?](?=\s|$)|\n\s*\n")


def pattern(*listed: str) -> str:
    """A regular expression, Python's and Java's alike, for any of the phrases: words with anything but letters and digits
    between them; * is any ending, | a choice."""

    def word(w: str) -> str:
        return "(?:" + "|".join(re.escape(x).replace(r"\*", r"\w*") for x in w.split("|")) + ")"

    forms = sorted((p.split() for p in listed), key=len, reverse=True)
    return r"(?<!\w)(?:" + "|".join(r"\W+".join(map(word, f)) for f in forms) + r")(?!\w)"


#: Letters that count as ASCII ones where case doesn't.
_ODD = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")


def plain(text: str) -> str:
    """A text in lower case: what it lacks, no search without regard to case can find in the text."""
    return text.lower() if text.isascii() else text.translate(_ODD).lower()


def _needed(listed: Iterable[str]) -> tuple[str, ...]:
    """Words, in lower case, of which a text must contain one to have any of the phrases: of each its longest word."""
    words = {x.rstrip("*").lower() for p in listed for x in max((w.split("|") for w in p.split()), key=lambda xs: min(len(x.rstrip("*")) for x in xs))}
    return tuple(sorted(w for w in words if not any(v != w and v in w for v in words)))


class Cue:
    """The phrases as a pattern that is run only on texts with a word they need, as most texts have none."""

    def __init__(self, *listed: str) -> None:
        self.form, self.needed = re.compile(pattern(*listed), re.I), _needed(listed)
        self.words = [[[x.rstrip("*").lower() for x in w.split("|")] for w in p.split()] for p in listed]

    def _absent(self, text: str) -> bool:
        low = plain(text)
        for w in self.needed:  # noqa: SIM110 (a generator takes twice the time)
            if w in low:
                return not any(all(any(x in low for x in xs) for xs in p) for p in self.words)
        return True

    def search(self, text: str, begin: int = 0, end: int | None = None) -> re.Match[str] | None:
        end = len(text) if end is None else end
        return None if self._absent(text[max(0, begin) : max(0, end)]) else self.form.search(text, begin, end)

    def finditer(self, text: str, begin: int = 0, end: int | None = None) -> Iterable[re.Match[str]]:
        end = len(text) if end is None else end
        return () if self._absent(text[max(0, begin) : max(0, end)]) else self.form.finditer(text, begin, end)


def phrases(*listed: str) -> Cue:
    return Cue(*listed)


def quick(form: str, prefix: str) -> re.Pattern[str]:
    """form, which begins with prefix at a word's beginning, for ASCII texts in lower case: found by its prefix."""
    assert form.startswith(prefix)
    p = prefix.lower()
    return re.compile(rf"{p}(?<!\w{p}){form[len(prefix):].lower()}")


def clause(text: str, at: int) -> tuple[int, int]:
    """Where the sentence or paragraph around a place begins and ends."""
    begin = max((m.end() for m in _STOP.finditer(text, 0, at)), default=0)
    end = _STOP.search(text, at)
    return begin, end.start() if end else len(text)


def words_between(text: str, begin: int, end: int) -> int:
    return len(re.findall(r"\w+", text[begin:end]))


def last(cue: Cue | re.Pattern[str], text: str, begin: int, end: int) -> re.Match[str] | None:
    """A cue's last hit that ends within a stretch."""
    found = None
    for found in cue.finditer(text, max(0, begin), end):  # noqa: B007
        pass
    return found
