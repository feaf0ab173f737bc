"""Redshift values with their measure and type, and bounds."""

from __future__ import annotations

import re

from .bands import AB_FILTERS, VEGA_FILTERS
from .cues import phrases, plain, quick

_LETTERS = "".join(f for f in (*AB_FILTERS, *VEGA_FILTERS) if len(f) == 1)
#: The sign z, unless it is the second band of a colour; then a value, a worded one, or a bound.
_Z = rf"(?<![{_LETTERS}]-)\bz\s*"
_VALUE = r"(\d+\.\d+)"
POINT = rf"{_Z}[=~≈]\s*{_VALUE}"
WORDED = rf"\bredshift\s+(?:of\s+)?{_VALUE}"
BOUND = rf"\bz\s*(?:[≤≥]|[<>]=?|=[<>])\s*{_VALUE}"
_ERROR = re.compile(rf"\s*±\s*{_VALUE}")
_POINT, _WORDED, _BOUND = (re.compile(x, re.I) for x in (POINT, WORDED, BOUND))
#: The same for ASCII texts in lower case.
_QUICK_POINT = re.compile(rf"z(?<!\wz)(?<![{_LETTERS.lower()}]-z)\s*[=~]\s*{_VALUE}")
_QUICK_BOUND = quick(BOUND.removeprefix(r"\b"), "z")
_FAR = ('"', "''", "arcsec", "offset")
UNRELATED = phrases("association|associations unlikely", "association is unlikely", "association very unlikely", "association is very unlikely", "unlikely to be associated", "pcc", "p_cc")
APART = re.compile(r"\d\s*(?:\"|''|arcsec\w*)\s+(?:from|away|offset)|\boffset\s+of\s+\d", re.I)
MEASURES = {"spectroscopic": phrases("spectroscopic|spectroscopy|spectroscopically"), "photometric": phrases("photometric|photometry|photometrically")}
TYPES = {"host": phrases("host"), "emission": phrases("emission line*"), "absorption": phrases("absorption line*")}
LARGEST, REACH = 12.0, 200


def find_redshift(text: str) -> dict | None:
    """The first value, unless it is a z-band magnitude or belongs to some other object."""
    low = plain(text)
    m, error = _QUICK_POINT.search(low) if text.isascii() else _POINT.search(text), None
    if m is None:
        m = _WORDED.search(text) if "redshift" in low else None
    else:
        error = _ERROR.match(text, m.end())
    if m is None or float(m[1]) >= LARGEST:
        return None
    begin, end = m.start(), (error or m).end()
    around = text[max(0, begin - REACH) : end + REACH]
    if UNRELATED.search(around) or (any(x in low for x in _FAR) and APART.search(around)):
        return None
    here = begin - max(0, begin - REACH)
    cues = ((name, cue.search(around)) for name, cue in MEASURES.items())
    near = [(min(abs(c.start() - here), abs(c.end() - here)), k, name) for k, (name, c) in enumerate(cues) if c]
    kind = [name for name, cue in TYPES.items() if cue.search(around)]
    return {"redshift": float(m[1]), "error": float(error[1]) if error else None, "measure": min(near)[2] if near else None, "type": kind[0] if kind else None, "start": begin, "end": end}


def find_bound(text: str) -> dict | None:
    m = _QUICK_BOUND.search(plain(text)) if text.isascii() else _BOUND.search(text)
    return {"phrase": text[m.start() : m.end()], "start": m.start(), "end": m.end()} if m else None
