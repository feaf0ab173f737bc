"""Sky positions: labelled pairs, error boxes and single-candidate tables."""

from __future__ import annotations

import re

from .cues import last, phrases, plain, quick

#: U+FFFD stands in for unit signs that were lost.
_LOST = "\ufffd"
_EPOCH = r"(?:\s*\((?:J2000(?:\.0)?|ICRS|FK5)\))?"
_RA = rf"R\.?\s?A\.?{_EPOCH}"
_RA_LABEL, _QUICK_RA = re.compile(rf"\b{_RA}", re.I), quick(_RA, "R")
_DEC_LABEL = re.compile(rf"\bDecl?\.?{_EPOCH}", re.I)
_NUMBER = re.compile(r"([+\-−]?)(\d{1,3})(\.\d+)?")
_SPACED = re.compile(r"\s+(\d{1,2})\s+(\d{1,2}(?:\.\d+)?)")
_MARKED = {
    unit: re.compile(rf"[{signs}:{_LOST}]+\s*(\d{{1,2}})[m':{_LOST}]+(?:\s*(\d{{1,2}}(?:\.\d+)?)[s\"{_LOST}]*)?", re.I) for unit, signs in (("h", "h"), ("d", "d°"))
}
OTHER_OBJECT = phrases("host|nearby|neighbouring|neighboring|foreground|companion galaxy|galaxies", "galaxy candidate", "reference|comparison|field|standard star|stars", "field of view", "fov", "boresight*", "latitude|longitude")
THE_TRANSIENT = phrases("afterglow", "counterpart", "transient", "burst", "source", "position|positions", "detected", "optical", "x ray", "radio")
BOX_CENTRE = re.compile(r"Center:\s*\n\s*(?P<ra>\d{1,3}\.\d+)\s*(?:\([^)]*\))?\s*(?P<dec>[+\-−]?\d{1,2}\.\d+)", re.I)
_SIZE = r"\s+(\d+(?:\.\d+)?)\s*(deg|arcmin)"
BOX_LONG, BOX_SHORT = re.compile(rf"maximum\s+dimension\s+is{_SIZE}", re.I), re.compile(rf"[^.]{{0,60}}?minimum\s+one\s+is{_SIZE}", re.I)
REACH = 160


def _angle(text: str, at: int, unit: str) -> tuple[list[float], bool, int] | None:
    """The parts of a coordinate (one, or whole units with minutes and seconds), whether it is negative, and its end."""
    head = _NUMBER.match(text, at)
    if head is None or (head[1] and unit == "h"):
        return None
    parts, end = [float(head[2] + (head[3] or ""))], head.end()
    if not head[3] and len(head[2]) < 3 and (more := _MARKED[unit].match(text, end) or _SPACED.match(text, end)):
        parts, end = parts + [float(x) for x in more.groups() if x], more.end()
    return parts, head[1] in ("-", "−"), end


_COMMA, _COMMA_ONLY, _EQUALS, _CLOSED = (re.compile(x) for x in (r"(?:\s*,\s*)?", r"\s*,?\s*", r"\s*[=:]?\s*", r"\s*\)?\s*[=:]?\s*"))


def _gap(text: str, at: int, form: re.Pattern[str]) -> int:
    return form.match(text, at).end()


def degrees(ra: list[float], dec: list[float], south: bool) -> tuple[float, float] | None:
    """Parts in degrees. One sexagesimal coordinate makes the right ascension an hour angle."""
    r, d = (sum(p / 60.0**k for k, p in enumerate(x)) for x in (ra, dec))
    r, d = r * (15.0 if max(len(ra), len(dec)) > 1 else 1.0), -d if south else d
    return (r, d) if 0 <= r <= 360 and -90 <= d <= 90 else None


def _owned(text: str, at: int) -> bool:
    """Whether the nearest anchor before the place, if there is one, is about the transient."""
    other = last(OTHER_OBJECT, text, at - REACH, at)
    return other is None or ((own := last(THE_TRANSIENT, text, at - REACH, at)) is not None and own.start() > other.start())


Pair = tuple[list[float], list[float], bool, int]


def _together(text: str, label: re.Match[str]) -> Pair | None:
    """Both coordinates after both labels: "RA, Dec = x, y"."""
    both = _DEC_LABEL.match(text, _gap(text, label.end(), _COMMA))
    if both is None:
        return None
    ra = _angle(text, _gap(text, both.end(), _CLOSED), "h")
    dec = _angle(text, _gap(text, ra[2], _COMMA_ONLY), "d") if ra else None
    return (ra[0], dec[0], dec[1], dec[2]) if dec else None


def _apart(text: str, label: re.Match[str]) -> Pair | None:
    """Each coordinate after its label: "RA = x ... Dec = y", at most 40 signs apart."""
    ra = _angle(text, _gap(text, label.end(), _EQUALS), "h")
    there = _DEC_LABEL.search(text, ra[2], ra[2] + 60) if ra else None
    if there is None or there.start() - ra[2] > 40:
        return None
    dec = _angle(text, _gap(text, there.end(), _EQUALS), "d")
    return (ra[0], dec[0], dec[1], dec[2]) if dec else None


def find_pair(text: str) -> dict | None:
    """The transient's first pair with a label each, as refined positions are given; else the first with both labels before."""
    labels = list(_QUICK_RA.finditer(text.lower()) if text.isascii() else _RA_LABEL.finditer(text))
    for form in (_apart, _together):
        for label in labels:
            found = form(text, label)
            if found and _owned(text, label.start()) and (pair := degrees(*found[:3])):
                return {"ra": pair[0], "dec": pair[1], "error": None, "names": [], "start": label.start(), "end": found[3]}
    return None


def find_error_box(text: str) -> dict | None:
    """Centre, and half the stated dimensions in degrees."""
    m = BOX_CENTRE.search(text) if "center:" in plain(text) else None
    if m is None:
        return None
    ra, dec = float(m["ra"]), float(m["dec"].replace("−", "-"))
    if not (0 <= ra <= 360 and -90 <= dec <= 90):
        return None
    long = BOX_LONG.search(text)
    sizes = [x for x in (long, BOX_SHORT.match(text, long.end()) if long else None) if x]
    error = [float(x[1]) / (120.0 if x[2].lower() == "arcmin" else 2.0) for x in sizes]
    return {"ra": ra, "dec": dec, "error": error or None, "names": [], "start": m.start(), "end": m.end()}


def find_position(text: str) -> dict | None:
    """A labelled pair, else an error box, else the one candidate of a table."""
    from .tables import find_candidate

    return find_pair(text) or find_error_box(text) or find_candidate(text)
