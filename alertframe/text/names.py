"""Event names, bulletin cross references, retractions and telescopes."""

from __future__ import annotations

import re
from functools import cache

from .cues import Cue, pattern, plain, quick

# The designations that count as event names, all matched without regard to case.
EVENT_FORMS = (
    r"GRB\s?\d{6}[A-Z]?",
    r"EP\s?\d+[A-Z]?",
    r"AT\s?\d{4}[a-z]+",
    r"SN\s?\d{4}[a-z]+",
    r"AT\s?\d{2,4}[A-Z]",
    r"SN\s?\d{2,4}[A-Z]",
    r"ZTF\d{2}[a-z]+",
    r"ATLAS\s?-?\d{2}[a-z]+",
    r"ASASSN[-\s]?\d{2}[a-z]+",
    r"PS\d{2}[a-z]+",
    r"Pan-?STARRS\s?\d{2}[a-z]+",
    r"GOTO\s?\d{2}[a-z]+",
    r"ICECUBE\s?-?\d+[A-Z]?",
    r"SWIFT\s?J\d+(?:\.\d+)?[+-]\d+(?:\.\d+)?",
    r"GW\s?\d{6}[a-z]?",
)
# Fixed value: how one bulletin cites another.
XREF = r"\bGCN\s*(?:Circ(?:ular|\.)?\s*)?#?\s*(\d{1,18})\b"
# What a subject line says when it withdraws a report.
WITHDRAWN = (
    "is not a grb|burst|real|astrophysical", "not astrophysical", "not of astrophysical origin", "not a real event|source|transient", "probably a noise*", "consistent with noise*",
    "retract|retracts|retracted|retracting|retraction", "spurious", "no longer believe*",
)
RETRACTION = pattern(*WITHDRAWN)
# Telescopes and instruments, and the ways they are written.
TELESCOPES = {
    "VLT": ["VLT", "ESO VLT", "ESO-VLT", "Very Large Telescope", "the VLT", "VLT/X-shooter", "VLT/FORS2"],
    "NOT": ["NOT", "Nordic Optical Telescope"],
    "GTC": ["GTC", "Gran Telescopio Canarias", "GTC/OSIRIS"],
    "Gemini-North": ["Gemini North", "Gemini-N", "GN"],
    "Gemini-South": ["Gemini South", "Gemini-S", "GS"],
    "Keck": ["Keck", "Keck I", "Keck II", "Keck-I", "Keck-II"],
    "Subaru": ["Subaru", "Subaru Telescope"],
    "ZTF": ["ZTF", "Zwicky Transient Facility", "P48", "Palomar 48-inch"],
    "ATLAS": ["ATLAS", "Asteroid Terrestrial-impact Last Alert System"],
    "Pan-STARRS": ["Pan-STARRS", "PanSTARRS", "PS1", "Pan-STARRS1"],
    "GOTO": ["GOTO", "Gravitational-wave Optical Transient Observer"],
    "Swift": ["Swift", "Swift/UVOT", "Neil Gehrels Swift Observatory"],
    "LDT": ["LDT", "Lowell Discovery Telescope", "DCT", "Discovery Channel Telescope"],
    "LCO": ["LCO", "LCOGT", "Las Cumbres Observatory"],
    "TNG": ["TNG", "Telescopio Nazionale Galileo"],
    "WHT": ["WHT", "William Herschel Telescope"],
    "CAHA": ["CAHA", "Calar Alto"],
    "SVOM/VT": ["VT", "SVOM/VT", "SVOM VT"],
    "COLIBRI": ["COLIBRI", "COLIBRI-VIS", "COLIBRI/VIS"],
}
INSTRUMENTS = {
    "X-shooter": ["X-shooter", "XSHOOTER", "VLT/X-shooter"],
    "FORS2": ["FORS2", "VLT/FORS2"],
    "OSIRIS": ["OSIRIS", "GTC/OSIRIS"],
    "ALFOSC": ["ALFOSC", "NOT/ALFOSC"],
    "GMOS": ["GMOS", "GMOS-N", "GMOS-S"],
    "DEIMOS": ["DEIMOS", "Keck/DEIMOS"],
    "LRIS": ["LRIS", "Keck/LRIS"],
    "FOCAS": ["FOCAS", "Subaru/FOCAS"],
    "UVOT": ["UVOT", "Swift/UVOT"],
}

_XREF, _QUICK_XREF = re.compile(XREF, re.I), quick(XREF.removeprefix(r"\b"), "GCN")
_RETRACTION = Cue(*WITHDRAWN)
_FORMS = [re.compile(rf"\b(?:{f})\b", re.I) for f in EVENT_FORMS]
#: The same for ASCII texts in lower case, with the letters that each begins with.
_QUICK = [(p.lower(), quick(rf"{f}\b", p)) for f in EVENT_FORMS for p in (re.match("[A-Za-z]+", f)[0],)]


def clean(text: str | None) -> str:
    return (text or "").replace("\0", " ").strip()


def normal(name: str | None) -> str | None:
    """Upper case without white space; none for nothing."""
    return "".join(name.split()).upper() if name else None


def find_events(text: str) -> list[dict]:
    """Distinct names in order of place (a form's place in EVENT_FORMS breaks ties)."""
    low = plain(text)
    if text.isascii():
        hits = sorted((m.start(), k, m.end()) for k, (begin, form) in enumerate(_QUICK) if begin in low for m in form.finditer(low))
    else:
        hits = sorted((m.start(), k, m.end()) for k, form in enumerate(_FORMS) if _QUICK[k][0] in low for m in form.finditer(text))
    out: dict[str, dict] = {}
    for start, _, end in hits:
        name = normal(text[start:end])
        out.setdefault(name, {"name": name, "start": start, "end": end})
    return list(out.values())


def name_event(event_id: str | None, subject: str | None, body: str | None) -> dict:
    """The primary name and all names, from the first of event id, subject and body that has any.

    An event id is returned as written and stands alone; start and end are places in the cleaned source.
    """
    given = clean(event_id)
    if given:
        return {"primary": given, "names": [normal(given)], "source": "eventId", "start": -1, "end": -1}
    for source, text in (("subject", clean(subject)), ("body", clean(body))):
        if found := find_events(text):
            return {"primary": found[0]["name"], "names": [f["name"] for f in found], "source": source, "start": found[0]["start"], "end": found[0]["end"]}
    return {"primary": None, "names": [], "source": "none", "start": -1, "end": -1}


def find_xrefs(text: str) -> list[dict]:
    """Cited bulletins, each at its first place."""
    out: dict[int, dict] = {}
    low = plain(text)
    for m in () if "gcn" not in low else _QUICK_XREF.finditer(low) if text.isascii() else _XREF.finditer(text):
        out.setdefault(int(m[1]), {"id": int(m[1]), "start": m.start(), "end": m.end()})
    return list(out.values())


def is_retraction(subject: str | None) -> bool:
    return bool(subject) and _RETRACTION.search(subject) is not None


@cache
def _canonical(kind: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, aliases in {"telescope": TELESCOPES, "instrument": INSTRUMENTS}[kind].items():
        for a in (name, *aliases):
            out.setdefault(a.strip().lower(), name)
    return out


def canonical(kind: str, written: str | None) -> str | None:
    return _canonical(kind).get(written.strip().lower()) if written else None


@cache
def _known() -> tuple[re.Pattern[str], list[tuple[str, list[str]]], list[tuple[str, list[str]]]]:
    """Telescopes' names as one pattern, and those in capitals and the others in lower case by the shortest that they have in them."""
    spelt = sorted({a for n, more in TELESCOPES.items() for a in (n, *more) if len(a) > 2}, key=lambda a: (-len(a), a))
    capitals, others = ("|".join(re.escape(a) for a in spelt if a.isupper() is upper) for upper in (True, False))
    form = re.compile(rf"\b(?:(?:{capitals})|(?i:{others}))\b")  # capitals as they are: else NOT would be any "not"
    roots: tuple[dict[str, list[str]], dict[str, list[str]]] = ({}, {})
    for a in spelt:
        own, name = roots[not a.isupper()], a if a.isupper() else a.lower()
        alike = [b if b.isupper() else b.lower() for b in spelt if b.isupper() is a.isupper()]
        own.setdefault(min((b for b in alike if b in name), key=len), []).append(name)
    return form, list(roots[0].items()), list(roots[1].items())


def _first_known(text: str) -> tuple[int, int] | None:
    """The first telescope's name; in ASCII texts each name is looked for by itself."""
    form, capitals, others = _known()
    if not text.isascii():
        m = form.search(text)
        return m.span() if m else None
    hits: list[tuple[int, int, int]] = []  # place, capitals first, the longest first
    for k, (hay, groups) in enumerate(((text, capitals), (text.lower(), others))):
        for a in (a for root, names in groups if root in hay for a in names):
            at = hay.find(a)
            while at >= 0 and (_inner(hay, at - 1) or _inner(hay, at + len(a))):
                at = hay.find(a, at + 1)
            if at >= 0:
                hits.append((at, k, -len(a)))
    first = min(hits, default=None)
    return (first[0], first[0] - first[2]) if first else None


def _inner(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


_SCOPE, _QUICK_SCOPE = re.compile(r"\b(?:telescope|observatory)\b", re.I), re.compile(r"\b(?:telescope|observatory)\b")


def _described(text: str) -> tuple[int, int] | None:
    """The name in "with the ... telescope": up to five words, capitals, numbers, of and de, back to a preposition's "the"."""
    low = plain(text)
    for m in () if "telescope" not in low and "observatory" not in low else _QUICK_SCOPE.finditer(low) if text.isascii() else _SCOPE.finditer(text):
        before = list(re.finditer(r"[\w.+'\"-]+", text[max(0, m.start() - 120) : m.start()]))
        base, k = max(0, m.start() - 120), len(before)
        while k and len(before) - k < 5 and before[k - 1][0].lower() != "the" and (before[k - 1][0][0].isalnum() or before[k - 1][0] in ("of", "de")):
            k -= 1
        if 1 < k < len(before) and before[k - 1][0].lower() == "the" and before[k - 2][0].lower() in ("with", "at", "using", "on", "from"):
            return base + before[k].start(), base + before[-1].end()
    return None


def find_telescope(text: str) -> dict | None:
    """A known name, or what stands in "with the ... telescope" if that comes first and apart from it."""
    known, named = _first_known(text), _described(text)
    if known and (not named or known[0] <= named[1]):
        a, b = known
    elif named:
        a, b = named
    else:
        return None
    name = text[a:b].strip()
    return {"name": name[4:] if name.lower().startswith("the ") else name, "start": a, "end": b}
