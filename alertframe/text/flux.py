"""Radio flux densities and X-ray energy fluxes, read as marks: numbers, units, frequencies and the words between them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from .bands import flux_unit, radio_band, row, xray_band
from .cues import last, phrases, plain
from .tables import inside, other_objects

#: A mark is a number, an uncertainty sign, a word or a single sign. U+FFFD stands for a sign that was lost.
_MARK = re.compile(r"(?P<n>\d+(?:\.\d+)?)|(?P<pm>±|\+/[-−–�])|(?P<w>[^\W\d_]+)|(?P<o>[^\w\s])")
_SCIENTIFIC = re.compile(r"(?<![\w.])(\d+(?:\.\d+)?)(?:\s*(?:e|[x×]\s*10\s*\^?)\s*([-+]?\d+))?(?!\w)", re.I)
DENSITY = phrases("flux density|densities")
LIMIT = phrases("upper limit|limits", "upperlimit|upperlimits")
_LEVEL_LIMIT = re.compile(r"\d+(?:\.\d+)?[\s-]*sigma\s+limits?\b", re.I)
COMPARED = phrases("than", "than the", "compared with|to", "compared with|to the", "versus", "versus the", "vs", "vs the")
UNSEEN = phrases("upper limit|limits", "upperlimit|upperlimits", "limit|limits", "not detected", "did not detect", "no significant", "non detection|detections", "nondetection", "no source", "no new source", "no x ray source", "no new x ray source")
LIST = (",", "&", "/", "and")
KEV = {"kev": 1.0, "mev": 1e3, "gev": 1e6}
#: What a unit's first word looks like, and what a text or a line with a radio flux must have.
_UNIT_WORD = re.compile(r"micro|milli|[mμµu]?jy|jansky", re.I)
_JANSKY, _HERTZ, _ERG = (re.compile(x, re.I) for x in ("jy|jansky", "[gm]hz", r"\berg"))
SIGMA, FAINTEST, BRIGHTEST = 3.0, 1e-20, 1e-2


@dataclass
class Mark:
    kind: str  # n, pm, w or o; then what a number is: value, error, frequency or sigma; and unit for a unit's word
    text: str
    start: int
    end: int
    value: float = 0.0
    error: float | None = None


def clauses(text: str) -> Iterator[tuple[int, int]]:
    """Sentences: an end is a stop before a capital or a bracket."""
    begin = 0
    for m in re.finditer(r"[.!?]\s+(?=[A-Z(])", text):
        yield begin, m.end()
        begin = m.end()
    if begin < len(text):
        yield begin, len(text)


def _marks(text: str, begin: int, end: int) -> list[Mark]:
    """A stretch's marks; numbers have been told apart by what stands beside them."""
    out = [Mark(m.lastgroup, m[0], m.start(), m.end()) for m in _MARK.finditer(text, begin, end)]
    for k, m in enumerate(out):  # units first: "micro-Jy" is three marks
        if m.kind == "w" and _UNIT_WORD.match(m.text):
            for size in (3, 2, 1):
                part = out[k : k + size]
                if len(part) == size and part[-1].kind == "w" and (size < 3 or part[1].text == "-") and flux_unit("".join(p.text for p in part)):
                    m.kind, m.text, m.end = "unit", flux_unit("".join(p.text for p in part)), part[-1].end
                    for p in part[1:]:
                        p.kind = "gone"
                    break
    out = [m for m in out if m.kind != "gone"]
    at = lambda k: out[k] if 0 <= k < len(out) else Mark("", "", 0, 0)
    for k in range(len(out) - 1, -1, -1):
        m, after = out[k], at(k + 1)
        if m.kind != "n":
            continue
        m.value = float(m.text)
        low = after.text.lower()
        scale = {"ghz": 1.0, "mhz": 1e-3}.get(low)
        listed = at(k + 2).kind == "frequency" and low in LIST
        if scale is not None:
            m.kind, m.value, m.error = "frequency", m.value * scale, scale
        elif listed:
            m.kind, m.value, m.error = "frequency", m.value * at(k + 2).error, at(k + 2).error
        elif low == "sigma" or (low in ("-", "–") and at(k + 2).text.lower() == "sigma"):
            m.kind = "sigma"
        elif after.kind == "pm" and at(k + 2).kind == "value":
            m.kind, m.error = "value", at(k + 2).value
            at(k + 2).kind = "error"
        else:
            m.kind = "value"
    return out


def _radio(start: int, end: int, m: Mark, unit: str, ghz: float, limit: bool, sigma: float = SIGMA) -> dict:
    known = {"limiting_flux_density": m.value, "limiting_mag_sigma": sigma} if limit else {"flux_density": m.value, "flux_density_error": m.error}
    return row(start, end, flux_density_unit=unit, frequency_ghz=ghz, bandpass=radio_band(ghz), **known)


def _anchors(text: str, begin: int, end: int) -> list[tuple[int, int, bool]]:
    """Where a clause announces flux densities, or limits (upper ones, or at a level): none inside another."""
    found = [(m.start(), m.end(), cue is not DENSITY) for cue in (LIMIT, _LEVEL_LIMIT, DENSITY) for m in cue.finditer(text, begin, end)]
    level = re.compile(r"\d+(?:\.\d+)?[\s-]*sigma\s+$", re.I)
    found = [(begin + head.start() if (head := level.search(text[begin:a])) and limit else a, b, limit) for a, b, limit in found]
    out: list[tuple[int, int, bool]] = []
    for a, b, limit in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b, limit))
    return out


def _compared(text: str, begin: int, at: int) -> bool:
    """Whether the words right before a place compare with something else."""
    cue = last(COMPARED, text, begin, at)
    return cue is not None and not text[cue.end() : at].strip(" .\n\t")


def radio(text: str) -> list[dict]:
    """Clauses with as many values as frequencies, and lines of one measurement, by place."""
    low = plain(text)
    if not (("jy" in low or "jansky" in low) and ("ghz" in low or "mhz" in low)):
        return []
    apart, rows = other_objects(text), []
    for begin, end in clauses(text):
        anchors = _anchors(text, begin, end) if _JANSKY.search(text, begin, end) else []
        for k, (a, b, limit) in enumerate(anchors):
            stop = anchors[k + 1][0] if k + 1 < len(anchors) else end
            if inside(a, apart) or _compared(text, begin, a):
                continue
            marks = [m for m in _marks(text, b, stop) if m.kind != "frequency" or not _compared(text, begin, m.start)]
            units = [m for m in marks if m.kind == "unit"]
            if len({u.text for u in units}) != 1:
                continue
            ghz = [m.value for m in marks if m.kind == "frequency"] or [m.value for m in _marks(text, begin, a) if m.kind == "frequency"]
            values = [m for m in marks if m.kind == "value" and m.start < units[-1].start]
            values = [m for m in values if m.error is not None] or values
            if not values or len(values) != len(ghz):
                continue
            level = next((m.value for m in _marks(text, a, stop) if m.kind == "sigma"), SIGMA)
            rows += [_radio(a, units[-1].end, m, units[-1].text, g, limit, level) for m, g in zip(values, ghz, strict=True)]
    taken = [(r["start"], r["end"]) for r in rows]
    for line in re.finditer(r"[^\n]+", text):
        if _JANSKY.search(line[0]) and _HERTZ.search(line[0]) and (found := _line(text, *line.span())) and not inside(found["start"], apart) and not any(found["start"] < b and a < found["end"] for a, b in taken):
            rows.append(found)
    return sorted(rows, key=lambda r: r["start"])


def _line(text: str, begin: int, end: int) -> dict | None:
    """A line that is one measurement: a frequency and a value with its unit, or a value with its unit at a frequency."""
    marks = _marks(text, begin, end)
    while marks and marks[-1].text in (".", ",", ";"):
        marks.pop()
    shape = ["at" if m.text.lower() == "at" else m.kind if m.kind in ("frequency", "value", "unit") else "" if m.text in ("~", ":", "=", "/") or m.text.lower() in ("ghz", "mhz", "beam") or m.kind in ("pm", "error") else m.text for m in marks]
    limit = any(s in ("<", ">") for s in shape)
    told = [s for s in shape if s and s not in ("<", ">")]
    if told not in (["frequency", "value", "unit"], ["value", "unit", "at", "frequency"]):
        return None
    by = {m.kind: m for m in marks}
    return _radio(marks[0].start, marks[-1].end, by["value"], by["unit"].text, by["frequency"].value, limit)


def _energy_unit(marks: list[Mark]) -> tuple[int, int] | None:
    """The place of a unit of energy per area and time: erg, then cm to the 2 and s in either order, signs between."""
    for k, m in enumerate(marks):
        if m.text.lower() in ("erg", "ergs"):
            for order in (["cm", "2", "s"], ["s", "cm", "2"]):
                wanted, stop = list(order), 0
                for x in marks[k + 1 : k + 14]:
                    t = x.text.lower()
                    if wanted and t == wanted[0]:
                        wanted.pop(0)
                    elif t not in ("/", "^", "-") and not (t == "1" and "s" not in wanted):
                        break
                    if t in ("cm", "2", "s", "1"):
                        stop = x.end
                if not wanted:
                    return m.start, stop
    return None


def _energy_band(marks: list[Mark]) -> tuple[list[float], int, int] | None:
    for low, dash, high, unit in zip(marks, marks[1:], marks[2:], marks[3:], strict=False):
        if dash.text in ("-", "–") and unit.text.lower() in KEV and low.text[0].isdigit() and high.text[0].isdigit():
            return [float(x.text) * KEV[unit.text.lower()] for x in (low, high)], low.start, unit.end
    return None


#: An uncertainty, the power of ten after one, and a number that has one.
_UNCERTAIN = re.compile(r"\(\s*(?:\+/-|[+\-±])[^)]*\)|(?:\+/-|±)\s*[\d.]+(?:e[-+]?\d+)?", re.I)
_POWER = re.compile(r"\s*[x×]\s*10\s*\^?\s*[-+]?\d+")
_POWERED = re.compile(r"\d\s*(?:e|[x×]\s*10\s*\^?)\s*[-+]?\d+\s*$", re.I)


def _blank(text: str, begin: int, end: int) -> str:
    return text[:begin] + " " * (end - begin) + text[end:]


def _number(m: re.Match[str]) -> float:
    return float(f"{m[1]}e{m[2] or 0}")


def xray(text: str) -> list[dict]:
    """One row per clause that states an energy flux (both per area and per time) in an energy band."""
    rows = []
    for begin, end in clauses(text) if "erg" in plain(text) and _ERG.search(text) else ():
        marks = _marks(text, begin, end) if _ERG.search(text, begin, end) else []
        unit = _energy_unit(marks)
        if unit is None:
            continue
        band, head, error = _energy_band(marks), text[: unit[0]], None
        if band and band[1] < unit[0]:
            head = _blank(head, band[1], band[2])
        for m in _UNCERTAIN.finditer(text, begin, unit[0]):
            error, stop = (m if m[0][0] != "(" else None), m.end()
            power = _POWER.match(text, stop)
            if power and error and _POWERED.search(text[begin : m.start()]):  # each has its own power of ten
                stop = power.end()
            head = _blank(head, m.start(), stop)
        head = re.sub(r"\(\s*([\d.]+)\s*\)", lambda m: f" {m[0][1:-1]} ", head)
        numbers = list(_SCIENTIFIC.finditer(head, begin))
        if not numbers:
            continue
        value = _number(numbers[-1])
        if not FAINTEST < abs(value) < BRIGHTEST:
            continue
        size = None
        if error is not None and error.start() > numbers[-1].start():
            size = _number(_SCIENTIFIC.search(error[0].lstrip("+/-± ")))
            size = size * 10.0 ** int(numbers[-1][2] or 0) if size > value else size  # the power of ten counts for both
        kev = band[0] if band else None
        clause = text[begin:end]
        level = next((m.value for m in marks if m.kind == "sigma"), SIGMA)
        known = {"limiting_energy_flux": value, "limiting_mag_sigma": level} if UNSEEN.search(clause) else {"energy_flux": value, "energy_flux_error": size}
        rows.append(row(numbers[-1].start(), unit[1], energy_band_kev=kev, bandpass=xray_band(clause, kev) or xray_band(text, kev), **known))
    return rows
