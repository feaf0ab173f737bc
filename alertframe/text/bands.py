"""Filters, magnitude systems, bandpasses and flux units: fixed values and their lookups."""

from __future__ import annotations

import math
import re

from .cues import phrases, plain

# Filter spellings, their systems and their canonical bandpasses.
PRIMES = "'’ʹ′"
FILTER = rf"(?:F\d{{3}}[A-Z]{{1,2}}|VT_[BR]|uvw1|uvw2|uvm2|white|unfiltered|clear|CR|CV|[UBVRI]c|[ugriz][p{PRIMES}]|[UBVRIJHKgrizyuCW]s?)"
AB_FILTERS = ("u", "g", "r", "i", "z", "y")
VEGA_FILTERS = ("U", "B", "V", "R", "I", "J", "H", "K", "Ks")
OTHER_FILTERS = ("F450W", "F555W", "F606W", "F702W", "F775W", "F814W", "F850LP", "F160W", "F110W", "uvw1", "uvw2", "uvm2", "white", "VT_B", "VT_R", "unfiltered", "clear", "CR", "CV", "C", "W", "Rc", "Ic")
BANDPASSES = {
    "u": "sdssu", "g": "sdssg", "r": "sdssr", "i": "sdssi", "z": "sdssz", "y": "ps1::y",
    "U": "bessellu", "B": "bessellb", "V": "bessellv", "R": "bessellr", "I": "besselli", "Rc": "bessellr", "Ic": "besselli",
    "uvw1": "uvot::uvw1", "uvw2": "uvot::uvw2", "uvm2": "uvot::uvm2", "white": "uvot::white",
    "VT_B": "svomvtb", "VT_R": "svomvtr",
    "F555W": "f555w", "F606W": "f606w", "F775W": "f775w", "F850LP": "f850lp", "F110W": "f110w", "F125W": "f125w", "F160W": "f160w",
    "J": "2massj", "H": "2massh", "K": "2massks", "Ks": "2massks",
}
RADIO_GHZ = {
    "radio-0.34GHz": 0.34, "radio-1.4GHz": 1.4, "radio-3GHz": 3.0, "radio-6GHz": 6.0, "radio-10GHz": 10.0, "radio-15GHz": 15.0, "radio-22GHz": 22.0,
    "radio-33GHz": 33.0, "radio-45GHz": 45.0, "radio-93GHz": 93.0, "radio-95GHz": 95.0, "sma-230GHz": 230.0, "sma-345GHz": 345.0, "sma-400GHz": 400.0,
}
RADIO_RATIO = 1.5
UJY = {"uJy": 1.0, "mJy": 1e3, "Jy": 1e6}
XRAY_INSTRUMENTS = {
    "epwxt": r"EP[-/\s]?WXT|\bWXT\b", "epfxt": r"EP[-/\s]?FXT|\bFXT\b", "svommxt": r"SVOM[-/\s]?MXT|\bMXT\b", "svomeclairs": r"ECLAIRs",
    "svomgrm": r"SVOM[-/\s]?GRM|\bGRM\b", "swiftxrt": r"Swift[-/\s]?XRT|\bXRT\b", "nicerxti": r"NICER|\bXTI\b", "swiftbat": r"Swift[-/\s]?BAT|\bBAT\b",
    "fermigbm": r"Fermi[-/\s]?GBM|\bGBM\b", "fermilat": r"Fermi[-/\s]?LAT|\bLAT\b", "konus": r"Konus[-\s]?Wind|\bKonus\b", "integralacs": r"SPI[-/\s]?ACS",
    "integralibis": r"IBIS[/\s]?ISGRI|\bISGRI\b|\bIBIS\b", "integraljemx": r"JEM[-\s]?X", "caletcgbm": r"CGBM|\bCALET\b", "nustar": r"NuSTAR", "maxigsc": r"MAXI[-/\s]?GSC|\bMAXI\b",
}
_XRAY = {b: (re.compile(p, re.I), tuple(max(re.findall("[a-z]+", x.lower().replace("\\b", " ").replace("\\s", " ")), key=len) for x in p.split("|"))) for b, p in XRAY_INSTRUMENTS.items()}
SOFT_XRAY = (0.2, 12.4, "swiftxrt")

KNOWN = frozenset((*AB_FILTERS, *VEGA_FILTERS, *OTHER_FILTERS))


_PLAIN = {f + "c": f for f in "UBVRI"} | {f + p: f for f in "ugriz" for p in "p" + PRIMES}
_SYSTEMS = {s: phrases(f"{s} mag|mags|magnitude|magnitudes|system|photometric", *(f"magnitude|magnitudes {x} {s}" for x in ("in", "in the", "are in", "are in the", "are|given|reported|calibrated in", "are given|reported|calibrated in", "are given|reported|calibrated in the"))) for s in ("AB", "Vega")}


def folded(name: str) -> str:
    """Rc is R, and r' is r."""
    return _PLAIN.get(name, name)


def system_of(name: str) -> str | None:
    return "AB" if name in AB_FILTERS else "Vega" if name in VEGA_FILTERS else None


def stated_system(text: str) -> str | None:
    """The one magnitude system that the text names, in words or in brackets."""
    low = plain(text)
    if "vega" not in low and not ("a" in low and "b" in low):
        return None
    squeezed = "".join(text.split()).lower()
    named = [s for s, cue in _SYSTEMS.items() if f"({s.lower()})" in squeezed or (s.lower() in low and cue.search(text))]
    return named[0] if len(named) == 1 else None


def plausible(name: str, mag: float) -> bool:
    """Brighter or fainter than any source; z below 10 is a redshift."""
    return 5.0 < mag < 30.0 if name != "z" else 10.0 <= mag < 30.0


def radio_band(ghz: float) -> str | None:
    """The nearest centre on a log scale, if it is near enough."""
    if ghz <= 0:
        return None
    name = min(RADIO_GHZ, key=lambda b: abs(math.log(ghz / RADIO_GHZ[b])))
    return name if abs(math.log(ghz / RADIO_GHZ[name])) <= math.log(RADIO_RATIO) else None


def flux_unit(written: str) -> str | None:
    w = re.sub(r"[\s-]", "", written).lower()
    if w in ("jy", "jansky"):
        return "Jy"
    if w in ("mjy", "millijy", "millijansky"):
        return "mJy"
    return "uJy" if w in ("microjy", "ujy", "μjy", "µjy", "microjansky") else None


def xray_band(text: str, band: list[float] | None) -> str | None:
    """By the first instrument named, else by the energy range if it mostly lies in the soft band."""
    low = plain(text)
    named = {b: m.start() for b, (form, letters) in _XRAY.items() if any(x in low for x in letters) and (m := form.search(text))}
    if named:
        return min(named, key=named.__getitem__)
    if band and band[1] > band[0]:
        low, high, name = SOFT_XRAY
        if (min(high, band[1]) - max(low, band[0])) / (band[1] - band[0]) >= 0.5:
            return name
    return None


PHOTOMETRY = (
    "filter", "bandpass", "mag", "mag_error", "mag_system", "limiting_mag", "limiting_mag_sigma", "flux_density", "flux_density_error", "limiting_flux_density", "flux_density_unit",
    "frequency_ghz", "energy_flux", "energy_flux_error", "limiting_energy_flux", "energy_band_kev", "obs_mjd", "obs_time", "telescope", "telescope_canonical", "instrument",
    "instrument_canonical", "calibration_reference", "galactic_extinction_corrected", "seeing", "airmass", "is_detection",
)


def row(start: int, end: int, **known: object) -> dict:
    return dict.fromkeys(PHOTOMETRY) | known | {"start": start, "end": end}


def optical(start: int, end: int, name: str, **known: object) -> dict:
    return row(start, end, filter=name, bandpass=BANDPASSES.get(name), mag_system=system_of(name), **known)
