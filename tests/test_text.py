"""Parsers on single texts."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from alertframe.operators.extract import extract_text
from alertframe.text import bands, classes, flux, names, positions, redshifts, tables, times

T0 = datetime(2024, 1, 1)


def test_event_names():
    got = names.find_events("GRB 240101A and at2024abc, SN 2020X, grb240101a, SWIFT J1234.5+67")
    assert [g["name"] for g in got] == ["GRB240101A", "AT2024ABC", "SN2020X", "SWIFTJ1234.5+67"]
    assert names.name_event(" GRB 1 ", "GRB 240101A", "")["primary"] == "GRB 1"
    assert names.name_event(None, "EP240617a: seen", "GRB 240101A")["names"] == ["EP240617A"]
    assert names.name_event("", None, "of GW170817 and AT2017gfo")["names"] == ["GW170817", "AT2017GFO"]
    assert names.name_event(None, None, None)["source"] == "none"
    assert [x["id"] for x in names.find_xrefs("GCN 12, GCN Circ. #33, gcn circular 12")] == [12, 33]


@pytest.mark.parametrize(("subject", "want"), [("Retraction of GRB 1", True), ("EP trigger is not a burst", True), ("GRB 240101A: spurious", True), ("GRB 240101A: optical", False), (None, False)])
def test_retraction(subject, want):
    assert names.is_retraction(subject) is want


def test_telescopes():
    assert names.find_telescope("with the 2.5-m Nordic Optical Telescope")["name"] == "Nordic Optical Telescope"
    assert names.find_telescope("images from Keck")["name"] == "Keck"
    assert names.find_telescope("it was not seen") is None
    assert names.canonical("telescope", " nordic optical telescope ") == "NOT"


def test_redshifts():
    z = redshifts.find_redshift("Spectroscopic data of the host galaxy give z = 1.234 ± 0.002.")
    assert (z["redshift"], z["error"], z["measure"], z["type"]) == (1.234, 0.002, "spectroscopic", "host")
    assert redshifts.find_redshift("a redshift of 0.54 from photometry")["measure"] == "photometric"
    for none in ("g-z = 0.48", "z = 19.21", "18 arcsec from the source lies a galaxy with z = 0.3", "z < 2.5"):
        assert redshifts.find_redshift(none) is None
    assert redshifts.find_bound("so z <= 1.61 holds")["phrase"] == "z <= 1.61"


@pytest.mark.parametrize(
    ("text", "ra", "dec"),
    [
        ("RA = 12h34m56.7s, Dec = -23d45m12.3s", 188.73625, -23.75342),
        ("RA: 12:34:56.7 Dec: -23:45:12.3", 188.73625, -23.75342),
        ("(RA, Dec) = 191.532, -23.7534", 191.532, -23.7534),
        ("R.A. (J2000) = 11 09 29.61\nDec. (J2000) = +04 01 02", 167.37338, 4.01722),
        ("RA 12h57m, Dec -17d51m", 194.25, -17.85),
        ("RA = 12h34m56.7s, Dec = -23�45�12.3�", 188.73625, -23.75342),
    ],
)
def test_positions(text, ra, dec):
    got = positions.find_position(text)
    assert got["ra"] == pytest.approx(ra, abs=1e-4) and got["dec"] == pytest.approx(dec, abs=1e-4)


@given(st.integers(0, 359_999), st.integers(-89_999, 89_999))
def test_decimal_round_trip(ra, dec):
    got = positions.find_position(f"RA = {ra / 1000:.3f}, Dec = {dec / 1000:+.3f}")
    assert (got["ra"], got["dec"]) == (ra / 1000, dec / 1000)


def test_position_owners_and_boxes():
    assert positions.find_pair("a nearby galaxy lies at RA = 10.5, Dec = 3.5") is None
    box = positions.find_position("Center:\n 350.841 (23h) +12.853 (+12d)\nits maximum dimension is 2.4 deg (the minimum one is 30 arcmin)")
    assert (box["ra"], box["dec"], box["error"]) == (350.841, 12.853, [1.2, 0.25])
    table = "| ZTF Name | RA (deg) | DEC (deg) |\n|---|---|---|\n| ZTF24abc | 10.5 | -3.25 |"
    assert positions.find_position(table)["names"] == ["ZTF24abc"]
    assert positions.find_position(table + "\n| ZTF24abd | 11.5 | -3.25 |") is None


def short(rows):
    return [(r["filter"], r["mag"], r["mag_error"], r["limiting_mag"], r["limiting_mag_sigma"]) for r in rows]


def test_prose_photometry():
    got = tables.photometry("r = 18.42 ± 0.05, g > 21.3 (3 sigma). Rc 19.10 +/- 0.20. The host galaxy has i = 20.1. z = 1.61")
    assert short(got) == [("r", 18.42, 0.05, None, None), ("R", 19.1, 0.2, None, None), ("g", None, None, 21.3, 3.0)]
    assert short(tables.photometry("With upper limits: R = 21.5 and more.")) == [("R", None, None, 21.5, None)]
    assert short(tables.photometry("In the r-band we place a 3-sigma upper limit of 20.6 mag.")) == [("r", None, None, 20.6, 3.0)]
    assert tables.photometry("(trigger No 740430582, 22h 48m 28.80s, R=14.88) errorbox") == []


def test_table_photometry():
    got = tables.photometry("| Tmid-T0 (h) | Filter | Mag (AB) |\n|---|---|---|\n| 2.5 | r | 18.3 +/- 0.1 |\n| 3 | Rc (Vega) | limit: 20.1 |\n| 4 | ?? | 18.0 +/- 0.1 |", T0)
    assert short(got) == [("r", 18.3, 0.1, None, None), ("R", None, None, 20.1, None)]
    assert got[0]["obs_time"] == "2024-01-01T02:30:00Z"
    boxed = "+----+----+\n| Name | Filter | Mag | MagErr |\n+====+====+\n| ZTF1 | g | 19.78 | 0.07 |\n+----+----+"
    assert short(tables.photometry(boxed)) == [("g", 19.78, 0.07, None, None)]
    spaced = tables.photometry("Date  Filter  Mag. (AB)  Err\n------\n2024-01-02.50  r  18.3  0.1\n2024-01-03  g  > 20.1  -")
    assert short(spaced) == [("r", 18.3, 0.1, None, None), ("g", None, None, 20.1, None)]
    assert spaced[0]["obs_mjd"] == 60311.5
    fixed = tables.photometry("Date UTstart t-T0 Exp Filter mag err UL\n2024-01-02 03:04:05 0.500 12*300 Rc 18.30 0.10 21.1", T0)
    assert short(fixed) == [("R", 18.3, 0.1, 21.1, None)] and fixed[0]["obs_time"] == "2024-01-01T12:00:00Z"


def test_flux():
    got = flux.radio("We measure flux densities of 170 +/- 30 and 150 +/- 20 microJy/beam at 5.5 and 9 GHz, respectively. A 3-sigma upper limit of 60 uJy at 22 GHz. Brighter than the flux density of 4 mJy at 9 GHz.")
    assert [(r["flux_density"], r["flux_density_error"], r["limiting_flux_density"], r["bandpass"]) for r in got] == [(170, 30, None, "radio-6GHz"), (150, 20, None, "radio-10GHz"), (None, None, 60, "radio-22GHz")]
    assert flux.radio("15 GHz: 2.1 +/- 0.2 mJy\n6 GHz: < 0.3 mJy")[1]["limiting_flux_density"] == 0.3
    assert flux.radio("flux densities of 5 and 6 mJy at 9 GHz") == []
    got = flux.xray("EP-FXT found a 0.5-10 keV flux of 1.2 (+/- 0.2) x 10^-13 erg/cm^2/s. The XRT upper limit is 3e-14 erg cm^-2 s^-1 in 0.3-10 keV. The fluence is 2e-6 erg cm^-2.")
    assert [(r["energy_flux"], r["limiting_energy_flux"], r["bandpass"]) for r in got] == [(1.2e-13, None, "epfxt"), (None, 3e-14, "swiftxrt")]
    assert bands.radio_band(60.0) == "radio-45GHz" and bands.radio_band(1000.0) is None


def test_classes():
    assert classes.find_class("The spectrum is consistent with a type Ic-BL supernova")["classification"] == "Ic-BL"
    assert classes.find_class("We searched for a kilonova") is None
    assert classes.find_class("with Kilonova-Catcher we saw a kilonova-like source")["start"] == 31
    assert classes.find_class("We thank the supernova team") is None
    assert classes.find_class("seen by SN alone") is None and classes.find_class("spectrum of this SN")["classification"] == "Supernova"
    assert classes.flash_subtype("It is an X-ray flash.") == "XRF" and classes.flash_subtype("It could be classified as an XRF.") == "XRF candidate"
    assert classes.flash_subtype("XRF 030723 was near.") is None
    assert classes.flare_class("The trigger was a stellar flare.") == "UV Ceti" and classes.flare_class("There is no evidence of a trigger due to a stellar flare.") is None
    assert classes.paths()["Ia-pec"][0] == "Time-domain Source"


def test_times():
    got = times.find_offsets("T+234s, T-T0 = 11h, 4 hours after the trigger, mid-time = 3.2 ks, T-5 min")
    assert [(g["value"], g["unit"], g["reference"]) for g in got] == [(234, "s", "T+"), (-5, "m", "T-"), (11, "h", "trigger"), (4, "h", "trigger"), (3200, "s", "trigger")]
    assert times.absolute("60000.5")[1] == "2023-02-25T12:00:00.000Z"
    assert times.absolute("2024-01-02 03:04:05") == (pytest.approx(60311.12783564815), "2024-01-02T03:04:05Z")
    for none in ("03:04", "2024-01", "12", "99999"):
        assert times.absolute(none) is None
    assert times.stated_epoch("We observed the field on 2026-06-05 03:41 UT.")[1] == "2026-06-05T03:41:00Z"


def test_record():
    body = "We observed GRB 240101A at 2024-01-01 12:00:00.\nr = 18.40 +/- 0.10 (AB)\nSee GCN 12 and GCN 13. z = 1.5"
    got = extract_text("Optical", body, None, T0)
    assert got["event"]["event_name"] == ["GRB240101A"] and got["follow_up"]["reference"] == {"gcn_circulars": "12,13"}
    assert got["photometry"][0]["obs_time"] == "2024-01-01T12:00:00Z" and "applied to all 1" in got["extraction_meta"]["notes"][0]
    assert all(body[s["start"] : s["end"]] == s["snippet"] for s in got["provenance"].values())
    assert extract_text(None, None)["event"] is None
    assert extract_text("", "z < 2.5")["extraction_meta"]["notes"] == ["z < 2.5"]
    two = extract_text("", "r = 18.40 +/- 0.10, 2 hours after the trigger\ng = 18.60 +/- 0.10, 3 hours after the trigger", None, T0)
    assert [r["obs_time"] for r in two["photometry"]] == ["2024-01-01T02:00:00Z", "2024-01-01T03:00:00Z"]


@given(st.text(max_size=200))
def test_spans_hold_on_any_text(text):
    got = extract_text(text[:20], text)
    assert all(text[s["start"] : s["end"]] == s["snippet"] for s in got["provenance"].values())
    assert not re.search("error", " ".join(got["extraction_meta"]["notes"]))


def test_refined_position_comes_first():
    """A pair with a label each stands before one with both labels ahead, wherever it is."""
    text = "The trigger box is at R.A., Dec. 120.5000, 33.2500 degrees.\nThe source lies at\nR.A. (J2000) = 08h02m30s\nDec. (J2000) = 33d10m12s"
    got = positions.find_pair(text)
    assert (got["ra"], got["dec"]) == (pytest.approx(120.625), pytest.approx(33.17))
    assert positions.find_pair("RA, Dec = 120.5000, 33.2500")["ra"] == 120.5
    assert positions.find_pair("The field of view is centred at RA = 12.5, Dec = 4.5") is None
    assert positions.find_pair("The field of view is wide; the calculated position is RA = 12.5, Dec = 4.5")["ra"] == 12.5


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We imaged it on 2021-03-04_05:06 UT", "2021-03-04T05:06:00Z"),
        ("Observing began at 2021 March 4 05:06:07 UT", "2021-03-04T05:06:07Z"),
        ("data were obtained on UT 4 March 2021 05:06", "2021-03-04T05:06:00Z"),
        ("Observed with the array of the project (PI: A. Writer) on 2021-03-04 at 05:06 UT", "2021-03-04T05:06:00Z"),
        ("On 2021 Mar 4 UT, while observing galaxies, it was found", "2021-03-04T00:00:00Z"),
        ("The exposure started at 05:06 UT on March 4th 2021.", "2021-03-04T05:06:00Z"),
        ("We observed on 2021 Mar 4.25 UT.", "2021-03-04T06:00:00Z"),
        ("It faded. The catalogue is of 2021-03-04.", None),
    ],
)
def test_stated_epochs(text, want):
    got = times.stated_epoch(text)
    assert (got and got[1]) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The satellite triggered on the flare star AB Xyz.", "UV Ceti"),
        ("The trigger is likely a stellar flare of a nearby dwarf.", "UV Ceti candidate"),
        ("It is 3 arcsec from the known flare star AB Xyz.", None),
        ("The decline is like that of an M-dwarf flare.", None),
        ("The possibility that it is a stellar flare cannot be ruled out.", None),
    ],
)
def test_flares(text, want):
    assert classes.flare_class(text) == want


def test_classes_in_context():
    assert classes.find_class("Fu et al. report it") is None and classes.find_class("the transient is Ia") is None
    assert classes.find_class("a hypernova spectrum")["classification"] == "Ic-BL"
    assert classes.flash_subtype("to search for a hard X-ray flash") is None
    assert classes.flash_subtype("either an X-Ray Flash or a hard burst, we conclude it is an X-ray flash") == "XRF candidate"


def test_decimal_days_and_fields():
    assert times.absolute("August 18.85 2017") == times.absolute("18.85 August 2017") == times.absolute("2017-08-18 20:24")
    assert times.absolute("2017.08.18") == times.absolute("2017-08-18")
    got = extract_text("GRB 240101A", "r = 18.40 +/- 0.10. z = 1.5", fields=("redshift",))
    assert got["redshift"]["redshift"] == 1.5 and got["photometry"] == [] and got["event"] is None
    assert short(tables.photometry("The host galaxy was imaged\n\nr = 18.50. Then g = 19.50.")) == [("g", 19.5, None, None, None)]


def test_flux_marks():
    got = flux.radio("A source with a flux density of 110+/-20 microJy/beam at 9 GHz.\nWe also give a 5 sigma upper limit of 80 micro-Jy at 5500 MHz.")
    assert [(r["flux_density"], r["flux_density_error"], r["limiting_flux_density"], r["limiting_mag_sigma"], r["frequency_ghz"]) for r in got] == [(110, 20, None, None, 9.0), (None, None, 80, 5.0, 5.5)]
    assert [(r["flux_density"], r["frequency_ghz"]) for r in flux.radio("Seen at 5.5, 9 and 17 GHz with flux densities of 3, 2 and 1 mJy.")] == [(3, 5.5), (2, 9.0), (1, 17.0)]
    for none in ("a flux density of 2 mJy, higher than the 15 GHz one", "The host galaxy has a flux density of 0.2 mJy at 6 GHz.", "limits of 3 mJy at 6 GHz", "flux densities of 1 mJy and 2 uJy at 5 and 6 GHz"):
        assert flux.radio(none) == []
    value = lambda text: [(r["energy_flux"], r["energy_flux_error"], r["limiting_energy_flux"]) for r in flux.xray(text)]
    assert value("a flux of (2.3 +/- 0.4) x 10^-12 erg cm^-2 s^-1 in 0.3-10 keV") == [(2.3e-12, 4e-13, None)]
    assert value("3.5 x 10^-12 +/- 2.1 x 10^-12 erg/cm2/s") == [(3.5e-12, 2.1e-12, None)]
    assert value("a flux of 2.6 (+1.1, -0.9) e-14 erg/cm^2/s") == [(2.6e-14, None, None)]
    assert value("not detected to 2.0 x 10^-14 erg/s/cm2") == [(None, None, 2e-14)]
    assert value("a fluence of 9e-7 erg/cm^2") == value("a luminosity of 2e44 erg/s") == []
    assert all(text[r["start"] : r["end"]].endswith("s^-1") for text in ["It has 1e-13 erg cm^-2 s^-1, it seems."] for r in flux.xray(text))
