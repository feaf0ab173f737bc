"""Shortcuts of the parsers find what their full patterns find."""

from __future__ import annotations

import pytest

from alertframe.text import classes, cues, names, positions, redshifts, tables, times

TEXTS = [
    "GRB 240101A: we report an UPPER LIMIT of 20.5 mag, ſtandard star, İt and K-band; host\n galaxy near.",
    "xGRB 240101A is none, Swift/UVOT and the VLT/X-shooter saw it, not Keck IIx nor KECK II.",
    "12.34.56 and 1.2345 or 7.25, r' = 19.50 +/- 0.10 (AB), unfiltered > 18.2, z=1.5, g-z = 0.4",
    "See GCN Circ. #33 and xGCN 12; RA = 10.5, Dec = -3.2; 53 Persei, 2 h after the second trigger, T-T0 = 5 s.",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_by_either_way(text):
    """A letter beyond ASCII at the end takes the way without shortcuts."""
    for find in (names.find_events, names.find_xrefs, names.find_telescope, classes.find_class, redshifts.find_redshift, redshifts.find_bound, times.find_offsets, positions.find_position, tables.prose):
        ascii_only = text.encode("ascii", "ignore").decode()
        assert find(ascii_only) == find(ascii_only + "\n\n中")


def test_cues_skip_only_what_has_none():
    cue = cues.phrases("upper limit|limits", "standard|comparison star|stars", "observ*")
    for text in (*TEXTS, "", "stars", "star standard", "standard  STARS", "preobserved", "it was OBSERVED"):
        assert [m.span() for m in cue.finditer(text)] == [m.span() for m in cue.form.finditer(text)]
        assert (cue.search(text, 5, 40) is None) == (cue.form.search(text, 5, 40) is None)
    assert cue._absent("nothing of the kind") and not cue._absent("ſtandard star")
