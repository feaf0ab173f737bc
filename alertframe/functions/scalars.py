"""Catalyst-native scalars: text, identifiers, times, sky and flux arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..text import bands, names, redshifts

# What a table writes for nothing, keV in GHz terms and the AB zero point in uJy.
NOTHING = ("", "nan", "none", "null", "no information", "n/a", "na", "-")
H_KEV_S = 4.135667696e-18
AB_ZERO = 23.9


def clean_text(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\u0000", " "), r"(?U)^\s+|\s+$", "")


def normal_event(x: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(x, r"(?U)\s+", "")), F.lit(""))


def event_names(text: Column) -> Column:
    """Distinct normal names in order of place: one alternation over all forms, so that places need no arithmetic."""
    form = r"(?iU)\b(?:" + "|".join(names.EVENT_FORMS) + r")\b"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), normal_event))


def primary_event(event_id: Column, subject: Column, body: Column) -> Column:
    """Event id as written, else the first name of the subject, else of the body."""
    first = lambda x: F.get(event_names(clean_text(x)), F.lit(0))
    return F.coalesce(F.nullif(clean_text(event_id), F.lit("")), first(subject), first(body))


def xrefs(text: Column) -> Column:
    """Distinct cited bulletins in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)" + names.XREF), F.lit(1)), lambda x: x.cast("long")))


def is_retraction(subject: Column) -> Column:
    return F.coalesce(subject.rlike(r"(?iU)" + names.RETRACTION), F.lit(False))


def redshift_point(text: Column) -> Column:
    """The first point value, null for what is too large to be one."""
    point = F.nullif(F.regexp_extract(text, r"(?iU)" + redshifts.POINT, 1), F.lit(""))
    worded = F.nullif(F.regexp_extract(text, r"(?iU)" + redshifts.WORDED, 1), F.lit(""))
    z = F.coalesce(point, worded).cast("double")
    return F.when(z < redshifts.LARGEST, z)


def redshift_bound(text: Column) -> Column:
    return F.when(redshift_point(text).isNull(), F.nullif(F.regexp_extract(text, r"(?iU)" + redshifts.BOUND, 0), F.lit("")))


def id_parts(x: Column) -> tuple[Column, Column]:
    """A written id (12, 12.0, "12.0") as text and, if whole, as an integer; other text keeps itself and no integer."""
    number = F.regexp_extract(F.trim(x.cast("string")), r"^([+-]?\d{1,18})(?:\.0*)?$", 1)
    whole = F.nullif(number, F.lit("")).cast("long")
    return F.coalesce(whole.cast("string"), F.trim(x.cast("string"))), whole


def positive_id(x: Column) -> Column:
    """Positive whole number or null."""
    n = x.try_cast("double")
    return F.when((n > 0) & (n == F.floor(n)), n.cast("long"))


def or_nothing(x: Column) -> Column:
    return F.when(~F.lower(F.trim(x)).isin(*NOTHING), F.trim(x))


def grb_name(x: Column) -> Column:
    """200101A and GRB200101A as GRB 200101A."""
    return F.regexp_replace(F.trim(x), r"(?i)^(?:GRB)?\s*(\d{6}[A-Z]?)$", "GRB $1")


def eval_text(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def mjd(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(86400e6) + F.lit(40587.0)


def offset_seconds(value: Column, unit: Column) -> Column:
    return value * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the arctangent form, exact at all distances."""
    a, b, d = F.radians(dec1), F.radians(dec2), F.radians(ra2 - ra1)
    y = F.sqrt(F.pow(F.cos(b) * F.sin(d), 2) + F.pow(F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d), 2))
    return F.degrees(F.atan2(y, F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d))) * 3600


def energy_to_ujy(flux: Column, band: Column) -> Column:
    """Band-averaged flux density; null unless the band is two energies, low to high and positive."""
    low, high = F.get(band, F.lit(0)), F.get(band, F.lit(1))
    return F.when((F.size(band) == 2) & (high > low) & (low > 0), flux / ((high - low) / F.lit(H_KEV_S)) / F.lit(1e-29))


def to_ujy(value: Column, unit: Column) -> Column:
    return value * F.when(unit == "uJy", bands.UJY["uJy"]).when(unit == "mJy", bands.UJY["mJy"]).when(unit == "Jy", bands.UJY["Jy"])


def radio_band(ghz: Column) -> Column:
    """Nearest centre on a log scale within the ratio."""
    centres = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for n, c in bands.RADIO_GHZ.items()))
    near = F.array_min(F.transform(centres, lambda x: F.struct(F.abs(F.ln(ghz / x.c)).alias("far"), x.n.alias("n"))))
    return F.when(near.far <= F.ln(F.lit(bands.RADIO_RATIO)), near.n)


def bandpass(name: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in bands.BANDPASSES.items() for x in kv))
    return F.try_element_at(pairs, name)


def mag_system(name: Column) -> Column:
    return F.when(name.isin(*bands.AB_FILTERS), "AB").when(name.isin(*bands.VEGA_FILTERS), "Vega")


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6
