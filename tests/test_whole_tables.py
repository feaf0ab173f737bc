"""Queries over whole tables against plain versions that read every row."""

from __future__ import annotations

import unicodedata
from collections import Counter

import duckdb

from alertframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_instrument_unique(spark):
    held: dict[int, set] = {}
    for key, value in duckdb.sql(f"select l_orderkey, l_suppkey from '{SF}/lineitem.parquet'").fetchall():
        held.setdefault(key, set()).add(value)
    want = sorted((k, min(v)) for k, v in held.items() if len(v) == 1)
    got = sorted(tuple(r) for r in QUERIES["instrument_unique"](spark, SF).collect())
    assert got == want and 0 < len(got) < len(held)


def plain_tokens(text: str | None) -> list[str]:
    plain = (text or "").lower().translate(str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"))
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in plain).split()


def test_postings(spark):
    df, tf, langs = Counter(), Counter(), set()
    for text, lang in duckdb.sql(f"select text, lang from '{SF}/documents.parquet'").fetchall():
        langs.add(lang)
        terms = plain_tokens(text)
        tf.update(terms)
        df.update(set(terms))
    got = {r.term: (r.df, r.tf) for r in QUERIES["postings"](spark, SF).collect()}
    assert got == {t: (df[t], tf[t]) for t in tf}
    assert len(langs) > 1 and any(not t.isascii() for t in got)
