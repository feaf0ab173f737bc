"""Small documents with every odd case, and plain versions of what operators compute."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def corpus(seed: int = 1) -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, exact and near copies, shared passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)] + ["the", "of", "The", "of,"]
    word = lambda: r.choice(vocabulary)
    line = lambda n=12: " ".join(word() for _ in range(n))
    passage = "\n".join(line(20) for _ in range(4))
    texts: list[str | None] = [None, "", " \n\t ", "one", "a b c d", "😀 é", "x " * 60, "a b a b a b " * 20]
    for _ in range(25):
        texts.append("\n".join(line(r.randint(1, 30)) for _ in range(r.randint(1, 8))))
    base = " ".join(word() for _ in range(300))
    for k in range(12):  # near copies
        w = base.split(" ")
        w[10 * k + 3] = "changed"
        texts.append(" ".join(w))
    texts += [base, base, base.upper(), passage, passage + "\n" + line(), line() + "\n" + passage, "## || $$ " * 40]
    texts.append("\n".join(line(15) for _ in range(2000)))
    rows = [(i, t, None if i % 5 == 0 else "en", "s", None) for i, t in enumerate(texts)]
    return [*rows, (None, "null id text " + line(60), None, None, None), rows[30], rows[30]]


def frame(spark: SparkSession, rows: list[tuple], parts: int = 3) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """df with extra columns of those names."""
    return df.selectExpr("*", *(f"'x' as `{n}`" for n in names))


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(text: str | None, k: int = 5) -> Counter:
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()
