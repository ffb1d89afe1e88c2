"""Small tables that hold the cases which operators define."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> list[str | None]:
    rng = random.Random(20)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9)))
    base = [word() for _ in range(120)]
    near = [w if k % 60 else word() for k, w in enumerate(base)]
    passage = " ".join(word() for _ in range(90))
    out = [None, "", "   \n\t ", "one", "é ß 😀 ñ", " ".join(base), " ".join(base), " ".join(near), "same " * 400]
    out += [" ".join(word() for _ in range(70)) + "\n" + passage + "\n" + " ".join(word() for _ in range(40 + k)) for k in range(4)]
    out += ["line one here\nline one here\nother\n\nline one here", "a\tb\x0bc\x1cd　e f", "# ## | <b> $5 & 7%", "x" * 5000, " ".join(word() for _ in range(20000))]
    return out + [" ".join(word() for _ in range(60)) for _ in range(12)]


def documents(spark, clashing: bool = False):
    rows = [(k, t, ("en", "fr", None)[k % 3], ("hot", "hot", "b", None, "")[k % 5], None if t is None else len(t)) for k, t in enumerate(texts())]
    rows += [rows[5], (None, "no id " * 60, None, None, None)]  # a repeated row and one without an id
    df = spark.createDataFrame(rows, DOCS)
    if clashing:
        from pyspark.sql import functions as F

        names = ["id", "hash", "body", "node", "size", "_row", "_w", "cells", "row", "score", "held_out", "n_words", "target", "cuts", "a", "u"]
        df = df.withColumns({name: F.lit("x") for name in names})
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
