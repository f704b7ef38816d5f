"""Small documents with the awkward cases, and plain forms of what the operators compute."""

from __future__ import annotations

import random

ODD = ["", None, " ", "\n\n", "one", "two words", "a b a b a b a b", "Zeile eins ist lang genug\n\nZeile eins ist lang genug", "<|endoftext|> x<|startoftext|>y", "I'll don't 123 ½ ①", "ﬁ É é İstanbul ΑΣ σς ß", "日本語 😀😀 x\x1cy \x85 z　w", "é́ ́a", "x" * 3000, "tab\there\r\nline", "### $$$ %%% ***"]


def texts(n: int = 60, seed: int = 5) -> list[str]:
    rnd = random.Random(seed)
    words = [a + b for a in ("th", "an", "re", "in", "ou", "St", "ver", "é") for b in ("er", "at", "is", "on", "ß", "y")]
    out = []
    for _ in range(n):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 25))).capitalize() + "." for _ in range(rnd.randint(1, 6))]
        out.append("\n".join(lines))
    for k in range(0, n, 7):  # near copies
        out.append(out[k] + " " + rnd.choice(words))
    return out


def documents(spark, extra: bool = True, rows: list | None = None):
    """doc_id, text, lang, source, n_chars, with nulls, repeated rows and a column whose name could clash."""
    if rows is None:
        every = texts() + ODD
        rows = [(k * 3, t, "en", f"src{k % 7}", len(t or "")) for k, t in enumerate(every)]
        rows += [(None, "text without an id", None, None, None), (None, None, None, None, None), rows[4], rows[4], (6, "another text of a repeated id", "en", "src1", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({"h": F.lit("clash"), "score": F.lit(1), "fp": F.lit("x"), "line": F.lit(2), "n_removed": F.lit("y")})
    return df


def empty(spark):
    return documents(spark, rows=[(1, "x", "a", "b", 1)]).where("doc_id < 0")


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
