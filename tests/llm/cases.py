"""Small tables with every awkward case, shared by the tests of this folder."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(n))


def documents(spark, n: int = 60, seed: int = 1):
    """Null and empty texts, white space alone, ties, copies, near copies, a long text, null languages and sources, other scripts."""
    r = random.Random(seed)
    base = [words(r, 120) for _ in range(n)]
    rows = [(i, t, r.choice(["en", "de", "fr"]), f"src{i % 4}", len(t)) for i, t in enumerate(base)]
    at = n

    def add(text, lang="en", source="src0"):
        nonlocal at
        rows.append((at, text, lang, source, len(text) if text is not None else None))
        at += 1

    for t in (None, None, "", "   ", " \t\n\r\x0b\x0c", "word", "two words", "a b c d", "a b c d", "日本語 テキスト é ü", "🎉 ok 🎉"):
        add(t)
    for k in range(12):  # exact copies but for white space
        add(base[3].replace(" ", "  ", k), source=None)
    near = base[min(5, n - 1)].split(" ")
    for k in range(9):
        add(" ".join([*near[:k], f"new{k}", *near[k + 1 :]]), lang=None)
    add(" ".join(base), source="long")
    add("x" * 50_000)
    add("mail a.b@example.com and +1 (743) 555-3824, card 4539 1488 0343 6467, ip 10.0.0.1 or 10.0.0.999 and @home 123")
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names: str):
    """df with extra columns of these names."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def sf(df, path, name="documents"):
    """A folder that holds df as a table."""
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
