"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns named like columns that the operators use inside.
CLASH = ("g", "h", "key", "rep", "rank", "cell", "kept", "spans", "leaks", "n_words", "_s", "_found", "salt", "bucket")


def prose(seed: int, n: int, size: int = 300) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def table(spark, rows, schema="doc_id long, text string", clash=True):
    df = spark.createDataFrame(rows, schema)
    if clash:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(c) for c in CLASH if c not in df.columns})
    return df


def sets(text: str, k: int = 5) -> set:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
