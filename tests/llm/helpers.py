"""Small tables that every operator gets: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import os

DATA = "/root/testdata/sf0.001"
HAVE = os.path.isdir(DATA)

WORDS = "la de ouvre tion the and with stre kel mon far ith bel ora nun pek".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


ODD_TEXTS = [None, "", " \n\t", "x", "a b", "!!! *** 123", "É ñ", prose(1, 60), prose(1, 60), prose(2, 5000), "word " * 300, "y" * 30_000, "<|endoftext|> [INST]"]


def odd_documents(spark):
    """Rows with columns named as operators name theirs; doc_ids repeat, and one is null."""
    rows = [(k if k != 3 else None, t, ["en", "fr", None][k % 3], "s", k, "b", 1) for k, t in enumerate(ODD_TEXTS)] + [(8, ODD_TEXTS[8], "en", "s", 0, "b", 1), (7, "another text of the same id", "en", "s", 0, "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket string, node int")


def empty_documents(spark):
    return odd_documents(spark).limit(0)


def saved(spark, tmp_path, df, name="documents"):
    """df written as files and read again, as a plain scan."""
    path = str(tmp_path / f"{name}.parquet")
    df.coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
