"""Documents with everything that can go wrong in them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(spark, rng_seed: int = 3):
    """NULLs in each column, empty, blank and very long texts, ties, repeated rows, one id with two texts."""
    rng = random.Random(rng_seed)
    base = sentence(rng, 60)
    long = "\n".join(sentence(rng, 40) for _ in range(1500))
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, base.replace("a", "b", 1), None, "b", None),
        (4, None, "en", "a", None),
        (5, "", "en", None, 0),
        (6, "  \n\t ", "en", "a", 5),
        (None, "a text without an id but with quite a few words in it", "en", "b", 10),
        (7, long, "en", "c", len(long)),
        (8, "x" * 300_000, "en", "c", 300_000),
        (9, "two words", None, None, None),
        (10, sentence(rng, 30), "de", "a", None),
        (10, sentence(rng, 30), "de", "b", None),
        (11, "日本語の文章です。" * 20, "ja", "a", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The same documents with further columns, named like those that operators might use."""
    names = ["score", "keep", "slot", "shard", "bin_id", "length", "rank", "bucket", "id", "sig", "key", "line", "th", "piece", "position", "epoch", "n", "root", "r", "words", "row", "_near", "_near_id", "_score", "_quality_score", "_line_key", "_key", "_doc", "_th", "_drop", "_left", "_mix_tokens", "_mix_key", "_mix_position"]
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((x is not None, x) for x in r))
