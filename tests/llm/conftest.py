import random

import pytest

DOC_COLUMNS = ("doc_id", "text", "lang", "source")
#: Names that the operators use inside.
CLASHING = ("n_words", "kept", "component_id", "score", "_doc", "region", "length", "grp", "_gone", "a", "b", "item_id", "root", "scale")

BASE = "the and with over under lamp river stone green walks quickly home again tomorrow bright window paper garden silent music".split()


def prose(k: int, n: int) -> str:
    """n words, other ones for each k; a longer one begins with a shorter one of the same k."""
    rng = random.Random(k)
    return " ".join(rng.choice(BASE) + (str(rng.randrange(500)) if rng.random() < 0.6 else "") for _ in range(n))


def odd_documents() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties and repeated rows."""
    rows = [(i, prose(i, 60 + i), ("en", "de", None)[i % 3], f"s{i % 2}" if i % 5 else None) for i in range(40)]
    rows += [
        (100, None, "en", "s0"),
        (101, "", "en", None),
        (102, " \n\t ", None, None),
        (103, prose(3, 63), "en", "s1"),  # an exact copy
        (104, prose(3, 63) + " tail", "en", "s1"),  # a near copy
        (105, " ".join(prose(k, 300) for k in range(200, 330)), "en", "s0"),
        (106, "x" * 200_000, "en", "s0"),
        (107, "### $$$ " * 300, "en", "s0"),
        (108, "one", "de", "s1"),
        (109, "12 34 56 !!", "de", "s1"),
        (5, prose(5, 65), "en", "s0"),
        (5, prose(5, 65), "en", "s0"),
        (None, prose(77, 80), "en", "s0"),
        (None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with columns whose names clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents(), "doc_id long, text string, lang string, source string")
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *(F.lit(c).alias(c) for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
