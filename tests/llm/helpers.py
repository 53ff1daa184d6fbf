"""Fixtures that every operator meets: nulls, empty and long texts, ties, repeats, clashes."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 12]) for k in range(0, n, 12))


def edited(text: str, seed: int, n: int) -> str:
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randint(0, 10**6)}"
    return " ".join(words)


def documents() -> list[tuple]:
    rows = [(k, prose(k), "s0" if k % 3 else "s1") for k in range(24)]
    rows += [(100 + k, prose(1), "s0") for k in range(4)]  # copies
    rows += [(200 + k, edited(prose(2, 200), k, 1 + k % 4), "s2") for k in range(8)]  # near copies
    rows += [(300, None, "s0"), (301, "", None), (302, " \n\t\n", "s0"), (303, "one two", "s1"), (None, prose(55), None)]
    rows += [(304, prose(77, 9000), "s0"), (305, "naïve Straße 漢字 \u00a0 x " * 30, "s1"), (5, prose(5), "s0"), (306, "spam spam spam spam " * 40, "s0")]
    return rows


SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows=None, extra=True):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        # names that operators might use themselves
        for c in ("th", "gone", "key", "label", "id", "spans", "items", "n_words", "kept", "score", "component_id", "sig", "lang", "hit", "name"):
            df = df.withColumn(c, F.lit(c))
    return df.repartition(3)


def words(text):
    """Words between the six ASCII blanks."""
    return (text or "").encode().split()
