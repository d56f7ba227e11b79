"""Small documents with the awkward cases: nulls, empties, ties, repeats, long texts."""

import random

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "Été", "über", "niño"]


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.7 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    shared = ["A line that many documents share, word for word.", "Another Shared Line of enough characters"]
    docs: list[tuple] = []
    for k in range(n):
        t = text(rng, rng.randrange(0, 120))
        if k % 3 == 0:
            t += "\n  " + shared[k % 2].upper() + "\t\n" + shared[0]
        docs.append((k, t, "en", f"src{k % 3}", len(t)))
    docs.append((n, None, None, None, None))
    docs.append((n + 1, "", "en", "src0", 0))
    docs.append((n + 2, docs[3][1], "en", "src0", None))
    docs.append((n + 3, docs[3][1], "en", "src1", None))
    docs.append((n + 4, text(rng, 4000), "en", None, None))
    docs.append((n + 5, "one two", "en", "src2", 7))
    return docs


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
