"""Fixtures for the training-data operators: tables with nulls, blanks, ties, repeats and clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, component string, `set` int, bucket__ int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, seed=5, n=60, extra=()):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 2, 3, 4, 10, 60, 300])) for _ in range(n)]
    texts += [None, None, "", " ", "\n\t \x0b", "one", "one two", "ONE Two three", "one two  three", "  lead", "trail  ", "a\n b\t\n c  d", "naïve ñandú 漢字 😀 x", prose(rng, 30_000)]
    base = prose(rng, 200).split()
    texts += [" ".join(base)] * 7 + [" ".join(base) + " ", "\n".join(base)]
    for i in range(12):
        near = list(base)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    texts += list(extra)
    sources = ["a", "b", "c", "é", None]
    rows = [(i if i != 3 else None, t, "en", "a" if rng.random() < 0.4 else rng.choice(sources), len(t or ""), 1, "x", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[0], rows[-1]]  # repeated rows
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
