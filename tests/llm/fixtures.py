"""Small tables with everything that may go wrong in a column."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, kept boolean, row long"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def prose(n, seed, words=400):
    rng = random.Random(seed)
    return " ".join("w%d" % rng.randrange(words) if i % 9 else "W%d." % rng.randrange(words) for i in range(n))


def documents(spark, more=()):
    """Nulls, empty texts, blanks, copies, near copies, junk, a long text; and
    extra columns whose names the operators use themselves."""
    base = prose(300, 1)
    near = base.replace("w1", "changed", 2)
    texts = [None, "", " \n\t ", "one", "two words", base, base, near, base.upper(), prose(120, 2), prose(120, 3), "x | y | z\n" * 40, "RUN!! AWAY!!\n" * 60,
             f"{prose(60, 4)} {PASSAGE} {prose(60, 5)}", PASSAGE, prose(30_000, 6), "naïve café — “quoted” 東京 don't <|endoftext|> A\x1cB\x0bC\u00a0D\u2028E", prose(80, 7) + "\nLicensed under the Apache License, Version 2.0.", *more]
    rows = [(i, t, "en", None if i % 3 else "s", len(t) if t else 0, "k", i % 2, None, 7) for i, t in enumerate(texts)]
    rows += [(5, base, "en", "s", len(base), None, None, None, None), (None, prose(90, 8), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def labels(spark):
    rows = [(i, int(i in (5, 6, 7, 8, 9, 10, 13, 15)), 0) for i in range(5, 18)] + [(None, 1, 0), (5, None, None), (99, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark):
    rows = [(1, PASSAGE.upper()), (2, "Short item, here!"), (3, None), (4, ""), (None, "nobody has these words at all in any of the texts here"), (1, PASSAGE)]
    return spark.createDataFrame(rows, "item_id long, text string")
