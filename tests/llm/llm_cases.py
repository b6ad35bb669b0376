"""Small tables with the awkward cases that every operator has to meet."""

import random

from trapline.llm.shipping import prepare

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use for their own columns
CLASHES = ["score", "spans", "leaks", "row_key", "order_id", "kept_text", "blocks", "windows", "runs", "ids", "decoded", "fp", "shard", "slot"]


def prose(n, seed, vocabulary=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(spark, extra=()):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows and ids."""
    prepare(spark)
    base = prose(60, 1)
    rows = [
        (5, base, "en", "a", 1), (2, base, None, None, None), (9, base.replace("w1 ", "w2 ", 1), "en", "a", 1), (7, None, "en", "a", 1),
        (3, "", "en", "a", 0), (8, " \n\t ", "en", "a", 4), (None, base, "en", "a", 1), (None, None, None, None, None),
        (4, "one two three", "en", "a", 1), (4, "one two three", "en", "a", 1), (4, prose(50, 2), "en", "a", 1),
        (6, prose(30_000, 3, 900), "en", "a", 1), (1, "tail " + prose(60, 1)[:150], "en", "a", 1), (10, "é€\U0001f600 " * 30, "fr", "b", 1),
        (11, prose(20, 4) + " " + base[20:200] + " " + prose(20, 5), "en", "c", 1), (12, "aa " * 120, "en", "c", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    for c in extra:
        docs = docs.selectExpr("*", f"'own' AS {c}")
    return docs


def empty(spark):
    prepare(spark)
    return spark.createDataFrame([], DOCS)


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
