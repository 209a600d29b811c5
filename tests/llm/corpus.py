"""Small awkward tables for the operators' tests, and plain-Python forms of what they compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, rest double, kept boolean, n_lines long"


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}é" for _ in range(n))


def awkward(seed=1):
    """(doc_id, text): nulls, blanks, long words, long texts, copies, near copies, repeated rows, shared lines and passages."""
    rng = random.Random(seed)
    shared = prose(rng, 60)
    line = "This LINE is shared by many documents and long enough " + prose(rng, 5)
    docs = [(0, None), (1, ""), (2, " \t\n\x0b "), (3, "one"), (4, "One  two"), (None, "a null id " + shared), (5, "x" * 5000), (6, "ab " * 400), (7, "\n\n\nEnd of it\n"), (8, "naïve ÀÉ ñ 漢字 😀 " * 20)]
    docs += [(10 + k, prose(rng, rng.randrange(5, 200))) for k in range(12)]
    docs += [(30 + k, prose(rng, 40) + "\n  " + (line if k % 2 else line.upper()) + "\t\n" + prose(rng, 30)) for k in range(8)]
    docs += [(50 + k, prose(rng, 30) + " " + shared + " " + prose(rng, 30)) for k in range(5)]
    base = prose(rng, 300, 5000).split(" ")
    docs += [(70 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(6)] + [(80, " ".join(base)), (81, " ".join(base))]
    docs += [(90, prose(rng, 6000)), (91, "dup row " + shared), (91, "dup row " + shared)]
    return docs


def frame(spark, docs):
    """The table with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1.5, True, 7) for i, t in docs], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")
