import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tallyspark.llm import toxicity
from tallyspark.llm.toxicity import DIGITS, EXCEPTIONS, HOMOGLYPHS, SEEDS, Lexicon, _signature_batches, choose_stems, fit_toxicity, fold, score_toxicity

from .corpus import awkward, empty, frame, prose


def test_folding_keeps_the_length():
    for t in ("You 1d10t", "ІDІОТ", "İstanbul ß ﬁ", "ｍｏｒｏｎ", ""):
        assert len(fold(t)) == len(t)
    assert fold("1D10T!") == "idiot " and fold("іdіоt") == "idiot" and fold("ｍｏｒｏｎ") == "moron"


def test_matches_words_not_numbers_or_exceptions():
    lex = Lexicon({"idiot": 2.0, "trash": 3.0, "scum": 1.0})
    assert lex.total("an IDIOTIC 1d10t, really") == 4.0
    assert lex.total("vidiots and 1d1076 07 10107") == 2.0 - 2.0 + lex.total("1d1076")
    assert lex.total("the trash can. A trash heap") == 3.0
    assert lex.total("10107") == 0.0 and lex.total("") == 0.0


def test_evidence_prefers_the_right_stem():
    found = [("lose", 74, 22), ("loser", 68, 0), ("path", 78, 0), ("pathe", 78, 0), ("pathet", 78, 0), ("rare", 2, 0), ("common", 100, 900)]
    assert set(choose_stems(found, 350, 3700)) == {"loser", "path"}


def data():
    rng = random.Random(7)
    clean = [(k, prose(rng, 80, 3000), 0) for k in range(300)]
    bad = [(1000 + k, prose(rng, 40, 3000) + f" zorgling{rng.randrange(9)} " + prose(rng, 40, 3000), 1) for k in range(80)]
    return clean + bad


def test_learns_unknown_words_and_scores_alike(spark):
    rows = data()
    docs = frame(spark, [(i, t) for i, t, _ in rows] + awkward()[:10])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 2] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = {r["id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    assert len(got) == len({i for i, *_ in rows} | {i for i, _ in awkward()[:10]})
    held = [(i, x) for i, _, x in rows if not i % 2 and i > 10]
    assert all((got[i] >= 0.5) == bool(x) for i, x in held)
    assert all(0 <= s <= 1 for s in got.values())


def test_without_labels_the_seeds_decide(spark):
    docs = frame(spark, [(1, "you stupid m0ron"), (2, "a fine day"), (3, None), (4, "")])
    model = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r["id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    assert got[1] > 0.5 > got[2] == got[3] == got[4]
    assert score_toxicity(empty(spark), model).count() == 0


def naive_fold(text):
    out = []
    for c in text:
        c = c.lower()[0]
        c = next((latin for many, latin in HOMOGLYPHS.items() if c in many), DIGITS.get(c, c))
        out.append(" " if (ord(c) < 128 and not c.isalnum()) or c in "«»“”‘’„‚…–—¿¡·•\u2009\u202f\u00a0\u3000" else c)
    return "".join(out)


def naive_total(text, weights, exceptions=EXCEPTIONS):
    """Every word of the folded text against every stem, spans of exceptions taken out."""
    flat = " " + naive_fold(text) + " "
    spared = [k for p in exceptions for k in range(len(flat)) if flat.startswith(f" {p} ", k)]
    spans = [(k, k + len(p) + 1) for p in exceptions for k in spared if flat.startswith(f" {p} ", k)]
    total, at = [], 0
    for word in flat.split(" "):
        start = at  # the space before the word is at start - 1 in flat, the word's place in text
        at += len(word) + 1
        best = max((w for s, w in weights.items() if word and word.startswith(s)), default=0.0)
        if not best or any(lo <= start - 1 < hi for lo, hi in spans):
            continue
        tail = text[start - 1 :]
        run = next((c for c in tail if c.isspace() or c.isalpha()), None)
        if run is not None and not run.isspace():
            total.append(best)
    return math.fsum(total)


def test_matcher_against_a_naive_one():
    rng = random.Random(12)
    weights = {"idio": 2.5, "idiot": 2.0, "trash": 3.0, "scum": 1.0, "pathe": 1.5}
    bits = ["idiot", "1d10t", "ІDІОТ", "idiotic", "trash", "can", "trash can", "pond scum", "scum,", "scumble", "10107", "pathetic!", "the", "vidiot", "«scum»", "5cum", "\n", "  ", "tra$h", "white", "bags", "ｓｃｕｍ"]
    lex = Lexicon(weights)
    for _ in range(1500):
        text = rng.choice(["", " "]).join(rng.choice(bits) + rng.choice([" ", " ", ",", "\n", ""]) for _ in range(rng.randrange(0, 9)))
        assert fold(text) == naive_fold(text)
        assert abs(lex.total(text) - naive_total(text, weights)) < 1e-9, repr(text)


def signatures(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    (out,) = _signature_batches(iter([batch]))
    return out.column("signature").to_pylist()


def test_signatures_do_not_depend_on_neighbours():
    texts = ["you idiot", "one", "", "a b c", "a b c d", None, "you idiot"]
    alone = [signatures([t])[0] for t in texts]
    assert signatures(texts) == alone and signatures(texts[::-1]) == alone[::-1]
    assert alone[0] == alone[6] and alone[2] == alone[5] and len(set(alone)) >= 4


def test_clashing_labels_repeated_rows_and_order_do_not_matter(spark):
    rows = data()
    docs = [(i, t) for i, t, _ in rows]
    given = [(i, x) for i, _, x in rows] + [(1000, 0), (5, 1)]  # two ids with both labels
    models = []
    for seed in (1, 2):
        rng = random.Random(seed)
        shuffled, said = rng.sample(docs + docs[:30], len(docs) + 30), rng.sample(given + given[:9], len(given) + 9)
        models.append(fit_toxicity(frame(spark, shuffled).repartition(seed + 1), spark.createDataFrame(said, "doc_id long, toxic int")))
    assert models[0]["stems"] == models[1]["stems"] and np.allclose(models[0]["weights"], models[1]["weights"])


def test_length_counts_words_whatever_stands_between_them():
    lex = Lexicon({"idiot": 2.0})
    same = ["you idiot", "you\tidiot", "  you \n\n idiot" + " " * 500, "you\x0bidiot\r\n"]
    assert np.ptp(toxicity._features(lex, same), axis=0).tolist() == [0, 0]


def test_a_megabyte_of_matches_takes_no_quadratic_time():
    import time

    lex = Lexicon(dict.fromkeys(["idiot", "trash", "soap", "aseo"], 1.0))
    for unit in ("you idiot trash can ", "soap scum trash can ", "4530-", "trash can trash cans "):
        times = []
        for size in (1 << 18, 1 << 20):
            text = unit * (size // len(unit))
            began = time.process_time()
            lex.total(text)
            times.append(time.process_time() - began)
        assert times[1] < 5 and times[1] < 12 * times[0] + 0.2, unit


def test_scores_against_a_naive_model(spark):
    """Counting, choice of stems, features and scores, all by plain Python."""
    rows = data()
    model = fit_toxicity(frame(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    counts = {0: Counter(), 1: Counter()}
    once = {(h, x): t for (_, t, x), h in list(zip(rows, signatures([t for _, t, _ in rows])))[::-1]}  # near copies count once, the smallest id's text
    size = Counter(x for _, x in once)
    for (_, x), t in once.items():
        counts[x].update({w[:n] for w in naive_fold(t).split() for n in range(4, 9) if len(w) >= n})
    stems = choose_stems([(s, t, counts[0][s]) for s, t in counts[1].items()], size[1], size[0])
    typical = float(np.median(list(stems.values())))
    stems |= {s: typical for s in SEEDS if not any(s[:n] in stems for n in range(4, len(s) + 1))}
    assert model["stems"].keys() == stems.keys() and all(abs(model["stems"][s] - w) < 1e-9 for s, w in stems.items())
    assert any(s.startswith("zorg") for s in stems)
    w = model["weights"]
    got = {r["id"]: r["score"] for r in score_toxicity(frame(spark, [(i, t) for i, t, _ in rows]), model).collect()}
    for i, t, _ in rows[::7]:
        total = naive_total(t, stems)
        x = (math.log1p(total), math.log1p(100 * total / max(1, len(t.split())))) if total else (0.0, 0.0)
        assert abs(got[i] - 1 / (1 + math.exp(-(w[0] + w[1] * x[0] + w[2] * x[1])))) < 1e-9


def test_no_limit_on_candidate_stems():
    import inspect

    assert ".limit(" not in inspect.getsource(toxicity)
