from collections import Counter

import numpy as np

from tallyspark.llm.quality import FEATURES, RULES, fit_votes, posterior, quality_filter, quality_scores

from .corpus import awkward, empty, frame, prose, words


def expected(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_base_counts_against_brute_force(spark):
    docs = awkward()
    got = quality_scores(frame(spark, docs)).collect()
    rows = sorted(((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=str)
    want = [(i, *e, e[0] < 10 or 100 * e[4] > 20 * e[0]) for i, t in docs for e in [expected(t)]]
    assert rows == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_filter_keeps_columns_and_clean_documents(spark):
    import random

    rng = random.Random(5)
    clean = [(k, ". ".join(prose(rng, 12, 9000) for _ in range(10)) + ".") for k in range(60)]
    junk = [(100 + k, " ".join(f"{w}###" for w in prose(rng, 60, 9000).split())) for k in range(10)] + [(200, "Same Same " * 60)]
    df = frame(spark, clean + junk)
    out = quality_filter(df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == set(range(60))


def test_empty_table(spark):
    assert quality_scores(empty(spark)).count() == 0 and quality_filter(empty(spark)).count() == 0


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((len(good), 5), int)
    caught, false = np.array([0.9, 0.7, 0.6, 0.5, 0.3]), np.array([0.01, 0.02, 0.005, 0.03, 0.02])
    for r in range(5):
        bad = rng.random(len(good)) < np.where(good, false[r], caught[r])
        votes[:, r] = np.where(bad, -1, np.where(rng.random(len(good)) < 0.3, 0, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, rates = fit_votes(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.1  # abstentions carry no evidence, which costs some of it
    p = posterior(votes, share, rates)
    assert ((p > 0.5) == good).mean() > 0.9
    assert len(RULES) <= 12  # the table of patterns stays small


def by_hand(ballots, rounds=50, strength=0.02):
    """The posterior of each ballot by expectation-maximisation over single documents, and the functions that give others'."""
    start = {0: {-1: 0.3, 0: 0.2, 1: 0.5}, 1: {-1: 0.02, 0: 0.18, 1: 0.8}}
    rate = {c: [dict(start[c]) for _ in RULES] for c in (0, 1)}
    share = 0.85

    def good(ballot):
        odds = share / (1 - share)
        for k, v in enumerate(ballot):
            odds *= rate[1][k][v] / rate[0][k][v] if v else 1
        return odds / (1 + odds)

    extra = 1 + strength * len(ballots)
    for _ in range(rounds):
        believed = [good(b) for b in ballots]
        share = min(max(sum(believed) / max(len(ballots), 1), 0.05), 0.99)
        for c in (0, 1):
            weight = [g if c else 1 - g for g in believed]
            for k in range(len(RULES)):
                rate[c][k] = {v: (sum(w for w, b in zip(weight, ballots) if b[k] == v) + start[c][v] * extra) / (sum(weight) + extra) for v in (-1, 0, 1)}
    return good


def test_posterior_and_verdict_against_plain_python(spark):
    import random

    rng = random.Random(11)
    docs = [(k, ". ".join(prose(rng, 12, 9000) for _ in range(rng.randrange(1, 10))) + ".") for k in range(50)]
    docs += [(100 + k, " ".join(f"{w}#%" for w in prose(rng, 60, 9000).split())) for k in range(8)]
    docs += [(200 + k, " ".join(w.upper() for w in prose(rng, 70, 9000).split())) for k in range(4)] + [(300, None), (301, "")] + awkward()
    rows = quality_scores(frame(spark, docs)).collect()

    def holds(rule, row):
        import duckdb

        given = ", ".join(f"{row[f]}::BIGINT AS {f}" for f in FEATURES)
        return duckdb.execute(f"SELECT {rule} FROM (SELECT {given})").fetchone()[0]

    ballots = [tuple(-1 if not r["n_words"] or holds(bad, r) else 1 if holds(good, r) else 0 for bad, good in RULES.values()) for r in rows]
    told = by_hand([b for r, b in zip(rows, ballots) if not r["base_failed"]])
    for r, ballot in zip(rows, ballots):
        assert abs(r["posterior"] - told(ballot)) < 1e-9
        assert r["kept"] == (not r["base_failed"] and told(ballot) >= 0.5)
    assert {r["kept"] for r in rows} == {True, False}


def test_rates_are_not_bounded():
    votes = np.array([[-1, -1, 1], [1, 1, 1]])
    _, rates = fit_votes(votes, np.array([2_000.0, 8_000.0]))
    weight = 1 + 0.02 * 10_000  # of the prior, which alone speaks for the third rule's bad votes
    assert abs(rates[0, 2, 0] - 0.3 * weight / (2_000 + weight)) < 0.002
