"""The learned lexicon against plain Python, and against texts whose ratings are known."""

import math
import random

import pytest

from shelfspark.operators.lexicon import learn_lexicon, learned_scores, rating_agreement, text_ratings
from shelfspark.operators.text import NEGATIONS

GOOD_WORDS, BAD_WORDS = ["sparkly", "solid", "crisp", "bright"], ["leaky", "brittle", "dull", "loud"]
FILLER = [f"word{i}x" for i in range(60)]


def reviews(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        liked = rng.random() < 0.5
        words = [rng.choice(FILLER) for _ in range(rng.randrange(5, 30))]
        for _ in range(3):
            if rng.random() < 0.3:  # the other side's word, negated
                words += [*words[:1], "not", rng.choice(["so", "very"]), rng.choice(BAD_WORDS if liked else GOOD_WORDS), *FILLER[:4]]
            else:
                words += [rng.choice(GOOD_WORDS if liked else BAD_WORDS), *FILLER[4:8]]
        out.append((i, " ".join(words), 5.0 if liked else 1.0))
    return out


def signed(text):
    words = text.lower().split()
    for i, w in enumerate(words):
        if w not in NEGATIONS and not w.isdigit():
            yield w, any(x in NEGATIONS for x in words[max(0, i - 3):i])


def brute(rows, prior=1000.0, least_z=1.96):
    pos, neg = {}, {}
    for _, text, rating in rows:
        for w, negated in signed(text or ""):
            side = (rating >= 4) != negated
            pos[w], neg[w] = pos.get(w, 0) + side, neg.get(w, 0) + (not side)
    p, n = sum(pos.values()), sum(neg.values())
    found = {}
    for w in pos:
        a = prior * (pos[w] + neg[w]) / (p + n)
        d = math.log((pos[w] + a) / (p + prior - pos[w] - a)) - math.log((neg[w] + a) / (n + prior - neg[w] - a))
        z = d / math.sqrt(1 / (pos[w] + a) + 1 / (neg[w] + a))
        if abs(z) >= least_z:
            found[w] = (pos[w], neg[w], math.tanh(d / 2), z)
    return found


@pytest.fixture(scope="module")
def learned(spark):
    rows = reviews(300, 1)
    df = spark.createDataFrame(rows, "id long, text string, rating double")
    ratings = text_ratings(df, "id")
    return rows, df, ratings, learn_lexicon(df, ratings, "id", "text")


def test_weights_equal_brute_force(learned):
    rows, _, _, lexicon = learned
    got = {r["term"]: r for r in lexicon.collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and set(GOOD_WORDS + BAD_WORDS) <= got.keys()
    for w, (p, n, weight, z) in want.items():
        assert (got[w]["positive"], got[w]["negative"]) == (p, n)
        assert got[w]["weight"] / 1e6 == pytest.approx(weight, abs=1e-6) and got[w]["z"] == pytest.approx(z)
    assert all(got[w]["weight"] > 0 for w in GOOD_WORDS) and all(got[w]["weight"] < 0 for w in BAD_WORDS)


@pytest.mark.parametrize("limit", [1 << 17, 0])  # broadcast, and joined by term
def test_scores_equal_brute_force_and_agree_with_ratings(spark, learned, monkeypatch, limit):
    monkeypatch.setattr("shelfspark.operators.lexicon.BROADCAST_TERMS", limit)
    _, _, _, lexicon = learned
    weights = {r["term"]: r["weight"] for r in lexicon.collect()}
    fresh = reviews(150, 2) + [(900, None, 5.0), (901, "", 1.0), (902, "nothing known here 42", 5.0), (903, "not sparkly", 3.0)]
    df = spark.createDataFrame(fresh, "id long, text string, rating double")
    scores = learned_scores(df, lexicon, "id", "text")
    got = {r["id"]: r for r in scores.collect()}
    assert len(got) == len(fresh)
    for i, text, _ in fresh:
        uses = [(weights[w], neg) for w, neg in signed(text or "") if w in weights]
        assert got[i]["hits"] == len(uses)
        assert got[i]["polarity"] == pytest.approx(sum(-w if g else w for w, g in uses) / len(uses) / 1e6 if uses else 0.0)
        empty = 0.0 if text else 0.5
        assert got[i]["subjectivity"] == pytest.approx(sum(abs(w) for w, _ in uses) / len(uses) / 1e6 if uses else empty)
    assert got[903]["polarity"] < 0
    r = rating_agreement(scores, text_ratings(df, "id"), "id").first()
    assert r["agreeing"] + r["opposed"] + r["undecided"] == r["ratings"] == 153
    assert r["agreeing"] >= 0.95 * 150


def test_nothing_to_learn(spark, learned):
    _, df, _, _ = learned
    none = text_ratings(df.where("rating = 3"), "id")
    lexicon = learn_lexicon(df, none, "id", "text")
    assert lexicon.count() == 0
    assert {r["polarity"] for r in learned_scores(df, lexicon, "id", "text").collect()} == {0.0}
    one_side = learn_lexicon(df, text_ratings(df.where("rating = 5"), "id"), "id", "text")
    assert one_side.count() >= 0
    assert rating_agreement(learned_scores(df.limit(0), lexicon, "id", "text"), none, "id").first()["ratings"] == 0
