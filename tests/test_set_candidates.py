"""Candidates of set joins against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from quillon.operators import set_join


@pytest.mark.parametrize("kind,t", [("jaccard", 0.7), ("jaccard", 0.5), ("dice", 0.8), ("jaccard", 1.0)])
def test_no_pair_is_lost(spark, kind, t):
    rng = random.Random(7)
    sets = []
    for _ in range(120):
        own = set(rng.choices([f"w{i}" for i in range(40)], weights=[1 / (i + 1) for i in range(40)], k=rng.randint(0, 25)))
        sets += [own, own ^ {f"w{rng.randint(0, 45)}"}, own ^ {f"w{rng.randint(0, 45)}" for _ in range(3)}]
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id long, tokens array<string>")
    got = {(r.a, r.b): r.similarity for r in set_join.candidates(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), t, kind).collect()}
    want = {}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            score = 0 if not x or not y else len(x & y) / len(x | y) if kind == "jaccard" else 2 * len(x & y) / (len(x) + len(y))
            if score >= t - 1e-9 and score:
                want[i, j] = score
    assert got == pytest.approx(want)


def test_tokens_are_not_shuffled_for_their_order(spark):
    """Only the rarest tokens of a set go through a shuffle, once, with a number and not a digest of the text."""
    rows = spark.createDataFrame([(i, f"a b c w{i}") for i in range(20)], "id long, text string")
    plan = set_join.candidates(*(rows.selectExpr(f"id AS {k}", "split(text, ' ') AS tokens") for k in "ab"), 0.7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "bit_count" in plan


def test_alike_texts_in_groups(spark, monkeypatch):
    """Against the matcher on every pair; the bound by common subsequences holds for texts of over 200 characters too."""
    monkeypatch.setattr(set_join, "TEXTS", (7, 3))
    rng = random.Random(3)
    texts = ["", "a", "ab" * 120]
    for _ in range(12):
        one = "".join(rng.choices("abcde ", k=rng.randint(1, 260)))
        texts += [one, one[:-3] + "xyz", one[len(one) // 3 :]]
    x, y = (spark.createDataFrame(list(enumerate(texts)), f"{k} long, {v} string") for k, v in (("a", "x"), ("b", "y")))
    got = {(r.a, r.b): r.score for r in set_join.alike_in_blocks(x, y, 0.7).collect()}
    ratios = {(i, j): SequenceMatcher(None, p, q).ratio() for i, p in enumerate(texts) for j, q in enumerate(texts)}
    assert got == {k: r for k, r in ratios.items() if r >= 0.7}
