"""Pairs of sets that are stored before they are compared."""

import random

from quillon.operators import set_join


def test_hardly_a_pair_is_stored_that_is_not_similar(spark, monkeypatch):
    """Sets of 80 words that share common ones: with 128 marked bits, as before, many pairs were stored with both sets; they grow with the square of the input."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(600)]
    rows = []
    for i in range(300):
        own = set(words[:45])
        while len(own) < 80:
            own.add(rng.choice(words))
        rows.append((i, sorted(own)))
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    sides = [df.withColumnRenamed("id", k) for k in "ab"]
    similar = {(i, j) for i, x in rows for j, y in rows if len(set(x) & set(y)) >= 0.7 * len(set(x) | set(y))}
    met = {(r.a, r.b) for r in set_join._met(*sides, 0.7, "jaccard").collect()}
    assert similar <= met and len(met - similar) < 0.02 * 300 * 299
    monkeypatch.setattr(set_join, "MARKS", 2)
    assert len({(r.a, r.b) for r in set_join._met(*sides, 0.7, "jaccard").collect()} - similar) > 10 * len(met - similar)
