"""Bounds on the ratio of matching blocks."""

import random
from difflib import SequenceMatcher

import numpy as np

from quillon.operators import set_join


def texts_of(rng, n, size):
    parts = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "st", "by", "m", "fu", "wl"]
    return [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(size))[: rng.randint(3 * size, 7 * size)] for _ in range(n)]


def test_long_texts_seldom_need_their_subsequence(spark, monkeypatch):
    """Texts of one alphabet pass the bound by characters; before, each such pair cost a common subsequence, a step a character."""
    rng = random.Random(2)
    texts = [x for x in texts_of(rng, 40, 100) if len(x) >= set_join.POPULAR]
    x, y = (list(enumerate(texts)) for _ in range(2))
    seen = spark.sparkContext.accumulator(0)
    common = set_join._common
    monkeypatch.setattr(set_join, "_common", lambda *a: seen.add(1) or common(*a))
    got = {(r.a, r.b) for r in set_join.alike_in_blocks(spark.createDataFrame(x, "a long, x string"), spark.createDataFrame(y, "b long, y string"), 0.7).collect()}
    assert got >= {(i, i) for i in range(len(texts))} and seen.value < 2 * len(texts) < len(texts) ** 2 / 10


def test_no_alike_text_is_lost(spark):
    """Edited, cut, shifted and interleaved texts around the threshold, shorter and longer than the matcher's limit, against the matcher."""
    rng = random.Random(4)
    texts = ["", "e" * 500, "e" * 400 + "q", ("e" * 9 + "z") * 40, "on the " * 6_000]
    for base in texts_of(rng, 6, 30) + texts_of(rng, 8, 80):
        texts.append(base)
        for changes in (0.02, 0.1, 0.2, 0.3):
            texts.append("".join(rng.choice("aeiou xyz") if rng.random() < changes else c for c in base))
        texts += [base[len(base) // 3 :], base[: len(base) // 2] + base[: len(base) // 2], base[-60:] + base[:-60], "Ü" + base[:150] + "\U0001f600" * 40]
    x, y = (spark.createDataFrame(list(enumerate(texts)), f"{k} long, {v} string") for k, v in (("a", "x"), ("b", "y")))
    got = {(r.a, r.b): r.score for r in set_join.alike_in_blocks(x, y, 0.7).collect()}
    want = {}
    for j, q in enumerate(texts):
        m = SequenceMatcher(None, "", q)
        for i, p in enumerate(texts):
            if 2 * min(len(p), len(q)) >= 0.7 * (len(p) + len(q)):
                m.set_seq1(p)
                if (r := m.ratio()) >= 0.7:
                    want[i, j] = r
    assert got == want and len(want) > 2 * len(texts)


def test_common_subsequences_of_many_pairs():
    """At once as one by one, over several words of bits, with empty texts and ones that fill a word."""
    rng = random.Random(6)
    alphabet = "abcdef"
    xs = ["", "a" * 300] + ["".join(rng.choices(alphabet, k=rng.randint(1, 370))) for _ in range(30)]
    ys = ["", "a" * 64, "f" * 128, "ab" * 99] + ["".join(rng.choices(alphabet, k=rng.randint(1, 199))) for _ in range(30)]
    number = lambda t: np.array([alphabet.index(c) for c in t], np.int32)
    i, j = (v.ravel() for v in np.meshgrid(range(len(xs)), range(len(ys))))
    got = set_join._all_common([number(x) for x in xs], [number(y) for y in ys], len(alphabet), i, j)
    for a, b, n in zip(i, j, got.tolist(), strict=True):
        masks = {c: sum(1 << k for k, x in enumerate(ys[b]) if x == c) for c in alphabet}
        assert n == set_join._common(masks, len(ys[b]), xs[a])


def test_empty_sides(spark):
    x, y = spark.createDataFrame([(1, "abc")], "a long, x string"), spark.createDataFrame([(1, "abc"), (2, "b" * 300)], "b long, y string")
    assert [tuple(r) for r in set_join.alike_in_blocks(x, y, 0.7).collect()] == [(1, 1, 1.0)]
    assert set_join.alike_in_blocks(x.limit(0), y, 0.7).count() == set_join.alike_in_blocks(x, y.limit(0), 0.7).count() == 0
