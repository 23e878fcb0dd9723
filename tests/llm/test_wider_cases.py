"""Cases that earlier rounds lost: names of other shapes, pronouns and equal values, short licence names and several in a line, long conversations."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import op1_licenses, op3_simhash, op5_chat, op6_decontaminate

PAIRS = [
    ("McDonald has 5 cows and O'Brien has 8 goats. McDonald sells 3 cows to O'Brien. How many animals does O'Brien own now?", "MacLeod has 7 cows and D'Arcy has 4 goats. MacLeod sells 2 cows to D'Arcy. How many animals does D'Arcy own now?"),
    ("Natalia sold clips to 48 of her friends in April, and then she sold half as many clips in May. How many clips did she sell?", "Marco sold clips to 30 of his friends in June, and then he sold half as many clips in July. How many clips did he sell?"),
    ("Tom buys 5 red pens and then 8 blue pens for school. How many pens does Tom have in his bag at the end?", "Sam buys 9 red pens and then 9 blue pens for school. How many pens does Sam have in his bag at the end?"),
    ("Jean-Luc reads 12 pages of the book each day. Anna's book has 240 pages. How long does Jean-Luc need for Anna's book?", "Mary-Ann reads 10 pages of the book each day. Peter's book has 300 pages. How long does Mary-Ann need for Peter's book?"),
]


def found(spark, items, docs):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in op6_decontaminate.contaminated(docs, items).collect()}


def test_names_pronouns_and_equal_values(spark):
    items = [a for a, _ in PAIRS]
    docs = [f"so it was told. {b} and that was all" for _, b in PAIRS]
    assert found(spark, items, docs) == {(i, i) for i in range(len(PAIRS))}


def test_one_value_does_not_become_two(spark):
    item = PAIRS[2][0]
    two = item.replace("Tom buys 5", "Sam buys 5").replace("does Tom", "does Joe")
    assert found(spark, [item], [two.replace("Tom", "Sam")]) == set()


def test_recall_on_other_forms(spark):
    """Forms, names and values that the rules were not made on: at least 0.9 are found, and no text that only shares words with an item."""
    rng = random.Random(41)
    people = [("Zoë", "she", "her"), ("Li", "he", "his"), ("McKay", "he", "his"), ("O’Neill", "she", "her"), ("Anne-Marie", "she", "her"), ("D'Souza", "he", "his"), ("Øystein", "he", "his"), ("Fatima", "she", "her"), ("DeShawn", "he", "his"), ("Kim", "she", "her")]
    towns = ["Oslo", "Turin", "Leeds", "Quito", "Perth", "Accra", "Lyon", "Kyoto"]
    forms = [
        "On {d}, {a} drove {x} miles from {t} to {u}. {A} stopped for {y} minutes to rest and {p} paid {z} dollars for lunch. How fast did {a} drive if {q} trip took three hours?",
        "A baker called {a} bakes {x} loaves every morning. If {p} gives {y} of them to {b} and sells the rest for {z} cents each, how much money does {p} take home?",
        "The train leaves {t} with {x} passengers. At {u}, {y} people get off and {z} get on. What share of the seats is taken when it reaches the coast?",
        "{a}'s garden is {x} feet long. {b}'s garden is {y} feet longer than {q} neighbour's. Find the area of both gardens if each is {z} feet wide.",
        "Yesterday {b} asked {a}: \"If I save {x} dollars a week and spend {y} dollars, after how many weeks will I have {z} dollars?\" What should {a} answer?",
    ]

    def fill(form):
        (a, p, q), (b, _, _) = rng.sample(people, 2)
        t, u = rng.sample(towns, 2)
        x, y, z = (str(rng.randint(2, 60)) for _ in range(3))
        return form.format(a=a, A=a, b=b, p=p, q=q, t=t, u=u, x=x, y=y, z=z, d=rng.choice(["Monday", "Friday", "Sunday"]))

    items, docs, clean = [], [], []
    for k in range(60):
        items.append(fill(forms[k % 5]) + f" Note {'abcdefghijklmnopqrstuvwxyz'[k % 26] * 3} applies.")
        noise = [" ".join(f"plain{rng.randint(0, 5000)}" for _ in range(30)) for _ in range(2)]
        docs.append(f"{noise[0]}.\n{fill(forms[k % 5])}\n{noise[1]}")
        words = items[-1].split()
        rng.shuffle(words)
        clean.append(f"{noise[1]} {' '.join(words)} {noise[0]}")
    hit = found(spark, items, docs + clean)
    kind = {i: {j % 5 for d, j in hit if d == i} for i in range(60)}
    recall = sum(i % 5 in kind[i] for i in range(60)) / 60
    assert recall >= 0.9, recall
    assert not [d for d, _ in hit if d >= 60]


LICENCES = {
    "Licensed under the GPL.": {"gpl"},
    "License: BSD": {"bsd"},
    "Code is MIT licensed.": {"mit"},
    "Licence: CC BY": {"cc-by"},
    "GPLv3": {"gpl"},
    "Licensed under the MIT License and the Apache License, Version 2.0.": {"mit", "apache"},
    "SPDX-License-Identifier: MIT OR Apache-2.0": {"mit", "apache"},
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": {"mit", "apache"},
    "License: LGPL or MPL": {"lgpl", "mpl"},
    "This work is licensed under CC BY-SA 4.0 and the code under the BSD License.": {"cc-by-sa", "bsd"},
    "Released under the AGPL.": {"agpl"},
    "SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause)": {"gpl", "bsd"},
    "She attended MIT and studied physics.": set(),
    "The driving license and the passport of the traveller were lost.": set(),
    "Rice and beans or bread.": set(),
}


@pytest.fixture(scope="module")
def model(spark, sf):
    return op1_licenses.train(spark.read.parquet(f"{sf}/documents.parquet"))


def families(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: set() for i in range(len(texts))}
    for r in op1_licenses.scan(df, model).filter("confirmed").collect():
        got[r["doc_id"]].add(r["family"])
    return got


def test_short_names_and_several_in_a_line(spark, model):
    got = families(spark, model, list(LICENCES))
    assert {t: got[i] for i, t in enumerate(LICENCES)} == LICENCES


def test_precision_and_recall_of_families(spark, model):
    """Phrases that are neither trained on nor calibrated with, for every name of two words or more: recall of at least 0.95, precision 0.95."""
    phrases = ["All files here fall under the {}.", "Usage is governed by {} (see COPYING).", "License information: {}, unless stated otherwise."]
    said = [(f, p.format(n)) for f, names in op1_licenses.NAMES.items() for n in names if " " in n and f != "proprietary" for p in phrases]
    got = families(spark, model, [t for _, t in said])
    right = sum(f in got[i] for i, (f, _) in enumerate(said))
    wrong = sum(len(got[i] - {f}) for i, (f, _) in enumerate(said))
    assert right >= 0.95 * len(said) and right >= 0.95 * (right + wrong), (right, wrong, len(said))


def test_odd_rows_of_the_licence_scan(spark, model):
    rows = [(1, "License: BSD"), (1, "License: BSD"), (None, "License: BSD"), (2, None), (3, ""), (4, "word " * 200_000 + "\nLicensed under the MIT License.\n" + "more " * 200_000), (5, "and or and / | ; License: and")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("paragraph", "words", "level", "place", "nth", "guess", "of", "sure")})
    got = sorted((str(r["doc_id"]), r["family"]) for r in op1_licenses.scan(df, model).filter("confirmed").collect())
    assert got == [("1", "bsd"), ("4", "mit"), ("None", "bsd")]
    assert op1_licenses.scan(df.limit(0), model).count() == 0 and op1_licenses.train(df.limit(0)).classes[0] == "unknown"


def test_long_conversations_are_not_quadratic(spark):
    def once(n):
        df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
        began = time.time()
        r = op5_chat.read_back(op5_chat.format_chats(df)).select("n_turns", "loss_text", F.size("loss_spans").alias("spans")).first()
        assert (r["n_turns"], r["spans"]) == (n, n // 2) and r["loss_text"] == "".join(f"t {i}" for i in range(1, n, 2))
        return time.time() - began

    once(1_000)
    assert once(40_000) < 20


def test_kept_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c", 7, "x"), (2, "a b c", 8, "y")], "doc_id long, text string, fp long, first_doc string")
    got = op3_simhash.near_duplicates(df, keep=("fp", "first_doc", "text"))
    assert sorted((r["doc_id"], r["fp"], r["first_doc"], r["text"], r["component_id"]) for r in got.collect()) == [(1, 7, "x", "a b c", 1), (2, 8, "y", "a b c", 1)]
    assert len({r["fingerprint"] for r in got.collect()}) == 1 and np.uint64(int(got.first()["fingerprint"], 16)) > 0
