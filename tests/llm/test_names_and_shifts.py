"""Decontamination of re-parameterised items: names that begin sentences and lines."""

import numpy as np

from quillon.llm import op6_decontaminate

TOM = "Tom has 5 red marbles. Tom buys 3 more marbles. Tom gives 2 to Ann. How many marbles does Tom have?"


def found(spark, items, docs):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r["doc_id"]: (r["share"], r["changed"]) for r in op6_decontaminate.contaminated(docs, items).collect()}


def test_names_begin_sentences_and_lines(spark):
    other = TOM.replace("Tom", "Sam").replace("Ann", "Eve").replace("5", "7").replace("3", "4").replace("2", "6")
    mixed = other.replace("does Sam", "does Joe")
    lines = "It says:\n" + TOM.replace(" ", "\n").replace("to\n", "to  \n ")
    got = found(spark, [TOM], [other, "So it goes. " + other, lines, TOM.lower(), TOM.replace("How", "how"), mixed])
    assert got == {0: (1.0, 8), 1: (1.0, 8), 2: (1.0, 0), 3: (1.0, 0), 4: (11 / 14, 0)}


def test_values_of_other_lengths(spark):
    item = "A shop near the old river sells pens for 60 cents each and the teacher wants to know how many of them she can buy there with all of her money today"
    changed = item.replace("60 cents", "1 200 cents")
    town = "The bus from Boston to Leeds takes 3 hours but the one that leaves Boston at noon is slower than the first one by far"
    york = town.replace("Boston", "New York")
    apart = " ".join(item.split()[:14]) + " filler" * 60 + " " + " ".join(item.split()[14:])
    got = found(spark, [item], [changed, item.replace("teacher wants", "teacher really wants"), item, apart])
    assert set(got) == {0, 1, 2} and got[0][0] > 0.6 and got[1][0] > 0.6 and got[2] == (1.0, 0)
    assert set(found(spark, [town], [town, york])) >= {0}


def test_slots_of_a_region_agree(spark):
    item = "we ask how many of the 40 plums and pears were left over in that box when inside it only 40 plums and pears had ever been kept by us"
    one = item.replace("40", "7").replace("left over in that box when", "left over in that old box when")
    two = one.replace("only 7", "only 9")
    got = found(spark, [item], [one, two])
    assert got[0][0] > got.get(1, (0, 0))[0]


def test_items_without_a_window(spark):
    short, numbers, rich = "how old is Tom?", "1 2 3 4 5 6 7 8 9 10", "How many apples does Tom have left?"
    docs = ["So he asks: How old is Tom? Nobody", "how old is Ann?", "so 1 2 3 4 5 6 7 8 9 10 end", "so 1 2 3 4 5 6 7 8 9 11 end", "Well. How many apples does Ann have left? Two", "how many apples"]
    assert set(found(spark, [rich], docs)) == {4}
    assert set(found(spark, [short], docs)) == {0}
    assert set(found(spark, [numbers], docs)) == {2}
    assert found(spark, ["", None, " \n"], docs) == {}


def test_recall_of_reparameterised_questions(spark):
    """Questions with other names, numbers (digits or words) and units of the same lengths, inside other text: at least 0.9 are found, and
    none whose values do not map one to one, nor texts that only share words with them."""
    rng = np.random.default_rng(11)
    names = ["Alice", "Bob", "Carol", "Dan", "Erin", "Frank", "Grace", "Henry", "Ivy", "Jack"]
    words = ["seven", "twelve", "twenty-five", "forty", "ninety"]
    things = [f"{a} {b}" for a in ("red", "small", "old", "green", "heavy") for b in ("marbles", "apples", "boxes", "ropes", "stones")]
    forms = [
        "{a} has {x} {t}. {b} has {y} {t}. {a} gives {z} of them to {b} before lunch. How many {t} does {b} have in the end?",
        "{a} buys {x} kg of {t} on Monday and {y} kg on Friday, while {b} sells {z} kg. What is left for {a} after that week?",
        "In the morning {a} walks {x} km with {t}. {b} walks {y} km. Together they rest {z} minutes, so how far did both of them go?",
    ]

    def values(k):
        number = lambda: str(rng.integers(2, 900)) if rng.random() < 0.7 else str(rng.choice(words))
        a, b = rng.choice(names, 2, replace=False)
        x, y, z = (number() for _ in range(3))
        while len({x, y, z}) < 3:
            x, y, z = (number() for _ in range(3))
        return {"a": a, "b": b, "x": x, "y": y, "z": z, "t": things[k % len(things)]}

    items, docs, clean = [], [], []
    for k in range(75):
        form, old, new = forms[k % 3], values(k), values(k)
        items.append(form.format(**old))
        filler = [" ".join(f"plain{x}" for x in rng.integers(0, 5_000, 40)) for _ in range(2)]
        docs.append(f"{filler[0]}. {form.format(**new)} {filler[1]}")
        clean.append(f"{filler[0]}. {old['a']} likes {old['t']} and {new['b']} has {new['x']} of them. {filler[1]}")
        broken = form.format(**new).replace(new["a"], "Zoe", 1).replace(new["b"], "Zoe", 1)  # two people become one
        clean.append(f"{filler[1]} {broken if k % 3 == 0 else filler[0]}")
    items_df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs + clean)), "doc_id long, text string")
    hit = {(r["doc_id"], r["item_id"]) for r in op6_decontaminate.contaminated(df, items_df).collect()}
    recall = sum((k, k) in hit for k in range(len(docs))) / len(docs)
    assert recall >= 0.9, recall
    assert {d for d, _ in hit if d >= len(docs)} == set()
