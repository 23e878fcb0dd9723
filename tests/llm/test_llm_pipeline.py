"""Every pipeline stage against a brute-force version, each on what its predecessor kept."""

import corpus_pipeline
from quillon.llm import op7_langid, op10_mix
from quillon.llm.common import materialize, table
from test_llm_operators import without_repeats
from test_near_copies import brute


def test_stages(spark, sf, duck):
    docs = table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), name)
        kept[name] = (before.toPandas(), docs.toPandas())
        if name != "mix":
            assert docs.columns == before.columns
    before, after = kept["language"]
    learned = op7_langid.dictionaries(table(spark, sf, "documents"))
    coders = op7_langid._coders([raw for _, raw in learned])
    fine = {i for i, t in zip(before.doc_id, before.text) if (s := op7_langid.letters(t)) and op7_langid._judge(s.encode(), coders)[2] >= op7_langid.MIN_MARGIN}
    assert set(after.doc_id) == fine and len(fine) > 0.9 * len(before)
    before, after = kept["near_duplicates"]
    before = before.sort_values("doc_id")
    assert sorted(after.doc_id) == sorted(set(brute(list(zip(before.doc_id, before.text))).values()))
    before, after = kept["substrings"]
    want = without_repeats(sorted(zip(before.doc_id, before.text)))
    text = dict(zip(before.doc_id, before.text))
    assert {i: t for i, t in zip(after.doc_id, after.text)} == {i: w[2] if w[1] else text[i] for i, w in want.items()}
    assert (after.n_chars == after.text.str.len())[[want[i][1] > 0 for i in after.doc_id]].all()
    before, after = kept["decontamination"]
    items = [" ".join(w.strip(".,;:!?").lower() for w in t.split()) for t in table(spark, sf, "benchmark").toPandas().text]
    leaks = {i for i, t in zip(before.doc_id, before.text) if any(x in " ".join(w.strip(".,;:!?").lower() for w in t.split()) for x in items)}
    gone = set(before.doc_id) - set(after.doc_id)
    assert leaks and leaks <= gone and len(gone) < 0.1 * len(before)
    before, after = kept["mix"]
    duck.register("left_over", before)
    want = duck.sql(op10_mix.mix_sql("left_over", "doc_id, CAST(coalesce(words, 0) AS BIGINT) AS taken")).df()
    want = {i: k for i, k in zip(want.doc_id, want.taken) if k > 0}
    assert dict(zip(after.doc_id, after.taken)) == want


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "taken" in out.columns


LONG = " ".join(f"word{i % 997} the of and a house that was" for i in range(4_000))
ROWS = [
    (1, "The house was built in the year when the old mill by the river was closed for good", "en", "a", 10), (1, "The house was built in the year when the old mill by the river was closed for good", "en", "a", 10),
    (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \n\t", "en", None, 3), (5, LONG, "en", "b", len(LONG)), (None, "Nobody knows why the bridge across the water was never opened to the people", None, None, 70), (6, "12345 !!!", None, "a", 9), (7, "ok", "en", "c", 2),
    (7, "The two towns were joined by a road that led through the forest and over the hill", "en", "c", 80),
]
#: Names that operators use inside.
EXTRA = {"n_words": "x", "n_removed": "y", "rejected": "z", "score": "s", "root": "r", "cls": "c", "fp": "f", "share": "w", "taken": "t", "key": "k", "text_hash": "h"}


def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty and long texts, ties, repeated rows and foreign columns have the results that the stages state; empty tables stay empty."""
    docs = odd(spark)
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mix":
            assert out.columns == docs.columns
            assert all(r[k] == v for r in out.collect() for k, v in EXTRA.items())
        got[name] = sorted((r["doc_id"] or 0, r["text"] or "" if name != "mix" else r["taken"]) for r in out.collect())
        assert stage(spark, docs.limit(0), sf).count() == 0
    texts = sorted((i or 0, t or "") for i, t, *_ in ROWS)
    assert got["language"] == [x for x in texts if any(map(str.isalpha, x[1]))]
    blank = {(3, ""), (4, " \n\t")}  # one group with the null text of row 2, whose id is the smallest
    assert got["near_duplicates"] == [x for k, x in enumerate(texts) if x not in blank and x not in texts[:k]]
    assert [i for i, _ in got["substrings"]] == [i for i, _ in texts] and {t for i, t in got["substrings"] if i in (2, 3, 4, 7)} == {t for i, t in texts if i in (2, 3, 4, 7)}
    assert got["decontamination"] == texts
    assert {i for i, _ in got["mix"]} <= {i for i, t in texts if t.strip()} and got["mix"]


def test_a_leak_goes_without_its_namesakes(spark, sf):
    item = table(spark, sf, "benchmark").first()["text"]
    docs = spark.createDataFrame([(1, item, "x"), (1, "A clean text with the same id", "x"), (None, item, "x"), (None, "A clean text without an id", "x")], "doc_id long, text string, share string")
    assert sorted(r["text"] for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, sf).collect()) == ["A clean text with the same id", "A clean text without an id"]
