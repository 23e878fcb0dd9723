from difflib import SequenceMatcher

import pytest

import __spark_entry__
from quillon.operators import sessions, similarity
from quillon.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(name, same_rows):
    same_rows(registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def trimmed(msgs, max_chars, max_messages):
    """The messages that stay of one conversation, as (role, text), by plain loops."""
    parts = []
    for m in msgs:
        if m[0] == "user" or not parts:
            parts.append([])
        parts[-1].append(m)
    kept, chars, count = [], 0, 0
    for p in reversed(parts):
        cost = sum(len(t) + 16 for _, t in p)
        if not kept or chars + cost <= max_chars and count + len(p) <= max_messages:
            kept, chars, count = [*p, *kept], chars + cost, count + len(p)
    if len(kept) > max_messages:
        asked = next((m for m in reversed(kept) if m[0] == "user"), kept[0])
        answered = next((m for m in reversed(kept) if m[0] == "assistant"), kept[-1])
        kept = [asked] if max_messages == 1 or asked is answered else [asked, answered]
    if sum(len(t) + 16 for _, t in kept) > max_chars:
        left, cut = max_chars, []
        for r, t in kept:
            t = t[: max(0, left - 16)]
            left -= 16 + len(t)
            cut.append((r, t))
        kept = cut
    return kept


def test_context_trim_against_a_loop(spark, sf):
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").filter("conv_id IS NOT NULL").orderBy("conv_id", "turn").collect():
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    talks |= {-1: [("user", "u" * 300), *[("tool", "t" * 100)] * 6, ("assistant", "a" * 900)], -2: [("assistant", "x" * 50)], -3: [("user", "q" * 2000)]}
    df = spark.createDataFrame([(c, i, r, t) for c, msgs in talks.items() for i, (r, t) in enumerate(msgs)], "conv_id long, turn long, role string, text string")
    for chars, messages in ((1200, 5), (180, 5), (120, 1)):
        got = {}
        for r in sessions.trim_context(df, chars, messages).orderBy("conv_id", "turn").collect():
            got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        want = {c: trimmed(m, chars, messages) for c, m in talks.items()}
        assert {c: sorted(m) for c, m in got.items()} == {c: sorted(m) for c, m in want.items()}


def test_text_memory_search(spark, sf):
    """Against the same measure computed row by row."""
    query = "The that of and to in"
    q, scores = set(query.lower().split()), []
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = set(r["text"].lower().split())
        score = max(len(w & q) / len(w | q), SequenceMatcher(None, query.lower(), r["text"].lower()).ratio())
        scores += [(-score, r["item_id"])] if score >= 0.05 else []
    got = registry.QUERIES["text_memory_search"](spark, sf).collect()
    assert [(r["memory_id"], r["rank"]) for r in got] == [(i, k + 1) for k, (_, i) in enumerate(sorted(scores)[:5])]


def test_memory_filters(spark):
    df = spark.createDataFrame([(1, "total sales by month", "run_sql", True), (2, "total sales by month", "run_sql", False), (3, "total sales by month", "chart", True), (4, "total sales by month", None, None)], "memory_id int, question string, tool_name string, ok boolean")
    assert [r["memory_id"] for r in similarity.similar_texts(df, "total sales by month", success="ok").collect()] == [1, 3]
    assert [r["memory_id"] for r in similarity.similar_texts(df, "Total sales by months", success="ok", tool="run_sql").collect()] == [1]
