"""What op9's tasks hold while they count."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quillon.llm import op9_tokens


def test_texts_are_not_held_as_words(monkeypatch):
    """12 MB of text with 500 different words, as one batch: 2 million words were held at a time before, over 80 MB."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(100, 600, 10_000)) for _ in range(240)]
    b = pa.RecordBatch.from_arrays([pa.array(range(240)), pa.array(texts)], names=["doc_id", "text"])
    want = np.unique(np.concatenate([t.split() for t in texts]), return_counts=True)
    solved = op9_tokens.Solved({}, {"w": -1.0, "w1": -1.0, op9_tokens.SPACE: -1.0} | {str(d): -1.0 for d in range(10)})
    tracemalloc.start()
    rows = pa.Table.from_batches(solved.totals(iter([b]), "doc_id", "text")).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6
    assert rows["doc_id"] == list(range(240)) and rows["n_words"] == [10_000] * 240
    one = {w: op9_tokens.trie_counts({w.encode()}, solved.pieces)[w.encode()] for w in want[0].tolist()}
    assert rows["n_tokens"] == [sum(one[w] for w in t.split()) for t in texts]
    monkeypatch.setattr(op9_tokens, "COUNTED", 100)
    counted: dict[str, int] = {}
    for r in op9_tokens.count_words(iter([b.select(["text"])])):
        for w, n in zip(*r.to_pydict().values(), strict=True):
            counted[w] = counted.get(w, 0) + n
    assert counted == dict(zip(want[0].tolist(), want[1].tolist(), strict=True))
