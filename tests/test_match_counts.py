from quillon.operators import match_index


def test_terms_are_counted_where_documents_are_read(spark, monkeypatch):
    """Postings equal plain counts over every kind of white space; they take one shuffle, to their folders."""
    monkeypatch.setattr(match_index, "FLUSH", 3)
    texts = {1: "A a\tb\x0bC\fc\r\nc d  e", 2: None, 3: "", 4: "  ", 5: "É é É straße", 6: " ".join(f"w{i % 7}" for i in range(50))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = match_index.build(docs)
    want = docs.select("doc_id", match_index.terms(docs.text).alias("w")).collect()
    got = {(r.doc_id, r.term): (r.tf, r.len) for r in index.table("postings").collect()}
    assert got == {(r.doc_id, t): (r.w.count(t), len(r.w)) for r in want for t in r.w}
    assert index.table("sizes").filter("of IS NULL").first().n == 6
