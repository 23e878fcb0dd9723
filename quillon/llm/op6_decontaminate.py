"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units become typed placeholders, word for word, so a question with other numbers or names keeps its
template. Windows of the template are hash-joined between documents and benchmark items; he and she are one word there. Matches of
one item at one offset in one document are kept if their slots agree: an item's value always stands for the same value in
the document, while two of its values may become equal. Offsets of one region, which differ where a value has another number of words or a word is
put in, are added up as far as their slots agree. Only documents that hold three (two, one) neighbouring literal words of some window,
found by a plain split into words, are canonicalised; the others cannot match. A document is contaminated if the kept windows cover enough of an item. Items
without a window of their own are matched whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table

WINDOW = 8
#: Words of a window that must not be placeholders, at least.
LITERALS = 4
#: Share of an item's windows that must match.
MIN_SHARE = 0.5
#: Matches of an item whose offsets differ by at most so many words from the next are one region.
SHIFT = 8
#: Windows of items, and hashes of documents, above this number are joined by a shuffle instead of a broadcast (16 bytes each).
BROADCAST_WINDOWS = 1_000_000
#: Keys of windows up to this number stand in the filter of the documents; with more, all documents are canonicalised.
KEYS = 100_000
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Units that may follow a number.
UNITS = "kg g mg lb oz km m cm mm mi ft in l ml h hr hrs min s sec ms hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents cent percent % kmh mph meters meter metres metre miles mile grams gram liters liter litres litre pounds pound degrees degree".split()
#: Numbers in words.
_UP_TO_NINE = "one two three four five six seven eight nine".split()
_NUMBERS = [*_UP_TO_NINE, *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()]
# Branches by first letter, so that most words fail at once.
_BY_LETTER = "|".join(f"{a}(?:{'|'.join(w[1:] for w in _NUMBERS if w[0] == a)})" for a in sorted({w[0] for w in _NUMBERS}))
_WORDS = rf"(?:{_BY_LETTER})(?:-(?:{'|'.join(_UP_TO_NINE)}))?"
_SPLIT = r"[\x20\x09-\x0D]+"
#: A capitalised word, any one and one inside a sentence: a capital, perhaps more capitals and apostrophes, small letters, and what follows (O'Brien, McDonald).
_NAME = r"(?:\p{Lu}|(?<=\p{Lu})['’])++\p{Ll}[\p{L}'’\-]*+"
_NAMES = rf"""(?<![^\x20\x09-\x0D])["'(\[“‘]*(?!(?i:{_WORDS})(?!\p{{L}})){_NAME}(?=[\p{{P}}\p{{S}}]*(?:[\x20\x09-\x0D]|$))"""
_INNER = rf"(?<=[\p{{L}}\d,;][\x20\x09-\x0D]{{1,8}})(?!(?i:{_WORDS})(?!\p{{L}})){_NAME}(?=[\p{{P}}\p{{S}}]*(?:[\x20\x09-\x0D]|$))"
#: Pronouns that go with a name. They are literals of which any stands for any.
PRONOUNS = "he she him her his hers himself herself".split()

_NUMBER = rf"(?<![^\x20\x09-\x0D])(?:[+\-(\[\"'$€£]*\d[^\x20\x09-\x0D]*|[(\[\"'“‘]*{_WORDS}\p{{P}}*(?![^\x20\x09-\x0D]))"


def template(text: Column, name: str = _NAMES) -> Column:
    """Words of the canonical template, one for each word of the text.

    Number: starts with a digit, after signs, currency or brackets, or is a number in words (twenty-five, a hundred). Unit: one of UNITS after a number. Name:
    a capital with small letters after it, also inside (McDonald) or behind an apostrophe, wherever it stands, so that a name that begins a sentence, a line or a quotation is a slot
    like any other. Other words are lower-cased and lose punctuation at both ends.
    """
    t = F.regexp_replace(text, name, NAME)
    t = F.regexp_replace(F.lower(t), _NUMBER, NUM)
    t = F.regexp_replace(t, rf"(?<=<num>[\x20\x09-\x0D])(?:{'|'.join(UNITS)})[.,;:!?)\]]*(?![^\x20\x09-\x0D])", UNIT)
    t = F.regexp_replace(t, r"(?<=[\p{L}\d>])[\p{P}\p{S}&&[^<>]]+(?=[\x20\x09-\x0D]|$)", "")
    t = F.regexp_replace(t, r"(?<![^\x20\x09-\x0D])[\p{P}\p{S}&&[^<]]+(?=[\p{L}<])", "")
    return F.split(t, _SPLIT)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)`, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _word(word: Column) -> Column:
    """Hash of one word; pronouns share one."""
    return F.xxhash64(F.when(word.isin(PRONOUNS), PRONOUNS[0]).otherwise(word))


def _runs(tokens: Column, size: int) -> Column:
    """Hashes of all runs of so many tokens, at most three."""
    h = F.transform(tokens, _word)
    if size == 1:
        return h
    if size == 2:
        return _let(h, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 2), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + 1))))
    return _let(h, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2))))


def _tokens(text: Column) -> Column:
    """Runs of letters and digits: parts of words whose edges no punctuation moves."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _key(words: Column) -> Column:
    """struct(size, h): the longest in letters of the runs of three (two, one) tokens inside literal words that stand together; null if there are none."""
    parts = F.flatten(F.transform(words, lambda w: F.when(w.isin(NUM, NAME, UNIT, ""), F.array(F.lit(NUM))).otherwise(_tokens(w))))

    def best(p: Column, size: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - size + 1, F.lit(1))), lambda i: F.slice(p, i, F.lit(size)))
        whole = F.filter(runs, lambda r: (F.size(r) == size) & ~F.array_contains(r, NUM))
        longest = F.array_max(F.transform(whole, lambda r: F.struct(F.char_length(F.array_join(r, "")).alias("letters"), r.alias("run"))))["run"]
        return F.when(longest.isNotNull(), F.struct(F.lit(size).alias("size"), F.get(_runs(longest, size), F.lit(0)).alias("h")))

    return _let(parts, lambda p: F.coalesce(best(p, 3), best(p, 2), best(p, 1)))


def _among(values: list[int]) -> Callable[[Column], Column]:
    return lambda x: x.isin(values)


def _may_hold(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that hold the key of any window: all that can match, and few others. A window without a key lets all pass."""
    keys = bench.select("key.size", "key.h").distinct()
    if keys.count() > KEYS:
        return docs
    found = keys.collect()
    if any(r["size"] is None for r in found):
        return docs
    by_size = {n: sorted(r["h"] for r in found if r["size"] == n) for n in (1, 2, 3)}

    def holds(tokens: Column) -> Column:
        some = [F.exists(F.when(F.size(tokens) >= n, _runs(tokens, n)).otherwise(F.array().cast("array<bigint>")), _among(of)) for n, of in by_size.items() if of]
        return reduce(lambda a, b: a | b, some) if some else F.lit(False)

    return docs.filter(_let(_tokens(F.col("said")), holds))


def _hashes(words: Column, size: int) -> Column:
    """Hash of the template window at each place: hashes of 1, 2, 4, ... words are put together, the last two overlapping."""

    def join(h: Column, width: int, n: Column) -> Column:
        shift = min(width, size - width)
        if shift == 0:
            return F.slice(h, F.lit(1), F.greatest(n - size + 1, F.lit(0)))
        both = F.zip_with(h, F.slice(h, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y))
        return _let(both, lambda z: join(z, width + shift, n))

    return _let(words, lambda w: _let(F.transform(w, _word), lambda h: join(h, 1, F.size(w))))


def _slots(words: Column, said: Column, at: Column, size: int) -> Column:
    """array<struct<k, kind, value>> of the placeholders in the window at place `at`."""
    one = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.struct((at + k).alias("k"), F.get(words, at + k).alias("kind"), F.lower(F.get(said, at + k)).alias("value")))
    return F.filter(one, lambda s: s["kind"].isin(NUM, NAME, UNIT))


def _agree(pairs: Column) -> Column:
    """Whether each of an item's values stands for one value in the document."""
    kinds = lambda *of: F.size(F.array_distinct(F.transform(pairs, lambda x: F.struct(x["kind"], *[x[k] for k in of]))))
    return kinds("theirs", "ours") == kinds("theirs")


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per document and item found in it: doc_id, text_hash (xxhash64 of the text), item_id, share (of the item's windows), windows, changed (slots with other values).

    Null and empty texts, on either side, match nothing. Items with fewer words than a window, or with too few literal words in
    every window, must be found whole, and with the same slots if they have fewer than LITERALS literal words in all. Repeated rows give one row, texts that share an id one each. Null ids are ids. Empty tables give no
    rows; other columns are ignored.
    """
    literal = lambda w: ~w.isin(NUM, NAME, UNIT, "")
    base = (
        items.select(F.col(item_id).alias("item_id"), F.regexp_replace(F.coalesce(F.col(item_text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("said"))
        .filter("said != ''")
        .withColumn("inner", template(F.col("said"), _INNER))
        .withColumns({"n": F.size("inner"), "literals": F.size(F.filter("inner", literal))})
        .withColumn("rich", F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1))), lambda at: F.size(F.filter(F.slice("inner", at, F.lit(window)), literal)) >= min(LITERALS, window)))
        .withColumn("whole", (F.col("n") < window) | ~F.exists("rich", lambda x: x))
        # A document may have the words that begin sentences, or all words, in small letters: then they are literals there. It may begin a sentence with the item.
        .withColumn("first", F.concat(F.upper(F.substring("said", 1, 1)), F.expr("substring(said, 2)")))
        .withColumn("words", F.explode(F.array(template(F.col("said")), F.col("inner"), template(F.lower("said")), template(F.col("first")))))
        .withColumn("said", F.split("said", _SPLIT))
    )
    short = sorted(r["n"] for r in base.filter(F.col("n") < window).select("n").distinct().collect())

    def windows_of(rows: DataFrame, size: int) -> DataFrame:
        out = rows.select("item_id", "words", "said", "rich", "whole", "literals", F.posexplode(_hashes(F.col("words"), size)).alias("at", "h"))
        chosen = out.filter(F.col("whole") | F.get("rich", F.col("at")))
        return chosen.select("item_id", "whole", "literals", "at", "h", _slots(F.col("words"), F.col("said"), F.col("at"), size).alias("slots"), _key(F.slice("words", F.col("at") + 1, F.lit(size))).alias("key"))

    bench = windows_of(base.filter(F.col("n") >= window), window)
    for size in short:
        bench = bench.union(windows_of(base.filter(F.col("n") == size), size))
    bench = materialize(bench.distinct(), "benchmark-windows")
    sizes = bench.groupBy("item_id").agg(F.countDistinct("at").alias("in_item"), F.first("whole").alias("whole"), F.first("literals").alias("literals"))
    keys = bench.select("h").distinct()
    wide = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("said"))
    held = _may_hold(wide, bench)
    # An outer generator infers no filter, which would canonicalise every text once more, before the keys are looked for.
    hits = held.select("doc_id", "said", F.explode_outer(_let(template(F.col("said")), lambda w: F.array(*[_hashes(w, k) for k in (*short, window)]))).alias("hs")) if short else held.select("doc_id", "said", _hashes(template(F.col("said")), window).alias("hs"))
    small = bench.count() <= BROADCAST_WINDOWS
    keys = F.broadcast(keys) if small else keys
    # Each document keeps only its hits; texts are read again for the few documents that have some.
    bench = bench.drop("key")
    found = hits.select("doc_id", F.xxhash64("said").alias("of"), F.posexplode_outer("hs").alias("place", "h")).join(keys, "h")
    matched = found.join(F.broadcast(bench) if small else bench, "h").select("doc_id", "of", "item_id", "at", "place", "slots").distinct()
    matched = materialize(matched, "matched-windows")
    slotted = matched.filter(F.size("slots") > 0)
    needed = materialize(slotted.select(F.col("of").alias("o")).distinct(), "slotted-texts")
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_WINDOWS else needed
    texts = wide.withColumn("of", F.xxhash64("said")).select(F.col("doc_id").alias("d"), F.col("of").alias("o"), "said").join(needed, "o", "left_semi").distinct()
    pairs = slotted.join(texts, (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("of") == F.col("o"))).select(
        "doc_id", "of", "item_id", (F.col("place") - F.col("at")).alias("offset"), "place", "at", F.explode("slots").alias("s"), F.split("said", _SPLIT).alias("said")
    )
    pairs = pairs.select("doc_id", "of", "item_id", "offset", F.col("s.k").alias("k"), F.col("s.value").alias("theirs"), F.lower(F.get("said", F.col("s.k") + F.col("offset"))).alias("ours"), F.col("s.kind").alias("kind")).distinct()
    key = ["doc_id", "of", "item_id", "offset"]
    empty = F.array().cast("array<struct<k:int,kind:string,theirs:string,ours:string>>")
    slots = pairs.groupBy(*key).agg(F.collect_set(F.struct("k", "kind", "theirs", "ours")).alias("pairs"))
    runs = matched.withColumn("offset", F.col("place") - F.col("at")).groupBy(*key).agg(F.collect_set("at").alias("ats"))
    same = [runs[k].eqNullSafe(slots[k]) for k in key]
    runs = runs.join(slots, same, "left").select(*[runs[k] for k in key], "ats", F.coalesce("pairs", empty).alias("pairs")).filter(_agree(F.col("pairs")))
    near = Window.partitionBy("doc_id", "of", "item_id").orderBy("offset")
    runs = runs.withColumn("far", F.when(F.col("offset") - F.lag("offset").over(near) > SHIFT, 1).otherwise(0)).withColumn("region", F.sum("far").over(near))
    # The longest run of a region first, then the others where their slots agree with what is taken.
    runs = runs.groupBy("doc_id", "of", "item_id", "region").agg(F.sort_array(F.collect_list(F.struct((-F.size("ats")).alias("rank"), "offset", "ats", "pairs"))).alias("runs"))

    def add(taken: Column, run: Column) -> Column:
        both = F.struct(F.array_union(taken["ats"], run["ats"]).alias("ats"), F.array_union(taken["pairs"], run["pairs"]).alias("pairs"))
        return _let(both, lambda x: F.when(_agree(x["pairs"]), x).otherwise(taken))

    none = F.struct(F.array().cast("array<int>").alias("ats"), empty.alias("pairs"))
    runs = runs.withColumn("taken", F.aggregate("runs", none, add))
    runs = runs.select("doc_id", F.col("of").alias("text_hash"), F.col("item_id").alias("found_id"), F.size("taken.ats").alias("windows"), F.size(F.array_distinct(F.transform(F.filter("taken.pairs", lambda x: x["ours"] != x["theirs"]), lambda x: x["k"]))).alias("changed"))
    runs = runs.join(sizes, F.col("found_id").eqNullSafe(F.col("item_id"))).withColumn("share", F.col("windows") / F.col("in_item"))
    runs = runs.filter(~F.col("whole") | ((F.col("windows") == F.col("in_item")) & ((F.col("literals") >= LITERALS) | (F.col("changed") == 0))))
    return runs.groupBy("doc_id", "text_hash", "item_id").agg(F.max("share").alias("share"), F.max_by("windows", "share").alias("windows"), F.max_by("changed", "share").cast("long").alias("changed")).filter(F.col("share") >= min_share)


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows, with all their columns, in whose text no item is found, whatever their ids. Null and empty texts stay."""
    bad = contaminated(docs, items, doc_id, text, **more).select(F.col("doc_id").alias("__bad"), F.col("text_hash").alias("__hash")).distinct()
    bad = materialize(bad, "contaminated-rows")
    if bad.count() <= BROADCAST_WINDOWS:
        bad = F.broadcast(bad)
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__bad"]) & (F.xxhash64(docs[text]) == bad["__hash"]), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (sorted), changed_slots."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("text_hash"))
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    found = found.agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.sum("changed").alias("changed_slots"))
    out = docs.join(found, docs["doc_id"].eqNullSafe(F.col("d")) & (docs["text_hash"] == F.col("t")), "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("changed_slots", F.lit(0)).alias("changed_slots"))
