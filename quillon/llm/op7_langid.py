"""Language identification by compression.

Each learned language has a zstandard raw-content dictionary. A text, lower-cased and reduced to its letters, is
cut into chunks, every chunk is compressed with every dictionary, and the language with the fewest bytes over the
whole text wins. Narrow margins are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import table

#: Bounds of the training sample: labelled documents a language, and characters of each, a span at a random place.
SAMPLE_DOCS, SPAN = 400, 300
CHUNK, LEVEL = 2_048, 6
#: Relative gain over the second language below which a prediction is rejected.
MIN_MARGIN = 0.01
#: Share of the byte gain that counts as evidence in `score`.
TEMPER = 0.2
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> str:
    return " ".join(_LETTERS.findall(text.lower()))


def dictionaries(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """Raw-content dictionaries from at most SAMPLE_DOCS documents of every language; languages with more labelled rows come first.

    Rows with a null language or a text without letters teach nothing. The sample is by hash of id and text, so reruns agree.
    It comes to the driver: SAMPLE_DOCS * SPAN characters a language at most, whatever the input. All of it goes into the dictionary.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(7), doc_id, text).alias("h"))
    counts = rows.groupBy("lang").count().collect()  # a row a language, as the model itself
    if not counts:
        return []
    # A first cut by hash, beside the scan, leaves about twice the sample; languages with fewer rows keep all.
    size = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], r["count"])])
    unit = F.pmod("h", F.lit(1_000_000)) / 1_000_000
    near = rows.filter(unit * F.element_at(size, F.col("lang")) <= 2.0 * SAMPLE_DOCS).withColumn("text", F.substr("text", F.pmod(F.xxhash64("h"), F.greatest(F.char_length("text") - SPAN, F.lit(0)) + 1).cast("int") + 1, F.lit(SPAN)))
    best = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= SAMPLE_DOCS)
    taken: dict[str, list[bytes]] = {}
    for r in best.select("lang", "text", "r").orderBy("lang", "r").collect():
        if said := letters(r["text"]).encode():
            taken.setdefault(r["lang"], []).append(said)
    taken = {r["lang"]: list(dict.fromkeys(taken[r["lang"]])) for r in sorted(counts, key=lambda r: (-r["count"], r["lang"])) if r["lang"] in taken}
    return [(k, b"\n".join(v)) for k, v in _cleaned(taken).items()]


def _cleaned(taken: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """Without the sampled texts that the other half of the sample puts in another language: a wrong label would
    otherwise put a text's copies there too. Languages of under four texts are left as they are."""
    if len(taken) < 2 or min(map(len, taken.values())) < 4:
        return taken
    names, kept = list(taken), {k: [] for k in taken}
    for half in (0, 1):
        coders = _coders([b"\n".join(v[half::2]) for v in taken.values()])
        for k, v in taken.items():
            kept[k] += [t for t in v[1 - half :: 2] if names[_judge(t, coders)[0]] == k]
    return {k: v or taken[k] for k, v in kept.items()}


def _coders(dicts: list[bytes]) -> list:
    import zstandard

    out = []
    for raw in dicts:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
    return out


def _judge(data: bytes, coders: list) -> tuple[int, float, float]:
    """Index of the best language, its score and its margin."""
    size = np.zeros(len(coders))
    for i in range(0, len(data), CHUNK):
        piece = data[i : i + CHUNK]
        for k, c in enumerate(coders):
            size[k] += len(c.compress(piece))
    best = int(size.argmin())
    rest = np.delete(size, best)
    margin = 1.0 if not len(rest) else float((rest.min() - size[best]) / rest.min())
    return best, float(1 / np.exp2(np.maximum(-TEMPER * 8 * (size - size[best]), -1000)).sum()), margin


def identify(docs: DataFrame, learned: list[tuple[str, bytes]], doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds nothing to the rows but predictions: doc_id, the `keep` columns, lang_pred, score, margin, rejected.

    A null text, or one without letters, is `und` with score 0 and rejected, and so is every text when nothing
    was learned. Equal sizes go to the language with more labelled rows, then to the first in code point order. Repeated rows are judged
    alike; an empty table gives no rows. Long texts are read whole, in chunks. Kept columns named like a result are left out.
    """
    keep = tuple(k for k in keep if k not in ("lang_pred", "score", "margin", "rejected"))
    cols = list(dict.fromkeys([doc_id, text, *keep]))
    kept = list(dict.fromkeys([doc_id, *keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders([raw for _, raw in learned])
        for batch in batches:
            found = []
            for t in batch.column(text):
                said = letters(t.as_py() or "")
                if not coders or not any(map(str.isalpha, said)):
                    found.append((UNKNOWN, 0.0, 0.0, True))
                else:
                    best, score, margin = _judge(said.encode(), coders)
                    found.append((learned[best][0], score, margin, margin < min_margin))
            a, b, c, d = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.float64()), pa.array(d, pa.bool_())], names=[*kept, "lang_pred", "score", "margin", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", lang_pred string, score double, margin double, rejected boolean"
    return docs.select(*cols).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", modulus: int = 4, remainder: int = 2):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document of `documents` with its language, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    learned = dictionaries(docs.filter(~held_out()))
    return identify(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
