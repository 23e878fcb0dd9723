"""Archives, clusters and repaired conversations against brute force on small tables with odd rows."""

import base64
import hashlib
import struct
import uuid
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from conftest import rows
from pyspark.sql import functions as F

from quillon.llm import op11_warc, op12_clusters, op13_repair
from quillon.llm.common import shared_dir

LONG = "<p>" + "long page " * 200_000 + "</p>"
PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/4", ""), (None, "http://a/n", "<p>same</p>"), (5, "http://b/\r\nX: y", LONG),
    (6, "http://ü/é?q=a b", "ünï\r\n\r\nWARC/1.1\r\n"), (7, "u", LONG), (7, "u", LONG), (8, "v", "P*M\x18\x00\x00\x00\x00"), (9, "v", "tiny"), (10, "v", "tiny"),
] + [(100 + i, f"http://c/{i}", f"<html><head><title>page {i}</title></head><body>{'text ' * (i % 50)}{i * i}</body></html>") for i in range(300)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"row": F.lit("x"), "sha256": F.lit(1), "page": F.lit(None).cast("int")}).repartition(3)


def written(spark, pages, least=0):
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    op11_warc.write(pages, path, least=least)
    return path, op11_warc.read(spark, path)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, pages, least):
    path, back = written(spark, pages, least)
    got = back.collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    said = [(p, h or "") for p, _, h in PAGES]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((p, len(h.encode()), digest(h)) for p, h in said)
    keep = {h: max((p for p, t in said if t == h and p is not None)) for h in {h for _, h in said}}
    for h, k in keep.items():
        of = [r for r in got if r.payload_digest == digest(h)]
        if len(h.encode()) >= least:
            assert [r.page_id for r in of if r.record_type == "response"] == [k] and all(r.refers_to == (None if r.record_type == "response" else k) for r in of)
        else:
            assert {(r.record_type, r.refers_to) for r in of} == {("response", None)}
    assert {r.html for r in got if r.record_type == "response"} == set(keep) and all(r.html is None for r in got if r.record_type == "revisit")
    assert not any("\n" in r.url for r in got)


def test_archives_are_frames(spark, pages):
    """A dictionary in front, then one frame a record that needs nothing but the dictionary."""
    path, _ = written(spark, pages)
    found = 0
    for r in spark.read.format("binaryFile").load(path).select("content").collect():
        data = bytes(r.content)
        learned, at = op11_warc.dictionary_of(memoryview(data))
        assert struct.unpack_from("<I", data)[0] == 0x184D2A5D and struct.unpack_from("<I", learned)[0] == 0xEC30A437
        while at < len(data):
            if struct.unpack_from("<I", data, at)[0] == 0x184D2A50:
                at += 8
                continue
            one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(learned)).decompressobj()
            text = one.decompress(data[at:])
            assert text.startswith(b"WARC/1.1\r\n") and one.eof
            at, found = len(data) - len(one.unused_data), found + (b"WARC-Type: warcinfo" not in text)
    assert found == len(PAGES)


def test_no_pages(spark, pages):
    assert written(spark, pages.limit(0))[1].count() == 0
    few = pages.filter("page_id < 3")
    assert sorted((r.page_id, r.record_type) for r in written(spark, few)[1].collect()) == [(1, "revisit"), (2, "response")]


def vectors(spark, n=400, far=False):
    rng = np.random.default_rng(7)
    some = [(i, [float(v) for v in rng.normal(size=64) * 0.3 + (i % 5)]) for i in range(n)]
    odd = [(n, None), (n + 1, [0.5] * 63), (n + 2, [None] + [0.5] * 63), (n + 3, [float("nan")] * 64), (n + 4, [float("inf")] * 64), (None, [0.25] * 64), (n + 5, [0.25] * 64), (3, some[3][1]), (n + 6, [-0.0001] * 64)]
    return spark.createDataFrame(some + odd + ([(n + 7, [1e30] * 64)] if far else []), "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "rid": F.lit(0), "x": F.lit(1), "n": F.lit(2)}).repartition(3)


def clustered(given, k, rounds):
    kept = [(r.vec_id, np.floor(1024 * np.array(r.embedding)).astype(object)) for r in given.collect() if r.embedding and len(r.embedding) == 64 and all(v is not None and np.isfinite(v) for v in r.embedding)]
    kept = [(i, np.array([int(v) for v in x], object)) for i, x in kept]
    kept.sort(key=lambda t: (hashlib.sha256(f"3:{'' if t[0] is None else t[0]}".encode()).hexdigest(), list(t[1])))
    cents = [x for _, x in kept[:k]]
    near = lambda x: min((int(((x - c) ** 2).sum()), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, x in kept:
            of[near(x)[1]].append(x)
        cents = [np.array([s // len(of[j]) for s in sum(of[j])], object) if of[j] else c for j, c in enumerate(cents)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    total = Counter()
    for _, j, d in found:
        total[j] += d
    return Counter((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, j, d in found)


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (3, 2), (1, 1), (1000, 1)])
def test_clusters(spark, k, rounds):
    given = vectors(spark, 60 if k == 1000 else 400)
    assert Counter(map(tuple, op12_clusters.cluster(given, k, rounds).collect())) == clustered(given, k, rounds)


def test_clusters_of_nothing_and_too_far(spark):
    assert op12_clusters.cluster(vectors(spark).limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert op12_clusters.cluster(vectors(spark).filter("vec_id = 400")).count() == 0
    with pytest.raises(Exception, match="may not fit"):
        op12_clusters.cluster(vectors(spark, far=True))


def test_rounds_join_without_a_shuffle(spark, monkeypatch):
    """Vectors and bounds lie in equal buckets."""
    plans = []
    first = op12_clusters.Bucketed.__init__

    def seen(self, df, n):
        if "upper" in df.columns:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        first(self, df, n)

    monkeypatch.setattr(op12_clusters.Bucketed, "__init__", seen)
    op12_clusters.cluster(vectors(spark), 4, 3)
    assert len(plans) == 3 and "Join" in plans[2] and not any("Exchange" in p for p in plans)


def test_bounds_skip_scans():
    """Most vectors keep their cluster unscanned once the centroids stand still."""
    x = np.random.default_rng(1).integers(-500, 500, (1000, 8)) + np.repeat(np.arange(4), 250)[:, None] * 5000
    cents = [x[i].tolist() for i in (0, 250, 500, 750)]
    a, u, l = op12_clusters.Round(cents, None).assign(x, np.full(1000, -1), np.zeros(1000), np.zeros(1000))
    moved = [[v + 3 for v in c] for c in cents]
    now, scanned = op12_clusters.Round(moved, cents), []
    real = op12_clusters.distances
    op12_clusters.distances = lambda p, c: scanned.append(len(p)) or real(p, c)
    b, _, _ = now.assign(x, a, u, l)
    op12_clusters.distances = real
    assert (b == real(x, now.centroids).argmin(1)).all() and sum(scanned) == 0


ROLES = ["user", "assistant", "system", None, "", "tool", "users"]
SAID = ["Hello.", "Hello", "", "  ", None, "What? ", "same text!", "mehr ", "a.b", "é!", "x" * 50 + "."]


def turns(spark, convs=150, longest=12, seed=5):
    rng = np.random.default_rng(seed)
    pick = lambda of: of[rng.integers(len(of))]
    given = []
    for c in range(convs):
        for t in range(rng.integers(1, longest)):
            turn = None if rng.random() < 0.05 else int(t if rng.random() < 0.9 else rng.integers(-3, 3) * 1000)
            given.append((None if c == 3 else c, turn, pick(ROLES) if rng.random() < 0.4 else ROLES[t % 2], f"turn {t} of {c}." if rng.random() < 0.5 else pick(SAID)))
    given += given[:20]
    return spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "n": F.lit("z"), "seg": F.lit(0), "audit": F.lit("q")}).repartition(4)


def held_against_sql(given, got):
    con = duckdb.connect()
    con.register("conversations", given.select("conv_id", "turn", "role", "text").toArrow())
    assert rows(got.toPandas()) == rows(con.sql(op13_repair.ORACLE).df())


def test_repair(spark):
    given = turns(spark)
    held_against_sql(given, op13_repair.repair_damaged(given))


@pytest.mark.parametrize("shift", [1, 2])
def test_long_conversations_are_folded(spark, monkeypatch, shift):
    """Segments of two or four rows, folded over several levels."""
    monkeypatch.setattr(op13_repair, "SHIFT", shift)
    given = turns(spark, 4, 120, 9)
    held_against_sql(given, op13_repair.repair_damaged(given))


def test_least_audit_of_all_edits(spark):
    """All edit strings up to two inserts in a place, tried one after the other."""
    import itertools
    import re

    def best(conv):
        seen, options = set(), []
        for role, text in conv:
            bad = not text.strip(" \t\n\x0b\x0c\r") or (role, text) in seen
            seen.add((role, text))
            cut = 0 if bad or text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else 5
            options.append([("D", 2, None)] + ([] if bad else [("K", cut, (role, text)), ("R", cut + 1, ("user", text)), ("R", cut + 1, ("assistant", text))]))
        inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
        found = None
        for edits in itertools.product(*options):
            for gaps in itertools.product(inserts, repeat=len(conv) + 1):
                audit, cost, out = "", 0, []
                for gap, e in zip(gaps, [*edits, None], strict=True):
                    audit, cost, out = audit + "I" * len(gap), cost + 5 * len(gap), out + [(r, "") for r in gap]
                    if e:
                        audit, cost, out = audit + e[0], cost + e[1], out + [e[2]] * (e[2] is not None)
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (found is None or (cost, audit) < found[:2]):
                    found = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
        return found

    rng = np.random.default_rng(2)
    convs = [[(ROLES[i] or " ", SAID[j] or " ") for i, j in zip(rng.integers(0, 7, 3), rng.integers(0, 11, 3), strict=True)] for _ in range(40)]
    convs += [[("system", "a."), ("assistant", "b."), ("user", "c.")], [("assistant", "b."), ("assistant", "c.")], [("user", "a"), ("assistant", "b")], [("user", "x.")]]
    rows_ = [(f"c{c}", t, r, s, 1) for c, conv in enumerate(convs) for t, (r, s) in enumerate(conv)]
    got = {r.key: (r.cost, r.audit, r.repaired_sha256) for r in op13_repair.repair(spark.createDataFrame(rows_, "key string, turn long, role string, text string, n long")).collect()}
    for c, conv in enumerate(convs):
        assert got[f"c{c}"] == best(conv), conv


def test_all_rows_dropped(spark):
    hit = [(c, t) for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    given = spark.createDataFrame([(c, t, "user", "x.") for c, t in hit[:1]], "conv_id int, turn long, role string, text string")
    assert [tuple(r) for r in op13_repair.repair_damaged(given).collect()] == [(hit[0][0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert op13_repair.repair_damaged(given.limit(0)).count() == 0
