"""Conversation structure repair by a recursive query of DuckDB inside hash-partitioned batches.

Rows are edited (keep, rerole, delete, insert) until their role initials read `(s?(ua)+)?`. The grammar has four states: start,
after s, after u, after a. Each recursion advances one turn for all conversations of a batch and keeps, for each state, the least
cost and among equals the least audit. The audit fixes the result: after a state only one role can follow, but for a leading s.

Conversations are cut into segments of at most 64 rows, solved from all four states, and segments are folded by the same recursion
(min-plus products), so that no task holds a whole conversation. Only its repaired text is read by one task, as a stream, since
SHA-256 is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, table

#: A fold takes 2^SHIFT parts at most; a batch about BATCH rows.
SHIFT, BATCH = 6, 100_000
SPACE = " \t\n\x0b\x0c\r"
INSERT, TRUNCATED, DELETE, REROLE = 5, 5, 2, 1
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Part of a text that orders rows of one turn before its digest does.
HEAD = 32


def transitions() -> list[tuple[str, int, int, int, str]]:
    """(code, from, to, cost, audit) for one row: code is the role's initial (s, u, a or x for others), a capital if truncated.

    Deletes come before inserts in the least audit, so an insert stands right before a kept row or at the end; two in a row return to
    the same choices and never pay.
    """
    takes = {START: ("u", AFTER_U), AFTER_S: ("u", AFTER_U), AFTER_U: ("a", AFTER_A), AFTER_A: ("u", AFTER_U)}
    found = []
    for initial in "suax":
        for code, extra in ((initial, 0), (initial.upper(), TRUNCATED)):
            for state in takes:
                found.append((code, state, state, DELETE, "D"))
                if state == START and initial == "s":
                    found.append((code, state, AFTER_S, extra, "K"))
                for at, cost, audit in ((state, 0, ""), (takes[state][1], INSERT, "I")):
                    wanted, to = takes[at]
                    found.append((code, state, to, cost + extra + (0 if wanted == initial else REROLE), audit + ("K" if wanted == initial else "R")))
    return found


#: One step for all groups (k) of a batch. USING KEY keeps the newest row of each state; a state once reached stays (its row may be deleted).
_FOLD = """
WITH RECURSIVE dp(k, start, state, pos, best) USING KEY (k, start, state) AS (
  SELECT k, s, s, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': ''}} FROM (SELECT DISTINCT k FROM parts), (SELECT unnest({starts}) AS s)
  UNION
  SELECT d.k, d.start, t.dst, d.pos + 1, min({{'cost': d.best.cost + t.cost + {more_cost}, 'audit': d.best.audit || t.audit || {more_audit}}})
  FROM dp d JOIN {step} GROUP BY d.k, d.start, t.dst, d.pos
)
SELECT k, start, state, best.cost AS cost, best.audit AS audit FROM dp
"""
_ROWS = {"step": "parts p ON p.k = d.k AND p.pos = d.pos + 1 JOIN moves t ON t.code = p.code AND t.src = d.state", "more_cost": f"{DELETE} * p.deletes", "more_audit": "repeat('D', p.deletes)"}
_PARTS = {"step": "parts t ON t.k = d.k AND t.pos = d.pos + 1 AND t.src = d.state", "more_cost": "0", "more_audit": "''"}
_SOLVED = "key string, seg long, src int, dst int, cost long, audit string"


def _moves() -> pa.Table:
    # A row that must go has no other move.
    found = transitions() + [("-", s, s, 0, "") for s in range(4)]
    return pa.table({n: list(v) for n, v in zip(("code", "src", "dst", "cost", "audit"), zip(*found, strict=True), strict=True)})


def _query(parts: pa.Table, rows: bool, starts: list[int]) -> pa.Table:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.register("given", parts)
    con.register("moves", _moves())
    # The groups of a batch get numbers; parts of a group are numbered from 1 in their order.
    con.sql("CREATE TEMP TABLE groups AS SELECT row_number() OVER () AS k, key, seg FROM (SELECT DISTINCT key, seg FROM given)")
    con.sql("CREATE TEMP TABLE parts AS SELECT k, dense_rank() OVER (PARTITION BY k ORDER BY part) AS pos, given.* EXCLUDE (key, seg, part) FROM given JOIN groups USING (key, seg)")
    sql = _FOLD.format(starts=starts, **(_ROWS if rows else _PARTS))
    solved = con.sql(f"SELECT key, seg, start::INT AS src, state::INT AS dst, cost, audit FROM ({sql}) JOIN groups USING (k)").to_arrow_table()
    con.close()
    return solved


def _fold(parts: DataFrame, rows: bool, starts: list[int], size: int) -> DataFrame:
    """Least costs and audits of each group (key, seg), by first and last state. Groups are dealt by hash into batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            yield from _query(t, rows, starts).cast(out).to_batches(max_chunksize=10_000)

    out = pa.schema([("key", pa.string()), ("seg", pa.int64()), ("src", pa.int32()), ("dst", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    return parts.repartition(max(1, -(-size // BATCH)), "key", "seg").mapInArrow(run, _SOLVED)


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows after damage by crc32(`conv:turn`) % 20: key, turn, role, text, n (2 where a row is repeated)."""
    space = F.lit(" ")
    hit = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))) % 20
    said = F.coalesce(F.col(text), space)
    return turns.filter(hit != 0).select(
        _key(conv).alias("key"),
        F.col(turn).cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"),
        F.when(hit == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _key(conv: str) -> Column:
    return F.when(F.col(conv).isNull(), "n").otherwise(F.concat(F.lit("c"), F.col(conv).cast("string")))


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows in order, without their texts: key, seg, part (place in all), code, deletes, has (a row that may stay), and the counts."""
    slim = rows.select(
        "key", "turn", "role", "head", "digest", "n", "blank",
        (~F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    ).groupBy("key", "turn", "role", "head", "digest", "blank", "truncated").agg(F.sum("n").alias("n"))
    slim = materialize(slim, "repair-rows")
    # A row is new where its role and text come first. Both sides have one row a key, so no key is hot.
    early = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    firsts = slim.groupBy("key", "role", "digest").agg(F.min(early)["turn"].alias("first_turn"))
    a, b = slim.alias("a"), firsts.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "role", "digest")]
    marked = a.join(b, [*same, F.col("a.turn").eqNullSafe(F.col("b.first_turn"))], "left").select("a.*", F.col("b.key").isNotNull().alias("first"))
    n = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "head", "digest"]
    placed = marked.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.monotonically_increasing_id())
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    stays = F.col("first") & ~F.col("blank")
    return materialize(
        placed.select(
            "key", "turn", "part", F.shiftright("part", SHIFT).alias("seg"), initial.alias("initial"),
            F.when(~stays, "-").when(F.col("truncated"), F.upper(initial)).otherwise(initial).alias("code"),
            (F.col("n") - stays.cast("long")).alias("deletes"), "n", "blank", stays.alias("stays"), "truncated",
        ),
        "repair-order",
    )


def _pairs(parts: DataFrame) -> DataFrame:
    """Pairs of neighbours that are not su, ua or au, by group (key, seg): first and last initial, and their number, of parts in order."""
    ordered = F.sort_array(F.collect_list(F.struct("part", "first", "last", "illegal")))
    wrong = F.aggregate(
        F.sequence(F.lit(1), F.size("p")), F.lit(0).cast("long"),
        lambda acc, i: acc + F.get("p", i - 1)["illegal"] + ((i < F.size("p")) & ~F.concat(F.get("p", i - 1)["last"], F.get("p", i)["first"]).isin("su", "ua", "au")).cast("long"),
    )
    grouped = parts.groupBy("key", "seg").agg(ordered.alias("p"))
    return grouped.select("key", "seg", F.get("p", F.lit(0))["first"].alias("first"), F.element_at("p", -1)["last"].alias("last"), F.coalesce(wrong, F.lit(0)).alias("illegal"))


def _size(parts: DataFrame) -> int:
    """Rows, and more for long audits."""
    return int(parts.agg(F.coalesce(F.sum(1 + F.length("audit") / 64), F.lit(0))).first()[0])


def repairs(ordered: DataFrame) -> DataFrame:
    """key, cost, audit, illegal for each conversation that has rows."""
    solved = materialize(_fold(ordered.select("key", "seg", "part", "code", "deletes"), True, [0, 1, 2, 3], ordered.count()), "repair-parts")
    pairs = materialize(_pairs(ordered.select("key", "seg", "part", F.col("initial").alias("first"), F.col("initial").alias("last"), (F.col("n") - 1).alias("illegal"))), "repair-pairs")
    up = lambda t: t.withColumn("part", F.col("seg")).withColumn("seg", F.shiftright("part", SHIFT))
    while (pairs.groupBy("key").count().agg(F.max("count")).first()[0] or 0) > 1 << SHIFT:
        above, old = up(solved), (solved, pairs)
        solved = materialize(_fold(above, False, [0, 1, 2, 3], _size(above)), "repair-parts")
        pairs = materialize(_pairs(up(pairs)), "repair-pairs")
        for t in old:
            discard(t)
    whole = lambda t: t.withColumn("part", F.col("seg")).withColumn("seg", F.lit(0).cast("long"))
    last = _fold(whole(solved), False, [0], _size(solved))
    ends = F.create_map(*[F.lit(x) for x in (START, "", AFTER_S, "II", AFTER_U, "I", AFTER_A, "")])
    ended = last.withColumn("end", ends[F.col("dst")])
    best = F.min(F.struct((F.col("cost") + INSERT * F.length("end")).alias("cost"), F.concat("audit", "end").alias("audit")))
    return ended.groupBy("key").agg(best.alias("b")).select("key", "b.cost", "b.audit").join(_pairs(whole(pairs)).select("key", "illegal"), "key")


def _texts(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """key, repaired_sha256: rows of a conversation pass through one task in order, behind its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, hashed, before = None, "", 0, None, ""

        def put(role: str, text: str) -> None:
            nonlocal before
            hashed.update(("\n" if before else "").encode() + f"{role}:{text}".encode())
            before = role[:1] or " "

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("assistant" if before == "u" else "user", "")
                at += 1

        for b in batches:
            done = []
            for k, a, role, text, n in zip(*(b.column(c).to_pylist() for c in ("key", "audit", "role", "text", "n")), strict=True):
                if a is not None:
                    if key is not None:
                        inserts()
                        done.append((key, hashed.hexdigest()))
                    key, audit, at, hashed, before = k, a, 0, hashlib.sha256(), ""
                    continue
                for _ in range(n):
                    if audit[at] == "D":
                        at += 1
                        continue
                    inserts()
                    if audit[at] == "K":
                        put(role, text)
                    elif audit[at] == "R":
                        put("assistant" if before == "u" else "user", text)
                    at += 1
            if done:
                yield pa.RecordBatch.from_pydict({"key": [x[0] for x in done], "repaired_sha256": [x[1] for x in done]}, out)
        if key is not None:
            inserts()
            yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [hashed.hexdigest()]}, out)

    out = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
    said = rows.select("key", "turn", "role", "head", "digest", F.when(~F.col("blank"), F.col("text")).alias("text"), "n").withColumn("audit", F.lit(None).cast("string"))
    both = said.unionByName(audits.select("key", "audit"), allowMissingColumns=True)
    order = ["key", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "head", "digest"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "key").sortWithinPartitions(*order).select("key", "audit", "role", "text", "n").mapInArrow(run, "key string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """rows: key, turn, role, text, n as `damage` gives them. One row a conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, nulls first; rows of one turn by role, then text (its first 32 characters, then its MD5). Repeated rows, and rows
    whose role and text came earlier, are duplicates; equal rows of a turn are one row with a count until they are spelled out in
    the audit. Roles that begin with another letter, empty ones included, can only be reroled or deleted. Texts are hashed whole.
    """
    rows = rows.withColumns({"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "head": F.left("text", F.lit(HEAD)), "digest": F.unhex(F.md5("text"))})
    ordered = _ordered(rows)
    count = lambda c: F.sum(c).cast("long")
    by_turn = ordered.groupBy("key", "turn").agg(
        count(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        count(F.when(~F.col("blank"), F.col("deletes")).otherwise(0)).alias("duplicate"),
        count((F.col("stays") & F.col("truncated")).cast("long")).alias("truncated"),
    )
    stats = by_turn.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[count(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    audits = materialize(repairs(ordered), "repair-audits")
    return stats.join(audits, "key").join(_texts(rows, audits), "key")


def repair_damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`damage` and `repair`: one row for every conversation of `turns`, a null id being one; other columns are ignored, an empty table gives no rows.

    Conversations without rows after the damage have zeros, an empty audit and the hash of nothing. Null values count as one space.
    """
    kind = turns.schema[conv].dataType
    everyone = turns.select(_key(conv).alias("key")).distinct()
    fixed = everyone.join(repair(damage(turns, conv, turn, role, text)), "key", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return fixed.select(
        F.when(F.col("key") != "n", F.substr("key", F.lit(2))).cast(kind).alias("conv_id"), *[v.alias(k) for k, v in zero.items()],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation of `conversations`, damaged by rule and repaired at least cost."""
    return repair_damaged(table(spark, sf_dir, "conversations"))


_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({s}, ''), lambda c: ascii(c)::UBIGINT)), lambda r, c: list_reduce(list_prepend(xor(r, c), list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor({_CRC.format(s="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")}, 4294967295::UBIGINT) % 20 AS hit
  FROM conversations
), h AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE hit <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM h
), f AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM o
), w AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND coalesce(before[1] || role[1] NOT IN ('su', 'ua', 'au'), true)) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id
), dp AS (
  SELECT conv_id, 0::BIGINT AS pos, '' AS state, {{'cost': 0, 'audit': '', 'said': ''}} AS best FROM w
  UNION ALL
  SELECT conv_id, pos, state, min(best) FROM (
    SELECT dp.conv_id, f.pos, CASE WHEN op = 'D' THEN state WHEN op = 'KS' THEN 's' WHEN (state = 'u') <> (op IN ('IK', 'IR')) THEN 'a' ELSE 'u' END AS state,
           CASE WHEN (state = 'u') <> (op IN ('IK', 'IR')) THEN 'assistant' ELSE 'user' END AS wanted,
           {{'cost': best.cost + CASE op WHEN 'D' THEN 2 ELSE CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END + CASE WHEN op[1] = 'I' THEN 5 ELSE 0 END + CASE WHEN op IN ('R', 'IR') THEN 1 ELSE 0 END END,
             'audit': best.audit || replace(op, 'S', ''),
             'said': best.said || CASE WHEN op = 'D' THEN '' ELSE CASE WHEN op[1] = 'I' THEN CASE WHEN state = 'u' THEN 'assistant:' ELSE 'user:' END || chr(10) ELSE '' END
                     || CASE WHEN op IN ('R', 'IR') THEN wanted ELSE role END || ':' || text || chr(10) END}} AS best
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.pos + 1, (SELECT unnest(['D', 'K', 'KS', 'R', 'IK', 'IR']) AS op)
    WHERE op = 'D' OR fault NOT IN ('blank', 'duplicate') AND CASE op WHEN 'KS' THEN state = '' AND role[1] = 's' WHEN 'K' THEN role[1] = wanted[1] WHEN 'IK' THEN role[1] = wanted[1] ELSE true END
  ) GROUP BY conv_id, pos, state
), e AS (
  SELECT dp.conv_id, min({{'cost': best.cost + CASE state WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END, 'audit': best.audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END,
         'said': best.said || CASE state WHEN 'u' THEN 'assistant:' || chr(10) WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE '' END}}) AS best
  FROM dp JOIN w ON w.conv_id IS NOT DISTINCT FROM dp.conv_id AND w.n = dp.pos GROUP BY dp.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(best.said[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
