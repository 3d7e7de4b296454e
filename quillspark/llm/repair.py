"""Cheapest repair of conversations by cost layers over a grammar of roles (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.crc import CRC_TABLE, crc32_sql
from quillspark.llm.storage import store, table

#: Turns that are solved together; longer conversations are solved block by block and joined.
BLOCK = 256
#: Costs of an edit, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar (s?(ua)+)?: state 0 has seen nothing, 1 a system turn, 2 a user turn, 3 an assistant turn.  A set of states
#: is a mask of bits.  What user or assistant turn may follow a state is given by it: NEXT.
NEXT = (2, 2, 3, 2)
ACCEPT = 1 << 0 | 1 << 3
ROLE_OF = {2: "user", 3: "assistant"}
BLANK, ENDED = r"\A[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"
#: Codes of turns: initial of the role (- for others), upper case or _ if truncated, D if it must go.
SOUND, SHORT, GONE = "sua-", "SUA_", "D"


def _after(state: int, initial: str) -> int | None:
    """The state behind a turn of that initial, if the grammar allows it there."""
    if initial == "s":
        return 1 if state == 0 else None
    return NEXT[state] if ROLE_OF[NEXT[state]][0] == initial else None


def _before(initial: str | None) -> bytes:
    """For each set of states, the states that get into it by a turn of that initial, or by any that fits."""
    goes = [_after(q, initial) if initial else NEXT[q] for q in range(4)]
    return bytes(sum(1 << q for q in range(4) if goes[q] is not None and mask >> goes[q] & 1) for mask in range(16))


ANY = _before(None)
KEEP = {c: _before(c.lower()) if c.isalpha() else bytes(16) for c in SOUND + SHORT}


class Layers:
    """Layers of growing cost: layer c holds, for each turn, the set of states from which the turns from there on can be
    brought to the states of `target` at a cost of exactly c."""

    def __init__(self, code: str, target: int):
        self.code, self.target, self.layers = code, target, []

    def grow(self) -> int:
        """Add the next layer; the set of states at the first turn."""
        n, code, done = len(self.code), self.code, self.layers
        c = len(done)
        none = bytes(n + 1)
        one, two, three = (done[c - k] if c >= k else none for k in (1, 2, 3))
        now = bytearray(n + 1)
        now[n] = (self.target if c == 0 else 0) | ANY[two[n]]
        for i in range(n - 1, -1, -1):
            turn = code[i]
            found = ANY[two[i]] | three[i + 1]
            if turn in SOUND:
                found |= KEEP[turn][now[i + 1]] | ANY[two[i + 1]]
            elif turn in SHORT:
                found |= KEEP[turn][one[i + 1]] | ANY[three[i + 1]]
            now[i] = found
        done.append(bytes(now))
        return now[0]

    def trace(self, state: int, cost: int) -> str:
        """The least edits (initials in ASCII order) of that cost from a state that the layer of that cost holds."""
        i, out, n = 0, [], len(self.code)

        def holds(q: int | None, left: int, at: int) -> bool:
            return q is not None and left >= 0 and at <= n and bool(self.layers[left][at] >> q & 1)

        while i < n or cost:
            turn = self.code[i] if i < n else GONE
            more = TRUNCATED if turn in SHORT else 0
            kept = _after(state, turn.lower()) if turn.isalpha() and turn != GONE else None
            if holds(state, cost - DELETE, i + 1):
                cost, i = cost - DELETE, i + 1
                out.append("D")
            elif holds(NEXT[state], cost - INSERT, i):
                cost, state = cost - INSERT, NEXT[state]
                out.append("I")
            elif holds(kept, cost - more, i + 1):
                cost, state, i = cost - more, kept, i + 1
                out.append("K")
            else:
                cost, state, i = cost - REROLE - more, NEXT[state], i + 1
                out.append("R")
        return "".join(out)


def solve(code: str) -> tuple[int, str]:
    """Cost and least audit of a whole conversation: the first layer that holds the start gives the cost."""
    layers = Layers(code, ACCEPT)
    while not layers.grow() & 1:
        pass
    cost = len(layers.layers) - 1
    return cost, layers.trace(0, cost)


def ways(code: str, first: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, least audit) of a block of turns, for each way through it that a cheapest repair may take.

    What follows state 3 costs at most 3 more than what follows any other state, so a way to another exit that costs
    more than 3 above the way to 3 is on no cheapest repair.
    """
    entries = (0,) if first else (0, 1, 2, 3)
    out, to_three = [], {}
    for target in (3, 2, 1, 0):
        layers, wanted = Layers(code, 1 << target), set(entries)
        while wanted:
            found, cost = layers.grow(), len(layers.layers) - 1
            for q in sorted(wanted):
                if found >> q & 1:
                    out.append((q, target, cost, layers.trace(q, cost)))
                    to_three.setdefault(q, cost)
                if found >> q & 1 or cost >= to_three.get(q, cost) + 3:
                    wanted.discard(q)
    return out


def join_blocks(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """Cost and the audit's part in each block of the cheapest, then least, chain of ways through all blocks."""
    best: dict[int, tuple[int, str, tuple[str, ...]]] = {0: (0, "", ())}
    for block in blocks:
        after: dict[int, tuple[int, str, tuple[str, ...]]] = {}
        for q, to, cost, audit in block:
            if q in best:
                way = (best[q][0] + cost, best[q][1] + audit, (*best[q][2], audit))
                after[to] = min(after.get(to, way), way)
        best = after
    cost, _, parts = min(best[q] for q in best if ACCEPT >> q & 1)
    return cost, list(parts)


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos, fault, illegal): turns numbered in order, and what is wrong with each.

    Order is by turn, null first, then role and text.  A null role or text is one space.  fault is the first of blank,
    duplicate and truncated, else null.  illegal: the initials of the role before and its own may not follow.
    """
    own = turns.select(
        "conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    )
    talk = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("pos")
    initial = F.substring("role", 1, 1)
    numbered = own.withColumns({"pos": F.row_number().over(talk) - 1, "before": F.lag(initial).over(talk)})
    fault = (
        F.when(F.col("text").rlike(BLANK), "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~F.col("text").rlike(ENDED), "truncated")
    )
    legal = F.concat("before", initial).isin("su", "ua", "au")
    return numbered.select("conv_id", "turn", "role", "text", "pos", fault.alias("fault"), (~F.coalesce(legal, F.lit(True))).alias("illegal"))


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    sound = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    return (
        F.when(F.col("fault").isin("blank", "duplicate"), GONE)
        .when(F.col("fault") == "truncated", F.translate(sound, SOUND, SHORT))
        .otherwise(sound)
    )


class Repair:
    """Cheapest repair of each conversation of turns (conv_id, turn, role, text).

    report: (conv_id, turns, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation.
    turns(): (conv_id, place, edit, role, text), the repaired turns in order, partition by partition.

    Turns are numbered by a window, so a long conversation spills; its codes are solved in blocks of BLOCK turns that
    any task may take, and the ways through the blocks are joined by their first and last states.  Repaired turns are
    streamed: a task holds one block's audit at a time.  What grows with one conversation is its audit, a character
    a turn.

    Defined results: a null conv_id is a conversation; equal turns are duplicates of the first; a null role or text
    is one space; a role with another initial than s, u or a must be changed or deleted; texts of any length are
    taken whole; an empty table has no conversations.  Only the four columns are read.
    """

    def __init__(self, turns: DataFrame, block: int = BLOCK):
        self.rows = store(in_order(turns).withColumns({"block": (F.col("pos") / block).cast("int"), "code": _code()}), "turns")

        @F.pandas_udf("array<struct<entry:int,exit:int,cost:long,audit:string>>")
        def through(codes: pd.Series, numbers: pd.Series) -> pd.Series:
            out = []
            for code, number in zip(codes, numbers, strict=True):
                if number == 0 and len(code) < block:  # the whole conversation
                    out.append([(0, 3, *solve(code))])
                else:
                    out.append(ways(code, number == 0))
            return pd.Series(out)

        @F.pandas_udf("cost long, parts array<string>")
        def joined(talks: pd.Series) -> pd.DataFrame:
            found = [join_blocks([[(w["entry"], w["exit"], w["cost"], w["audit"]) for w in b["ways"]] for b in talk]) for talk in talks]
            return pd.DataFrame(found, columns=["cost", "parts"])

        at = F.struct("pos", "code")
        codes = self.rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(at)).alias("codes"))
        codes = codes.select("conv_id", "block", F.array_join("codes.code", "").alias("code"))
        solved = codes.select("conv_id", F.struct("block", through("code", "block").alias("ways")).alias("b"))
        talks = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list("b"), lambda x, y: x["block"] - y["block"]).alias("talk"))
        self.solved = store(talks.select("conv_id", joined("talk").alias("j")).select("conv_id", "j.cost", "j.parts"), "audits")

    @property
    def report(self) -> DataFrame:
        counts = {f: F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")}
        gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        facts = self.rows.groupBy("conv_id").agg(
            F.count("*").alias("turns"), F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *counts.values(), F.count_if("illegal").alias("illegal")
        )
        solved = self.solved.select(F.col("conv_id").alias("id"), "cost", F.array_join("parts", "").alias("audit"))
        return facts.join(solved, facts.conv_id.eqNullSafe(solved.id)).drop("id")

    def turns(self) -> DataFrame:
        """Rows of a conversation are neighbours in one partition, ordered by place.

        Audits and turns meet in one shuffle: a block's part of the audit is a row that sorts before its turns.
        """
        parts = self.solved.select("conv_id", F.posexplode("parts").alias("block", "part"))
        heads = parts.select("conv_id", "block", F.lit(-1).alias("pos"), "part", *(F.lit(None).cast("string").alias(c) for c in ("role", "text")))
        rows = self.rows.select("conv_id", "block", "pos", F.lit(None).cast("string").alias("part"), "role", "text")
        met = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")
        id_type = self.rows.schema["conv_id"].dataType.simpleString()
        return met.mapInArrow(_edited, f"conv_id {id_type}, place long, edit string, role string, text string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, place, part, at = 0, 0, "", 0
    for batch in batches:
        out: list[tuple] = []
        names = ("conv_id", "block", "pos", "part", "role", "text")
        for talk, block, pos, head, role, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if pos < 0:
                part, at = head, 0
                if block == 0:
                    state, place = 0, 0
                edit = "I"
            else:
                edit, at = part[at], at + 1
                if edit in "KR":
                    state = (1 if role[:1] == "s" else NEXT[state]) if edit == "K" else NEXT[state]
                    out.append((talk, place, edit, role if edit == "K" else ROLE_OF[state], text))
                    place += 1
            while part[at : at + 1] == "I":  # inserted before the next turn
                state, at = NEXT[state], at + 1
                out.append((talk, place, "I", ROLE_OF[state], ""))
                place += 1
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string())
        made = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(made, ["conv_id", "place", "edit", "role", "text"])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns of a Repair, read in the order that they have there: role:text, newline-joined."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, kind = None, None, None
        for batch in batches:
            done: list[tuple] = []
            kind = batch.schema.field("conv_id").type
            for talk, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if sha is not None:
                        done.append((current, sha.hexdigest()))
                    current, sha = talk, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield told(done, kind)
        if sha is not None:
            yield told([(current, sha.hexdigest())], kind)

    def told(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])

    id_type = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.select("conv_id", "place", "role", "text").mapInArrow(hashed, f"conv_id {id_type}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """turns after the damage that the contract asks for, by the CRC of conv_id:turn (null: one space)."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    own = turns.select(
        "conv_id", "turn", (F.crc32(key) % 20).alias("fate"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    ).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns: all conversations, damaged and repaired."""
    turns = table(spark, sf_dir, "conversations")
    repair = Repair(damaged(turns))
    report = repair.report.drop("turns").withColumnRenamed("conv_id", "of")
    hashes = digests(repair.turns()).withColumnRenamed("conv_id", "by")
    talks = turns.select("conv_id").distinct()
    told = talks.join(report, talks.conv_id.eqNullSafe(report.of), "left").join(hashes, talks.conv_id.eqNullSafe(hashes.by), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return told.select(
        talks.conv_id,
        *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(_KEY)} % 20 AS fate FROM conversations, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(2) copies(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged
),
met AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM placed),
faults AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM met
),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS turns,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
),
inserts(q, z, paid, audit) AS (
  VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
         (2, 2, 0, ''), (2, 3, 2, 'I'), (2, 2, 4, 'II'), (3, 3, 0, ''), (3, 2, 2, 'I'), (3, 3, 4, 'II')
),
edits(z, next, letter, paid, initial) AS (
  VALUES (0, 0, 'D', 3, ''), (1, 1, 'D', 3, ''), (2, 2, 'D', 3, ''), (3, 3, 'D', 3, ''),
         (0, 2, 'R', 2, ''), (1, 2, 'R', 2, ''), (2, 3, 'R', 2, ''), (3, 2, 'R', 2, ''),
         (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'), (3, 2, 'K', 0, 'u')
),
steps AS (
  SELECT f.conv_id, f.pos, w.q, e.next, w.paid + e.paid + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS paid,
         w.audit || e.letter AS audit
  FROM faults f, inserts w JOIN edits e USING (z)
  WHERE letter = 'D' OR (fault NOT IN ('blank', 'duplicate') AND e.initial IN ('', f.initial) AND (letter = 'R' OR f.initial <> ''))
),
reached AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS q, 0 AS cost, '' AS audit FROM facts
  UNION ALL
  SELECT conv_id, pos, q, best.cost, best.audit FROM (
    SELECT s.conv_id, s.pos, s.next AS q, min({{'cost': r.cost + s.paid, 'audit': r.audit || s.audit}}) AS best
    FROM reached r JOIN steps s ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.pos = r.pos + 1 AND s.q = r.q
    GROUP BY s.conv_id, s.pos, s.next)
),
solved AS (
  SELECT f.conv_id, min({{'cost': r.cost + w.paid, 'audit': r.audit || w.audit}}) AS best
  FROM facts f JOIN reached r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.pos = f.turns JOIN inserts w ON w.q = r.q
  WHERE w.z IN (0, 3) GROUP BY f.conv_id
),
letters AS (
  SELECT conv_id, k, substr(best.audit, k, 1) AS letter,
         sum(CASE WHEN substr(best.audit, k, 1) <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS pos
  FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS k FROM solved)
),
kept AS (
  SELECT l.conv_id, l.k, l.letter, f.role, f.text, f.initial, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) AS nth
  FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.pos = l.pos AND l.letter <> 'I' WHERE l.letter <> 'D'
),
shifted AS (SELECT *, max(CASE WHEN nth = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS opened FROM kept),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS sha FROM shifted GROUP BY conv_id
)
SELECT t.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s.best.cost, 0) AS BIGINT) AS cost,
       coalesce(s.best.audit, '') AS audit, coalesce(r.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM t.conv_id
"""
