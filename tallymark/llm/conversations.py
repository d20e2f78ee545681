"""Repair of the structure of conversations by the cheapest edits.

A repaired conversation's role initials read ``(s?(ua)+)?``. The cheapest edits are found by a dynamic
program over four states: nothing written yet, a system message, a user's, an assistant's. Edit scripts
are a persistent tree: a node is one edit behind its parent's script, with binary-lifting ancestors and a
rolling hash. Equally cheap scripts are compared at the end of their longest common prefix, which is
searched by hashes; equal hashes of different nodes are verified edit by edit.

Conversations of any length are spread: rows, reduced to marks of fixed size, are range-partitioned by
(conversation, turn) into slices. A slice's task solves its part of a conversation from every state it
may be entered in, and the parts are put together along the few slices that a conversation crosses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.session import materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: What an undeleted truncated row adds.
TRUNCATED = 1
#: States: nothing written, after a system message, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From which states a user's or assistant's message may follow.
_BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
#: Rows of a conversation that are solved at once.
PART = 20_000
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"
_NAMES = {USER: "user", ASSISTANT: "assistant"}


class Edits:
    """Edit scripts that share their beginnings; node 0 is the empty script."""

    def __init__(self, factor: int = 1_000_003, modulus: int = (1 << 61) - 1) -> None:
        self.factor, self.modulus = factor, modulus
        self.up: list[list[int]] = [[]]
        self.edit, self.depth, self.hash = [""], [0], [0]

    def add(self, node: int, edit: str) -> int:
        above, at = [node], node
        while len(above) <= len(self.up[at]):
            at = self.up[at][len(above) - 1]
            above.append(at)
        self.up.append(above)
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.factor + ord(edit)) % self.modulus)
        return len(self.edit) - 1

    def lift(self, node: int, depth: int) -> int:
        """The script's first ``depth`` edits."""
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two scripts of one length are equal; equal hashes are not taken on trust."""
        if a == b or self.hash[a] != self.hash[b]:
            return a == b
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether script a with edit x behind it comes before script b with edit y, as ASCII texts."""
        least = min(self.depth[a], self.depth[b])
        p, q = self.lift(a, least), self.lift(b, least)
        if self.same(p, q):
            after = [edit if self.depth[n] == least else self.edit[self.lift(n, least + 1)] for n, edit in ((a, x), (b, y))]
            return after[0] < after[1] if after[0] != after[1] else self.depth[a] < self.depth[b]
        for k in range(len(self.up[p]) - 1, -1, -1):
            if k < len(self.up[p]) and not self.same(self.up[p][k], self.up[q][k]):
                p, q = self.up[p][k], self.up[q][k]
        return self.edit[p] < self.edit[q]

    def script(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _best(edits: Edits, options: list[tuple[int, int, str]]) -> tuple[int, int] | None:
    """(cost, node) of the cheapest option (cost, node, further edit or none), ties to the smallest script."""
    won = None
    for option in options:
        if won is None or option[0] < won[0] or option[0] == won[0] and edits.less(option[1], option[2], won[1], won[2]):
            won = option
    return won and (won[0], edits.add(won[1], won[2]) if won[2] else won[1])


def _inserted(edits: Edits, state: list) -> list:
    """States after any inserts; a cycle of inserts never pays."""
    out = list(state)
    for to in (USER, ASSISTANT):
        options = [(out[s][0] + COSTS[INSERT], out[s][1], INSERT) for s in _BEFORE[to] if out[s]]
        out[to] = _best(edits, options + ([(*out[to], "")] if out[to] else []))
    return out


def solve(rows: list[tuple[str, bool, bool]], start: int = START, edits: Edits | None = None) -> dict[int, tuple[int, str]]:
    """{end state: (cost, script)} of the cheapest edits of rows (initial, must go, truncated), entered in ``start``."""
    edits = edits or Edits()
    state: list = [None] * 4
    state[start] = (0, 0)
    for initial, gone, cut in rows:
        state, before = [None] * 4, _inserted(edits, state)
        more = TRUNCATED if cut else 0
        for to in range(4):
            options = [(before[to][0] + COSTS[DELETE], before[to][1], DELETE)] if before[to] else []
            if not gone:
                for s in _BEFORE.get(to, ()):
                    if before[s]:
                        edit = KEEP if initial == _NAMES[to][0] else REROLE
                        options.append((before[s][0] + COSTS[edit] + more, before[s][1], edit))
                if to == SYSTEM and initial == "s" and before[START]:
                    options.append((before[START][0] + COSTS[KEEP] + more, before[START][1], KEEP))
            state[to] = _best(edits, options)
    return {s: (held[0], edits.script(held[1])) for s, held in enumerate(state) if held}


def finished(ends: dict[int, tuple[int, str]]) -> tuple[int, int, str]:
    """(state before the last inserts, cost, script) of the cheapest legal end."""
    options = []
    for s, (cost, script) in ends.items():
        inserts = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[s]
        options.append((cost + inserts * COSTS[INSERT], script + INSERT * inserts, s))
    cost, script, s = min(options)
    return s, cost, script


def replay(script: str, rows: list[tuple], start: int) -> Iterator[tuple[int | None, str | None]]:
    """(row number or None, new role or None) of every message that the script leaves, in order."""
    state, at = start, 0
    for edit in script:
        to = ASSISTANT if state == USER else USER
        if edit == INSERT:
            yield None, _NAMES[to]
            state = to
            continue
        if edit != DELETE:
            state = SYSTEM if edit == KEEP and rows[at][0] == "s" else to
            yield at, _NAMES[to] if edit == REROLE else None
        at += 1


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, chosen by crc32 of ``conversation:turn`` modulo 20: 0 drops a row, 1
    empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes it the user's. Null roles and
    texts, and null ids in the key, are one space. Other columns are dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    out = rows.where(kind != 0).select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(space(role)).alias("role"), said.alias("text"),
                                       F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return out.drop("copy")


@dataclass
class Repair:
    """``report``: one row per conversation that has rows. ``messages``: the repaired messages in order,
    (conv_id, slice, place, role, text); a message of several equal rows may come several times with one place."""

    report: DataFrame
    messages: DataFrame


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", slices: int | None = None, part: int = PART) -> Repair:
    """Find faults and repair every conversation.

    Rows are taken by turn, null turns first, rows of one turn by a digest of role and text. Null roles
    and texts count as one space; null conversation ids are one conversation. A row is blank (no
    character but white space), else duplicate (role and text seen earlier), else truncated (last such
    character none of ``.!?``), else sound. Keeping costs 0, another role 2, deleting 3 (a must for blank
    and duplicate rows), an inserted empty message 2, an undeleted truncated row 1. ``audit`` holds the
    initials of the cheapest edits (Keep, Rerole, Delete, Insert), of equally cheap ones the ASCII-least;
    ``gaps`` counts turns missing between the smallest and the largest, ``illegal`` neighbours whose
    initials are none of su, ua, au. Equal rows of a turn are counted before they move. Extra columns are
    ignored. No rows give no report.
    """
    spark = rows.sparkSession
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    ending = F.substring(F.rtrim(F.col("text"), F.lit(_SPACE)), -1, 1)
    said = (rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
            .withColumn("mark", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))))
    marks = said.select("conv_id", "turn", "mark", F.substring("role", 1, 1).alias("initial"), (ending == "").alias("blank"), (~ending.isin(".", "!", "?")).alias("cut"))
    counted = marks.groupBy("conv_id", "turn", "mark", "initial", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    again = (counted.where(~F.col("blank")).groupBy("conv_id", "mark").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
             .select(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark"), "first"))
    flagged = (counted.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark")), "left")
               .select("conv_id", "turn", "mark", "initial", "blank", "cut", "n", F.coalesce(place > F.col("first"), F.lit(False)).alias("seen")))
    order = ["conv_id", "turn", "mark"]  # ascending, nulls first
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(_parts(flagged.repartitionByRange(count, *order).sortWithinPartitions(*order), part))

    alone = parts.where(~F.col("edge")).select(*_PART[:2], F.lit(START).alias("start"), "audit", "cost", *_STATS, "rows")
    joined = materialize(_joined(parts.where("edge")))
    keys = parts.where("edge").select(F.col("slice").alias("_slice"), F.col("conv_id").alias("_conv"), "rows")
    across = joined.join(keys, (F.col("slice") == F.col("_slice")) & F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_slice", "_conv")
    solved = alone.unionByName(across)

    whole = joined.groupBy("conv_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("slice", "audit"))), lambda p: p["audit"])).alias("audit"))  # one piece a slice
    report = alone.select(*whole.columns).unionByName(whole)
    gaps = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("turns")
    report = report.select("conv_id", F.coalesce(gaps.try_cast("long"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    left = _left(solved)
    texts = said.select(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark"), "role", "text")
    messages = (left.join(texts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark")), "left")
                .select("conv_id", "slice", "place", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return Repair(report, messages)


_STATS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")
_PART = ("conv_id", "slice", "edge", "audit", "cost", *_STATS)
_ROWS = "array<struct<initial:string,mark:binary,gone:boolean>>"
_PATHS = "array<struct<start:int,end:int,cost:long,script:string>>"


def _parts(sliced: DataFrame, part: int) -> DataFrame:
    """One row per conversation and part of at most ``part`` rows in a slice: counts, rows as marks, scripts.

    A conversation that is one part and neither begins nor ends its slice is solved here; the others
    (``edge``) carry the cheapest scripts between all states, and what lies at their ends.
    """
    kind = sliced.schema["conv_id"].dataType.simpleString()
    schema = T._parse_datatype_string(f"conv_id {kind}, slice long, edge boolean, audit string, cost long, low long, high long, turns long, blank long, duplicate long, truncated long, "
                                      f"illegal long, first_turn long, last_turn long, head string, tail string, paths {_PATHS}, rows {_ROWS}")
    numbered = sliced.select("conv_id", "turn", "mark", "initial", "blank", "cut", "n", "seen", F.spark_partition_id().alias("slice"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, entered, begun, number, arrow = None, [], 0, True, False, 0, None
        for batch in batches:
            arrow, done = _arrow_schema(batch.schema.field(0).type), []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                number = max(number, row[8] << 32)  # parts of a slice are numbered on
                if begun and row[0] != key:
                    if held:
                        done.append(_part(key, held, number, entered, entered))
                    held, size, entered, number = [], 0, False, number + 1
                key, begun, left, seen = row[0], True, row[6], row[7]
                while left:
                    if size >= part:
                        done.append(_part(key, held, number, entered, True))
                        held, size, entered, number = [], 0, True, number + 1
                    some = min(left, part - size)
                    held.append((*row[:6], some, seen))
                    left, size, seen = left - some, size + some, True
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([_part(key, held, number, entered, True)], schema=arrow)

    return numbered.mapInArrow(run, schema)


def _arrow_schema(key: pa.DataType) -> pa.Schema:
    long, text = pa.int64(), pa.string()
    path = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", long), ("script", text)])
    row = pa.struct([("initial", text), ("mark", pa.binary()), ("gone", pa.bool_())])
    return pa.schema([("conv_id", key), ("slice", pa.int64()), ("edge", pa.bool_()), ("audit", text), ("cost", long), *[(n, long) for n in _STATS], ("first_turn", long), ("last_turn", long),
                      ("head", text), ("tail", text), ("paths", pa.list_(path)), ("rows", pa.list_(row))])


def _part(key, held: list[tuple], number: int, entered: bool, edge: bool) -> dict:
    """One conversation's rows of a part; ``entered``: it may have begun in an earlier part."""
    rows, counts = [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    known = [t for _, t, *_ in held if t is not None]
    for _, _, mark, initial, blank, cut, n, seen in held:
        for copy in range(n):
            fault = "blank" if blank else "duplicate" if seen or copy else "truncated" if cut else None
            if fault:
                counts[fault] += 1
            if rows and rows[-1][0] + initial not in _LEGAL:
                counts["illegal"] += 1
            rows.append((initial, fault in ("blank", "duplicate"), fault == "truncated", mark))
    plain = [r[:3] for r in rows]
    paths = {s: solve(plain, s) for s in (range(4) if entered else (START,))}
    _, cost, audit = finished(paths[START])
    return {"conv_id": key, "slice": number, "edge": edge, "audit": audit, "cost": cost, "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)), **counts,
            "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "head": rows[0][0], "tail": rows[-1][0],
            "paths": [{"start": s, "end": e, "cost": c, "script": x} for s, ends in paths.items() for e, (c, x) in ends.items()] if edge else [],
            "rows": [{"initial": r[0], "mark": None if r[1] else r[3], "gone": r[1]} for r in rows]}


def _joined(edges: DataFrame) -> DataFrame:
    """Conversations at the ends of slices: the scripts of their parts, chosen together; one row a part."""
    kept = edges.select(*_PART[:2], *_STATS, "first_turn", "last_turn", "head", "tail", "paths")
    kind = edges.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, slice long, start int, audit string, cost long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slice")
        out, best, last = [], {START: (0, None)}, None  # state -> (cost, chain); a chain is (chain before, state before, script)
        for part in frame.itertuples():
            found: dict[int, tuple] = {}
            for path in part.paths:
                if path["start"] in best:
                    cost, chain = best[path["start"]]
                    option = (cost + path["cost"], (chain, path["start"], path["script"]))
                    held = found.get(path["end"])
                    if held is None or option[0] < held[0] or option[0] == held[0] and _before(option[1], held[1]):
                        found[path["end"]] = option
            best = found
            turns, illegal = part.turns, part.illegal
            if last is not None:
                illegal += last.tail + part.head not in _LEGAL
                turns -= _number(last.last_turn) is not None and _number(last.last_turn) == _number(part.first_turn)
            out.append([part.slice, part.low, part.high, turns, part.blank, part.duplicate, part.truncated, illegal])
            last = part
        state, cost, _ = finished({s: (c, _script(chain)) for s, (c, chain) in best.items()})
        inserts = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]
        pieces, chain = [], best[state][1]
        while chain is not None:
            pieces.append((chain[1], chain[2]))
            chain = chain[0]
        pieces.reverse()
        rows = [(frame.conv_id.iloc[0], slice_no, start, script + INSERT * inserts * (k == len(pieces) - 1), cost * (k == 0), _number(low), _number(high), *stats)
                for k, ((slice_no, low, high, *stats), (start, script)) in enumerate(zip(out, pieces))]
        found = pd.DataFrame(rows, columns=["conv_id", "slice", "start", "audit", "cost", *_STATS])
        for name in ("low", "high"):
            found[name] = found[name].astype("Int64")
        found["conv_id"] = frame.conv_id.values
        return found

    return kept.withColumns({c: F.col(c).cast("string") for c in ("low", "high", "first_turn", "last_turn")}).groupBy("conv_id").applyInPandas(run, schema)


def _number(text) -> int | None:
    """A turn that travelled as text, since pandas turns longs beside nulls into floats."""
    return None if text is None or text != text else int(text)


def _before(a: tuple, b: tuple) -> bool:
    """Whether chain a's script comes before b's; chains of as many parts are compared behind their last common part."""
    mine, other = [], []
    while a is not b:
        mine.append(a[2])
        other.append(b[2])
        a, b = a[0], b[0]
    return "".join(reversed(mine)) < "".join(reversed(other))


def _script(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        out.append(chain[2])
        chain = chain[0]
    return "".join(reversed(out))


def _left(solved: DataFrame) -> DataFrame:
    """(conv_id, slice, place, mark, new_role) of every message that stays or is inserted."""
    kept = solved.select("conv_id", "slice", "start", "audit", "rows")
    kind = solved.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, slice long, place int, mark binary, new_role string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, slice_no, start, audit, rows = (c[k].as_py() for c in batch.columns)
                left = list(replay(audit, [(r["initial"],) for r in rows], start))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(left), pa.int64())), pa.array([slice_no] * len(left), pa.int64()), pa.array(range(len(left)), pa.int32()),
                                                  pa.array([None if at is None else rows[at]["mark"] for at, _ in left], pa.binary()), pa.array([r for _, r in left], pa.string())],
                                                 names=["conv_id", "slice", "place", "mark", "new_role"])

    return kept.mapInArrow(run, schema)


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): sha256 of ``role:text`` lines, newline-joined.

    A digest has no parallel form, so one task reads a conversation's messages, in order and one by
    one; it holds no more than one message.
    """
    schema = T.StructType([messages.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    lines = messages.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, digest, some, kind = None, None, None, False, None
        for batch in batches:
            kind, keys, out = batch.schema.field(0).type, [], []
            for conv, slice_no, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if some and conv == key and (slice_no, place) == at:
                    continue  # one of several equal rows
                if not some or conv != key:
                    if some:
                        keys.append(key)
                        out.append(digest.hexdigest())
                    key, some, digest = conv, True, hashlib.sha256()
                else:
                    digest.update(b"\n")
                at = (slice_no, place)
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(out, pa.string())], names=schema.names)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([digest.hexdigest()], pa.string())], names=schema.names)

    return lines.select("conv_id", "slice", "place", "role", "text").mapInArrow(run, schema)


def audited(conversations: DataFrame, rows: DataFrame, slices: int | None = None, part: int = PART) -> DataFrame:
    """The report of ``rows`` and the digest of their repair for every conversation of ``conversations``;
    one without rows has zeros, an empty audit and the digest of nothing."""
    found = repair(rows, slices=slices, part=part)
    ids = conversations.select(F.col("conv_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    report = found.report.withColumnRenamed("conv_id", "_r")
    digest = digests(found.messages).withColumnRenamed("conv_id", "_d")
    joined = ids.join(report, ids["conv_id"].eqNullSafe(report["_r"]), "left").join(digest, ids["conv_id"].eqNullSafe(digest["_d"]), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The same in DuckDB's SQL: the dynamic program is a recursive query with one row per conversation."""
    go = lambda s, cost, edit, line=None: (
        f"CASE WHEN {s} IS NULL THEN NULL ELSE {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 'r': " + (f"list_append({s}.r, {line})" if line else f"{s}.r") + "} END")
    best = lambda options: f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"
    free = lambda s, ok, line, cost, edit: f"CASE WHEN NOT gone AND {ok} THEN {go(s, cost, edit, line)} END"
    step = {0: best([go("t0", 3, "D")]),
            1: best([go("t1", 3, "D"), free("t0", "initial = 's'", "role || ':' || text", "more", "K")])}
    for to, name in ((2, "user"), (3, "assistant")):
        options = [go(f"t{to}", 3, "D")]
        for s in ("t0", "t1", "t3") if to == 2 else ("t2",):
            options += [free(s, f"initial = '{name[0]}'", "role || ':' || text", "more", "K"), free(s, "TRUE", f"'{name}:' || text", "2 + more", "R")]
        step[to] = best(options)
    close = lambda frm, cols: f"""SELECT {cols} s0 AS t0, s1 AS t1, u AS t2, {best(['s3', go('u', 2, 'I', "'assistant:'")])} AS t3 FROM (
          SELECT *, {best(['s2', *[go(s, 2, 'I', "'user:'") for s in ('s0', 's1', 's3')]])} AS u FROM ({frm}))"""  # noqa: E731
    nothing = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]))"
    return f"""WITH RECURSIVE src AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                   lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM conversations),
        said AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM src, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS i, left(role, 1) AS initial,
                 NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut
          FROM (SELECT *, sha256(length(role) || ':' || role || text) AS mark FROM said)),
        seen AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, mark ORDER BY i) > 1 AS duplicate, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
        faults AS (SELECT *, blank OR duplicate AS gone, cut AND NOT blank AND NOT duplicate AS truncated, CAST(cut AND NOT blank AND NOT duplicate AS BIGINT) AS more FROM seen),
        counts AS (
          SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
                 count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
        walk(conv_id, i, s0, s1, s2, s3) AS (
          SELECT conv_id, 0::BIGINT, CAST({{'c': 0, 'a': '', 'r': []}} AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])), {nothing}, {nothing}, {nothing} FROM counts
          UNION ALL
          SELECT conv_id, i, {", ".join(f"CAST({step[s]} AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]))" for s in range(4))} FROM (
            {close("SELECT w.conv_id, f.i, s0, s1, s2, s3, f.role, f.text, f.initial, f.gone, f.more FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1",
                   "conv_id, i, role, text, initial, gone, more,")})),
        ends AS ({close("SELECT w.conv_id, s0, s1, s2, s3 FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.rows = w.i", "conv_id,")}),
        won AS (SELECT conv_id, {best(["t0", "t3"])} AS e FROM ends)
        SELECT o.conv_id, {", ".join(f"CAST(coalesce(c.{n}, 0) AS BIGINT) AS {n}" for n in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, coalesce(won.e.c, 0) AS cost, coalesce(won.e.a, '') AS audit,
               sha256(coalesce(array_to_string(won.e.r, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE = _sql()
