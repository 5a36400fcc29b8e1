"""Repair of the turn structure of conversations: survivor-coalescence Viterbi over edits of their rows."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallycast.llm.queries import query, table
from tallycast.session import materialise

# Fixed by the contract: the roles' initials have to read (s?(ua)+)?; costs of the edits.
KEEP, REROLE, DELETE, INSERT, UNDELETED_TRUNCATED = 0, 2, 3, 2, 1
STATES = 4  # 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row
# (state, initial, next state, rows inserted before): the cheapest way to let a row with this initial follow
MOVES = ((0, "s", 1, 0), (0, "u", 2, 0), (1, "u", 2, 0), (2, "u", 2, 1), (3, "u", 2, 0), (0, "a", 3, 1), (1, "a", 3, 1), (2, "a", 3, 0), (3, "a", 3, 1))
ENDING = ("", "II", "I", "")  # rows inserted behind the last one, by state
NEXT_ROLE = ("user", "user", "assistant", "user")  # of an inserted or reroled row
LEGAL = frozenset(("su", "ua", "au"))
# AHEAD[y][x]: what the rest of a conversation can cost more from state y than from x, at most
AHEAD = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
SPACE = " \t\n\x0b\x0c\r"
ORDER = ("conv_id", "turn", "role", "digest")
FLUSH = 1 << 20  # characters of audits in one output batch
COUNTS = ("blank", "duplicate", "truncated", "illegal")
PIECE = (
    "conv_id {kind}, part int, whole boolean, start int, end int, cost bigint, rank int, audit string, lead boolean, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, first string, last string, turns bigint, low bigint, high bigint"
)


def _options(initial: str, extra: int) -> tuple:
    """By state, the (next state, cost, edits) that a row with this initial allows."""
    out = [[(state, DELETE, "D")] for state in range(STATES)]
    for state, symbol, after, inserted in MOVES:
        lead = "I" * inserted
        if symbol == initial:
            out[state].append((after, KEEP + extra + INSERT * inserted, lead + "K"))
        if symbol != "s":
            out[state].append((after, REROLE + extra + INSERT * inserted, lead + "R"))
    return tuple(map(tuple, out))


OPTIONS = {(initial, extra): _options(initial, extra) for initial in ("s", "u", "a", "") for extra in (0, UNDELETED_TRUNCATED)}


class Node:
    """Edits of one row in the backpointer tree; ``kids`` and ``held`` are its references."""

    __slots__ = ("parent", "edits", "kids", "held")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.kids, self.held = parent, edits, [], 0
        if parent is not None:
            parent.kids.append(self)


class Survivors:
    """The cheapest edits into every state, from one state at the start.

    All paths have edited the same rows, and a row's edits (insertions before it, then its own) are no prefix of
    another choice for it, so audits compare row by row.  ``rank`` is the place of a survivor's whole unresolved
    audit among all survivors', carried from row to row, which decides ties as comparing the whole suffixes would.
    A node without references is freed; as soon as all survivors descend from one child of the root, its edits
    are final and go to ``done``.
    """

    def __init__(self, start: int):
        self.root = Node(None, "")
        self.root.held = 1
        self.alive = {start: (0, 0, self.root)}
        self.done: list[str] = []

    def step(self, options: tuple) -> None:
        best: dict[int, tuple] = {}
        for state, (cost, rank, node) in self.alive.items():
            for after, more, edits in options[state]:
                key = (cost + more, rank, edits)
                if after not in best or key < best[after][0]:
                    best[after] = (key, node)
        # a state that another one beats whatever follows is no survivor; ties are kept
        kept = [x for x in best if not any(best[x][0][0] > best[y][0][0] + AHEAD[y][x] for y in best if y != x)]
        kept.sort(key=lambda x: best[x][0][1:])
        old = [node for _, _, node in self.alive.values()]
        self.alive = {}
        for place, state in enumerate(kept):
            (cost, _, edits), node = best[state]
            child = Node(node, edits)
            child.held = 1
            self.alive[state] = (cost, place, child)
        for node in old:
            node.held -= 1
            while not node.held and not node.kids and node.parent is not None:
                up, node.parent = node.parent, None
                up.kids.remove(node)
                node = up
        while not self.root.held and len(self.root.kids) == 1:
            child = self.root.kids.pop()
            child.parent, self.root = None, child
            self.done.append(child.edits)

    def repeat_deleted(self, times: int) -> None:
        """``times`` rows that have to go."""
        self.step(tuple(((state, DELETE * times, "D" * times),) for state in range(STATES)))

    def unresolved(self, node: Node) -> str:
        out = []
        while node is not self.root:
            out.append(node.edits)
            node = node.parent
        return "".join(reversed(out))

    def ends(self) -> list[tuple[int, int, int, str]]:
        """``(state, cost, rank, audit)`` of each survivor."""
        done = "".join(self.done)
        return [(state, cost, rank, done + self.unresolved(node)) for state, (cost, rank, node) in self.alive.items()]


class Piece:
    """Consecutive rows of one conversation in one task."""

    def __init__(self, conv_id, starts: range):
        self.conv_id, self.runs = conv_id, {s: Survivors(s) for s in starts}
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first = self.last = self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, copies: int, blank: bool, earliest: bool, truncated: bool) -> None:
        if self.last is None:
            self.first = initial
        else:
            self.counts["illegal"] += self.last + initial not in LEGAL
        self.counts["illegal"] += copies - 1  # no role may follow itself
        self.last = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        fresh = earliest and not blank
        gone = copies - fresh
        self.counts["blank" if blank else "duplicate"] += gone
        if fresh:
            self.counts["truncated"] += truncated
            options = OPTIONS[initial if initial in "sua" else "", UNDELETED_TRUNCATED if truncated else 0]
            for run in self.runs.values():
                run.step(options)
        if gone:
            for run in self.runs.values():
                run.repeat_deleted(gone)

    def rows(self, part: int, whole: bool) -> Iterator[tuple]:
        """A whole conversation's cheapest audit, or a piece's cheapest ones from each start into each state."""
        lead = True
        for start, run in self.runs.items():
            ends = run.ends()
            if whole:
                ends = [min(((s, c + INSERT * len(ENDING[s]), r, a + ENDING[s]) for s, c, r, a in ends), key=lambda e: e[1:3])]
            for state, cost, rank, audit in ends:
                yield (self.conv_id, part, whole, start, state, cost, rank, audit, lead, *(self.counts[c] if lead else 0 for c in COUNTS),
                       self.first, self.last, self.turns, self.low, self.high)
                lead = False


def with_nulls_spelt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``; a null role or text is one space."""
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the contract's damage, with ``copies``: crc32 of ``conv_id:turn`` (null: one space) modulo 20 drops a
    row, empties its text, removes its sentence ends, repeats it or makes it the user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = with_nulls_spelt(conversations).withColumn("_kind", F.crc32(key.cast("binary")) % 20).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, 2).otherwise(1).cast("bigint")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _judged(rows: DataFrame) -> DataFrame:
    """Different rows (conv_id, turn, role, digest of the text) with their copies and faults; texts stay behind."""
    solid = F.btrim(F.col("text"), F.lit(SPACE))
    narrow = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "copies", (solid == "").alias("blank"),
        (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    grouped = narrow.groupBy(*ORDER).agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    grouped = materialise(grouped, "turns")
    seen = grouped.groupBy(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")]).agg(
        F.min("turn").alias("_least"), F.max(F.col("turn").isNull()).alias("_null")
    )
    same = grouped["conv_id"].eqNullSafe(seen["_conv_id"]) & (grouped["role"] == seen["_role"]) & (grouped["digest"] == seen["_digest"])
    earliest = F.col("turn").isNull() | (~F.col("_null") & (F.col("turn") == F.col("_least")))
    return grouped.join(seen, same).select(*ORDER, "copies", "blank", earliest.alias("earliest"), "truncated")


def _pieces(judged: DataFrame) -> DataFrame:
    """Viterbi of the pieces into which a range partitioning cuts the conversations, one pass over narrow rows.

    Only the first and the last piece of a task can belong to a conversation that others share; the first one is
    decoded from every state it may start in, and both keep all states they may end in.
    """
    kind = judged.schema["conv_id"].dataType.simpleString()
    schema = PIECE.format(kind=kind)
    ordered = judged.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    chosen = ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "copies", "blank", "earliest", "truncated")
    arrow = to_arrow_schema(judged.sparkSession.createDataFrame([], schema).schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, out, size, first = TaskContext.get().partitionId(), None, [], 0, True
        for b in batches:
            for conv_id, *row in zip(*[c.to_pylist() for c in b.columns]):
                if piece is None:
                    piece = Piece(conv_id, range(STATES))
                elif conv_id != piece.conv_id:
                    done = list(piece.rows(part, not first))
                    first, piece = False, Piece(conv_id, range(1))
                    out += done
                    size += 50 + sum(len(r[7]) for r in done)
                    if size > FLUSH:
                        yield batch(out)
                        out, size = [], 0
                piece.add(*row)
        if piece is not None:
            out += piece.rows(part, False)
        if out:
            yield batch(out)

    return materialise(chosen.mapInArrow(run, schema), "pieces")


def _join_pieces(pieces: DataFrame) -> DataFrame:
    """``(conv_id, cost, audit)`` of the conversations that tasks share, by the same rule over whole pieces.

    Costs and ranks decide which start and end each piece takes; its audit is fetched after that.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    narrow = pieces.select("conv_id", "part", "start", "end", "cost", "rank").repartition("conv_id").sortWithinPartitions("conv_id", "part", "start", "end")
    schema = f"_conv_id {kind}, _part int, _start int, _end int, total bigint, ending string"

    def solve(conv_id, parts: list[tuple[int, list[tuple]]]) -> Iterator[tuple]:
        alive = {0: (0, 0, None)}
        for part, options in parts:
            best: dict[int, tuple] = {}
            for start, end, cost, rank in options:
                if start in alive:
                    before = alive[start]
                    key = (before[0] + cost, before[1], rank)
                    if end not in best or key < best[end][0]:
                        best[end] = (key, (part, start, end, before[2]))
            order = sorted(best, key=lambda x: best[x][0][1:])
            alive = {x: (best[x][0][0], place, best[x][1]) for place, x in enumerate(order)}
        state = min(alive, key=lambda x: (alive[x][0] + INSERT * len(ENDING[x]), alive[x][1]))
        total, path = alive[state][0] + INSERT * len(ENDING[state]), alive[state][2]
        while path:
            part, start, end, path = path
            yield conv_id, part, start, end, total, ENDING[state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, parts = [], None, []
        for b in batches:
            kinds = b.schema.field(0).type
            for conv_id, part, *row in zip(*[c.to_pylist() for c in b.columns]):
                if parts and conv_id != current:
                    out += solve(current, parts)
                    parts = []
                if not parts or parts[-1][0] != part:
                    parts.append((part, []))
                current = conv_id
                parts[-1][1].append(tuple(row))
        if parts:
            out += solve(current, parts)
        if out:
            names, types = ["_conv_id", "_part", "_start", "_end", "total", "ending"], [kinds, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    taken = narrow.mapInArrow(run, schema)
    same = pieces["conv_id"].eqNullSafe(taken["_conv_id"]) & (pieces["part"] == taken["_part"]) & (pieces["start"] == taken["_start"]) & (pieces["end"] == taken["_end"])
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"])
    return pieces.join(taken, same).groupBy("conv_id").agg(F.first("total").alias("cost"), F.concat(F.array_join(in_order, ""), F.first("ending")).alias("audit"))


def _summaries(pieces: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation with rows."""
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    whole = pieces.filter("whole").select("conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit")
    shared = pieces.filter("NOT whole")
    seam = "OVER (PARTITION BY conv_id ORDER BY part)"
    legal = ", ".join(f"'{p}'" for p in sorted(LEGAL))
    leads = shared.filter("lead").selectExpr(
        "*", f"cast(lag(high) {seam} <=> low AND low IS NOT NULL AS bigint) AS _twice",
        f"cast(coalesce(concat(lag(last) {seam}, first) NOT IN ({legal}), false) AS bigint) AS _seam",
    )
    counted = leads.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns") + F.sum("_twice"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in COUNTS[:3]], (F.sum("illegal") + F.sum("_seam")).alias("illegal"),
    )
    joined = _join_pieces(shared).withColumnRenamed("conv_id", "_conv_id")
    open_ones = counted.join(joined, counted["conv_id"].eqNullSafe(joined["_conv_id"])).drop("_conv_id")
    return whole.unionByName(open_ones)


class Repairer:
    """Feeds rows in order to the edits of an audit and hashes the repaired lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.lines = audit, 0, 0, sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(NEXT_ROLE[self.state], "")
            self.state, self.at = 3 if self.state == 2 else 2, self.at + 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            role = NEXT_ROLE[self.state]
        if edit != "D":
            self._line(role, text)
            self.state = "sua".index(role[0]) + 1

    def digest(self) -> str:
        self._insert()
        return self.hash.hexdigest()


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every ``conv_id`` of
    ``conversations`` (conv_id, turn, role, text), for its ``rows`` (the same with ``copies``; none: those of ``conversations``).

    Rows count in the order of their turns, null turns first, then by role and by digest of the text; repeated rows
    follow each other.  Null roles and texts are one space, a null ``conv_id`` is a conversation of its own, other
    columns are not read.  A role that is empty or has another initial cannot be kept.  A conversation without rows
    has zeros, an empty audit and the hash of the empty string; no conversations give no rows.

    Copies are added up before the shuffle.  Narrow rows (texts as flags and digests) are range-partitioned by
    conversation and order, so a conversation of any length is spread over tasks; every task decodes its pieces, and
    pieces are joined by costs and ranks alone.  Only the last step reads texts: the repaired lines of a conversation
    pass one after another through its hash, which cannot be computed in parts, in one task that holds the audit and
    one batch of rows.
    """
    if rows is None:
        rows = with_nulls_spelt(conversations).withColumn("copies", F.lit(1).cast("bigint"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    found = _summaries(_pieces(_judged(rows))).withColumnRenamed("conv_id", "_conv_id")
    ids = conversations.select("conv_id").distinct()
    numbers = ("gaps", *COUNTS, "cost")
    summary = ids.join(found, ids["conv_id"].eqNullSafe(found["_conv_id"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit")
    )
    texts = rows.select("conv_id", "turn", "role", "text", "copies", F.unhex(F.sha2("text", 256)).alias("digest"))
    mixed = texts.unionByName(summary, allowMissingColumns=True).withColumn("_row", F.col("copies").isNotNull())
    ordered = mixed.repartition("conv_id").sortWithinPartitions("conv_id", "_row", "turn", "role", "digest")
    names = ("conv_id", *numbers, "audit", "repaired_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, repairer = None, None
        for b in batches:
            out, ids = [], b.schema.field(0).type
            for conv_id, role, text, copies, *values in zip(*[c.to_pylist() for c in b.columns]):
                if copies is None:
                    if held is not None:
                        out.append((*held, repairer.digest()))
                    held, repairer = (conv_id, *values), Repairer(values[-1])
                else:
                    for _ in range(copies):
                        repairer.row(role, text)
            if out:
                yield _result(out, ids)
        if held is not None:
            yield _result([(*held, repairer.digest())], ids)

    def _result(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        types = [ids] + [pa.int64()] * len(numbers) + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))

    schema = f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in numbers) + ", audit string, repaired_sha256 string"
    return ordered.select("conv_id", "role", "text", "copies", *numbers, "audit").mapInArrow(run, schema)


def _values(rows) -> str:
    return ", ".join(str(tuple(r)) for r in rows)


OP12_SQL = rf"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
bytes AS (SELECT DISTINCT key FROM hit),
crc(key, done, c) AS (
  SELECT key, 0, 4294967295::BIGINT FROM bytes
  UNION ALL
  SELECT key, done + 1, list_reduce([xor(c, ord(key[done + 1])::BIGINT), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))
  FROM crc WHERE done < length(key)),
kinds AS (SELECT key, xor(c, 4294967295) % 20 AS kind FROM crc WHERE done = length(key)),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, n
  FROM hit JOIN kinds USING (key), range(2) t(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM rows_),
seen AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
judged AS (SELECT *, final = '' AS blank, final <> '' AND again AS duplicate, final <> '' AND NOT again AND final NOT IN ('.', '!', '?') AS truncated FROM seen),
moves(i, symbol, j, inserted) AS (VALUES {_values(MOVES)}),
options AS (
  SELECT i, symbol, j, inserted, edit, CASE edit WHEN 'R' THEN {REROLE} ELSE {KEEP} END AS price FROM moves, (VALUES ('K'), ('R')) e(edit) WHERE symbol <> 's' OR edit = 'K'
  UNION ALL SELECT i, '', i, 0, 'D', {DELETE} FROM range({STATES}) s(i)),
best AS (
  SELECT conv_id, 0::BIGINT AS pos, 0::BIGINT AS state, {{'cost': 0::BIGINT, 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS s FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT b.conv_id, b.pos + 1, CAST(o.j AS BIGINT), min({{
      'cost': b.s.cost + o.price + {INSERT} * o.inserted + CASE WHEN o.edit <> 'D' AND d.truncated THEN {UNDELETED_TRUNCATED} ELSE 0 END,
      'audit': b.s.audit || repeat('I', o.inserted::BIGINT) || o.edit,
      'lines': list_concat(b.s.lines, list_concat(CASE WHEN o.inserted = 1 THEN [CASE WHEN b.state = 2 THEN 'assistant:' ELSE 'user:' END] ELSE CAST([] AS VARCHAR[]) END,
        CASE o.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [d.role || ':' || d.text]
          ELSE [CASE o.symbol WHEN 'u' THEN 'user:' ELSE 'assistant:' END || d.text] END))}})
  FROM best b JOIN judged d ON d.conv_id IS NOT DISTINCT FROM b.conv_id AND d.pos = b.pos + 1
  JOIN options o ON o.i = b.state AND (o.edit = 'D' OR NOT d.blank AND NOT d.duplicate AND (o.edit = 'R' OR o.symbol = d.initial))
  GROUP BY b.conv_id, b.pos, o.j),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
ended AS (
  SELECT b.conv_id, min({{'cost': s.cost + {INSERT} * length(e.tail), 'audit': s.audit || e.tail,
      'lines': list_concat(s.lines, CASE e.tail WHEN 'I' THEN ['assistant:'] WHEN 'II' THEN ['user:', 'assistant:'] ELSE CAST([] AS VARCHAR[]) END)}}) AS s
  FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
  JOIN (VALUES {_values(enumerate(ENDING))}) e(state, tail) ON e.state = b.state WHERE b.pos = coalesce(c.n, 0) GROUP BY b.conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(s.cost AS BIGINT) AS cost, s.audit AS audit,
  sha256(array_to_string(s.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op12_turn_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(conversations, damaged(conversations))
