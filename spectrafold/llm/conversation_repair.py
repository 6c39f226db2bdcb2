"""Repair of conversations to an allowed order of roles by cheapest edits, reconstructed in linear space.

A conversation's turns are kept, given another role, deleted, or turns without text are inserted, so that the
initials of its roles read ``(s?(ua)+)?``. What has been accepted so far leaves one of four states (nothing
yet, after s, after u, after a), so a run of turns is a step between four-state cost vectors.

The edits come from Hirschberg's divide and conquer: costs from the front and costs to the end meet in the
middle of a run, the best crossing state is chosen, and both halves are solved alone. Beside its costs the forward
vector carries the order of the four least edit strings that reach the states; strings of different states differ
before either ends, so among equally cheap crossings the lowest in that order leads to the least string.

Turns are sorted over all conversations and cut into blocks. A conversation that runs over several
blocks hands on one 4 x 4 cost table a block; crossings at block borders are found first, and every block
is then solved alone. A task holds one byte a turn of its conversation's part; the driver two tables a block.

Results for odd input: null role or text is one space; a null conv_id is a conversation of its own; null turns
come first; turns of equal number follow role and text; repeated rows are repeated turns, all but the
first duplicates; a conversation that loses all its turns has zeros and an empty audit; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import sorted_blocks
from .registry import WHITE, query, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
START, S, U, A = range(4)
FREE = -1  # any state that may end a conversation
FAR = 1 << 40  # more than any cost
SOUND, CUT, GONE = 0, 1, 2  # faults: none, truncated, must be deleted
LOST = 255  # code of a row that only names its conversation

_AFTER = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
_FILL = {START: U, S: U, U: A, A: U}  # the state after an insertion
_TAIL = {START: (0, ""), A: (0, ""), U: (INSERT, "I"), S: (2 * INSERT, "II")}


def _words(initial: str, fault: int) -> list[list[tuple[int, str] | None]]:
    """Cost and edits of the best way over one turn, from each state to each."""
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state, cost, done = start, 0, ""
        for _ in range(4):
            ways = [(DELETE, "D", state)]
            if fault != GONE:
                more = TRUNCATED if fault == CUT else 0
                kept = _AFTER.get((state, initial))
                ways += [(KEEP + more, "K", kept)] if kept is not None else []
                ways += [(REROLE + more, "R", to) for (at, role), to in _AFTER.items() if at == state and role != "s"]
            for price, edit, to in ways:
                way = (cost + price, done + edit)
                if table[start][to] is None or way < table[start][to]:
                    table[start][to] = way
            state, cost, done = _FILL[state], cost + INSERT, done + "I"
    return table


# by code: initial (s, u, a, other) + 4 x fault
WORDS = [_words("sua-"[c % 4], c // 4) for c in range(12)]
_STEPS = [[[(s, w[0], w[1]) for s in range(4) if (w := table[s][to])] for to in range(4)] for table in WORDS]
_BACK = [[[(to, w[0]) for to in range(4) if (w := table[s][to])] for s in range(4)] for table in WORDS]


def _front(codes, lo: int, hi: int, cost: list[int], rank: list[int]) -> tuple[list[int], list[int]]:
    """Costs of the states after the turns lo..hi, and the order of the least edit strings to them."""
    for k in range(lo, hi):
        new, order = [FAR] * 4, []
        for to, ways in enumerate(_STEPS[codes[k]]):
            best = min(((cost[s] + w, rank[s], word) for s, w, word in ways if cost[s] < FAR), default=None)
            if best:
                new[to] = best[0]
                order.append((best[1], best[2], to))
        cost, rank = new, [9] * 4
        for place, (_, _, to) in enumerate(sorted(order)):
            rank[to] = place
    return cost, rank


def _rear(codes, lo: int, hi: int, cost: list[int]) -> list[int]:
    """Costs from each state before the turns lo..hi to the end that ``cost`` describes."""
    for k in range(hi - 1, lo - 1, -1):
        cost = [min(w + cost[to] for to, w in ways) for ways in _BACK[codes[k]]]
    return cost


def _only(state: int) -> list[int]:
    return [0 if s == state else FAR for s in range(4)]


def _goal(end: int) -> list[int]:
    return [_TAIL[s][0] for s in range(4)] if end == FREE else _only(end)


def _crossing(front: list[int], rank: list[int], rear: list[int]) -> int:
    return min((front[s] + rear[s], rank[s], s) for s in range(4) if front[s] < FAR and rear[s] < FAR)[2]


def edits(codes, start: int = START, end: int = FREE) -> str:
    """The cheapest edits of a run of turns between two states, least in ASCII order among equals."""
    if end == FREE:
        front, rank = _front(codes, 0, len(codes), _only(start), [0] * 4)
        end = _crossing(front, rank, _goal(FREE))
        return edits(codes, start, end) + _TAIL[end][1]
    parts: list[str] = []
    todo = [(0, len(codes), start, end)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo == 1:
            parts.append(WORDS[codes[lo]][a][b][1])
        elif hi > lo:
            mid = (lo + hi) // 2
            front, rank = _front(codes, lo, mid, _only(a), [0] * 4)
            cross = _crossing(front, rank, _rear(codes, mid, hi, _only(b)))
            todo += [(mid, hi, cross, b), (lo, mid, a, cross)]
    return "".join(parts)


def crossing_table(codes) -> list:
    """Costs and orders from each state to each over a run of turns."""
    return [list(_front(codes, 0, len(codes), _only(s), [0] * 4)) for s in range(4)]


# -- tables ------------------------------------------------------------------------------

def turns(df: DataFrame, gone: str | None = None, copies: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, copies, code of every distinct turn, sorted in blocks, with ``at`` in that order.

    ``gone`` and ``copies`` name columns of ``df``: a row that is gone only keeps its conversation in the result,
    and a row counts as so many equal ones.
    """
    gone = F.coalesce(gone, F.lit(False)) if gone else F.lit(False)
    rows = df.select("conv_id", F.when(~gone, F.col("turn").cast("long")).alias("turn"),
                     F.when(~gone, F.coalesce("role", F.lit(" "))).alias("role"),
                     F.when(~gone, F.coalesce("text", F.lit(" "))).alias("text"), gone.alias("gone"),
                     (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"))
    rows = rows.groupBy("conv_id", "gone", "turn", "role", "text").agg(F.sum("n").alias("copies"))
    # the digest stands for role and text
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    first = (rows.filter(~F.col("gone")).groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    again = F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))
    initial = F.substring("role", 1, 1)
    last = F.regexp_extract("text", rf"(?s).*([^{WHITE}])", 1)
    fault = F.when((last == "") | again, GONE).when(~last.isin(".", "!", "?"), CUT).otherwise(SOUND)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + 4 * fault
    why = F.when(last == "", "blank").when(again, "duplicate").when(fault == CUT, "truncated")
    made = rows.select("conv_id", "turn", "role", "text", "copies", why.alias("fault"),
                       F.when(F.col("gone"), LOST).otherwise(code).cast("int").alias("code"))
    return sorted_blocks(made, "conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())


def _segments(batches) -> Iterator[tuple]:
    """block, conversation, first place and codes (a byte a turn) of each run of a conversation in a block."""
    key, held, at, block = None, bytearray(), 0, 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("block", "conv_id", "at", "copies", "code")]
        for b, conv, place, copies, code in zip(*cols):
            if key != (conv,):
                if key is not None:
                    yield block, key[0], at, held
                key, held, at, block = (conv,), bytearray(), place, b
            if code != LOST:
                held.append(code)
                held.extend(bytes([code % 4 + 4 * GONE]) * (copies - 1))
    if key is not None:
        yield block, key[0], at, held


def _border(batches):
    """The first and the last conversation of a block, each with its cost table."""
    ends: list = []
    block = None
    for block, conv, _, codes in _segments(batches):
        if len(ends) < 2:
            ends.append([conv, codes])
        else:
            ends[1] = [conv, codes]
    if ends:
        note = json.dumps([[conv, crossing_table(codes)] for conv, codes in ends])
        yield pa.RecordBatch.from_pydict({"block": [block], "note": [note]})


def _joints(found: list[tuple[int, str]]) -> dict[int, dict]:
    """For each block the state in which its first conversation comes in and its last goes out."""
    joints: dict[int, dict] = {}
    chain: list[tuple[int, list]] = []  # block and table of each part of the conversation that is open

    def close():
        if len(chain) > 1:
            steps, cost, rank = [], _only(START), [0] * 4
            for _, rows in chain:
                new, order, came = [FAR] * 4, [], [START] * 4
                for to in range(4):
                    best = min(((cost[s] + rows[s][0][to], rank[s], rows[s][1][to], s) for s in range(4)))
                    if best[0] < FAR:
                        new[to], came[to] = best[0], best[3]
                        order.append((best[1], best[2], to))
                cost, rank = new, [9] * 4
                for place, (_, _, to) in enumerate(sorted(order)):
                    rank[to] = place
                steps.append(came)
            state = _crossing(cost, rank, _goal(FREE))
            for k in range(len(chain) - 1, -1, -1):
                block, last = chain[k][0], k == len(chain) - 1
                if not last:
                    joints.setdefault(block, {})["out"] = state
                state = steps[k][state]
                if k:
                    joints.setdefault(block, {})["in"] = state
                if last:
                    # the end of the whole conversation is solved in its last block
                    joints[block]["ends"] = True

    key = None
    for block, note in sorted(found):
        ends = json.loads(note)
        if key != (ends[0][0],):
            close()
            chain = []
        chain.append((block, ends[0][1]))
        if len(ends) > 1:
            close()
            chain = [(block, ends[1][1])]
        key = (ends[-1][0],)
    close()
    return joints


def plan_edits(rows: DataFrame) -> DataFrame:
    """conv_id, at, audit: the edits of each run of a conversation in a block; ``at`` is the run's first place."""
    slim = rows.select("block", "conv_id", "at", "copies", "code")
    joints = _joints([tuple(r) for r in slim.mapInArrow(_border, "block long, note string").collect()])

    def solve(batches):
        out: dict[str, list] = {"conv_id": [], "at": [], "audit": []}
        runs = _segments(batches)
        now = next(runs, None)
        first = True
        while now is not None:
            after = next(runs, None)
            block, conv, at, codes = now
            here = joints.get(block, {})
            start = here.get("in", START) if first else START
            end = here.get("out", FREE) if after is None else FREE
            out["conv_id"].append(conv)
            out["at"].append(at)
            out["audit"].append(edits(codes, start, end))
            now, first = after, False
            if len(out["at"]) >= 1000 or now is None:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("audit", pa.string())]))
                out = {"conv_id": [], "at": [], "audit": []}

    return slim.mapInArrow(solve, "conv_id long, at long, audit string")


def _applied(batches) -> Iterator[tuple]:
    """conv_id, edit, turn, role, text, fault, new role for each edit; rows follow the edits of their run.

    None stands for a row that only names its conversation.
    """
    key, audit, k, state, given = None, "", 0, START, 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "copies", "code", "fault", "audit")]
        for conv, kind, turn, role, text, copies, code, fault, plan in zip(*cols):
            if key != (conv,):
                key, state = (conv,), START
                yield conv, None, None, None, None, None, None
            if kind == 0:
                audit, k = plan, 0
                given = len(audit) - audit.count("I")  # turns of the run
                if not given:
                    for _ in range(k, len(audit)):
                        state = _FILL[state]
                        yield conv, "I", None, None, None, None, "user" if state == U else "assistant"
                continue
            if code == LOST:
                continue
            for copy in range(copies):
                while audit[k] == "I":
                    state = _FILL[state]
                    yield conv, "I", None, None, None, None, "user" if state == U else "assistant"
                    k += 1
                edit = audit[k]
                k += 1
                given -= 1
                new = None
                if edit == "K":
                    state, new = _AFTER[state, role[:1]], role
                elif edit == "R":
                    state = U if state != U else A
                    new = "user" if state == U else "assistant"
                yield conv, edit, turn, role, text, fault if fault == "blank" or not copy else "duplicate", new
            while not given and k < len(audit):
                state = _FILL[state]
                yield conv, "I", None, None, None, None, "user" if state == U else "assistant"
                k += 1


def _streams(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Turns behind the edits of their run, each conversation in one stream."""
    given = rows.select("conv_id", "at", F.lit(1).alias("kind"), "turn", "role", "text", "copies", "code", "fault", F.lit(None).cast("string").alias("audit"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("copies", "long"), ("code", "int"), ("fault", "string"))]
    notes = plan.select("conv_id", "at", F.lit(0).alias("kind"), *nothing, "audit")
    return given.unionByName(notes).repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")


def repaired_turns(df: DataFrame) -> DataFrame:
    """conv_id, seq, edit, turn, role, text: every edit in order; role and text are the repaired ones, null where deleted."""
    rows = turns(df)

    def run(batches):
        names = ("conv_id", "seq", "edit", "turn", "role", "text")
        schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        out: list[tuple] = []
        seq = 0
        for conv, edit, turn, _, text, _, new in _applied(batches):
            if edit is None:
                seq = 0
                continue
            out.append((conv, seq, edit, turn, new, None if edit == "D" else text or ""))
            seq += 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=schema)

    return _streams(rows, plan_edits(rows)).mapInArrow(run, "conv_id long, seq long, edit string, turn long, role string, text string")


_REPORT = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])


def report(df: DataFrame, gone: str | None = None, copies: str | None = None) -> DataFrame:
    """One row a conversation: gaps, faults, illegal neighbours, cost, audit and digest of the repaired turns."""
    rows = turns(df, gone, copies)

    def run(batches):
        done: list[dict] = []
        now: dict = {}

        def close():
            span = now["high"] - now["low"] + 1 - now["distinct"] if now["distinct"] else 0
            done.append({"conv_id": now["conv"], "gaps": span, **now["faults"], "illegal": now["illegal"], "cost": now["cost"],
                         "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()})

        for conv, edit, turn, role, text, fault, new in _applied(batches):
            if edit is None:
                if now:
                    close()
                    if len(done) >= 500:
                        yield pa.RecordBatch.from_pylist(done, schema=_REPORT)
                        done = []
                now = {"conv": conv, "low": 0, "high": 0, "distinct": 0, "faults": {"blank": 0, "duplicate": 0, "truncated": 0}, "illegal": 0,
                       "cost": 0, "audit": [], "hash": hashlib.sha256(), "before": None, "lines": 0}
                continue
            now["audit"].append(edit)
            now["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            if edit != "I":
                if turn is not None and (not now["distinct"] or turn != now["high"]):
                    if not now["distinct"]:
                        now["low"] = turn
                    now["high"] = turn
                    now["distinct"] += 1
                if fault:
                    now["faults"][fault] += 1
                    now["cost"] += TRUNCATED if fault == "truncated" and edit != "D" else 0
                if now["before"] is not None and now["before"] + role[:1] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["before"] = role[:1]
            if edit != "D":
                line = f"{new}:{text if edit != 'I' else ''}"
                now["hash"].update((("\n" if now["lines"] else "") + line).encode("utf-8"))
                now["lines"] += 1
        if now:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_REPORT)

    return _streams(rows, plan_edits(rows)).mapInArrow(
        run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


# -- the query ---------------------------------------------------------------------------

def damaged(df: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by the checksum of id and turn."""
    name = F.concat(*[x for c, tail in (("conv_id", ":"), ("turn", "")) for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(tail))])
    kind = F.crc32(F.encode(name, "UTF-8")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("kind"))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies")))


CRC = ("xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: CAST(ord({0}[i]) AS BIGINT)), lambda crc, b: "
       "list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(crc, b)), "
       "CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))")

# one turn after the other, the best way to each state and its repaired lines in each row; insertions stand before a turn
_SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (SELECT *, {CRC.format('name')} % 20 AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         regexp_extract(text, '(?s).*([^\\x20\\x09-\\x0D])', 1) AS last FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS c, CASE WHEN last = '' THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
         WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
fills AS (  -- insertions before a turn: from, to, edits, lines
  SELECT * FROM (VALUES ('e', 'e', 0, '', []), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
    ('e', 'u', 5, 'I', ['user:']), ('s', 'u', 5, 'I', ['user:']), ('a', 'u', 5, 'I', ['user:']), ('u', 'a', 5, 'I', ['assistant:']),
    ('e', 'a', 10, 'II', ['user:', 'assistant:']), ('s', 'a', 10, 'II', ['user:', 'assistant:'])) t(a, b, price, edits, lines)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 'e' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, state, best.cost, best.audit, best.lines FROM (
    SELECT conv_id, pos, state, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS best FROM (
      SELECT w.conv_id, f.pos, w.cost + i.price + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
               + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END AS cost,
             w.audit || i.edits || e.edit AS audit,
             CASE e.edit WHEN 'D' THEN i.b WHEN 'K' THEN f.c ELSE CASE i.b WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
             list_concat(w.lines, CAST(i.lines AS VARCHAR[]), CASE e.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [f.role || ':' || f.text]
               ELSE [CASE i.b WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || f.text] END) AS lines
      FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1
        JOIN fills i ON i.a = w.state, (VALUES ('K'), ('R'), ('D')) e(edit)
      WHERE e.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR i.b || f.c IN ('es', 'eu', 'su', 'ua', 'au')))
    ) GROUP BY conv_id, pos, state)),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
ends AS (
  SELECT w.conv_id, min({{'cost': w.cost + t.price, 'audit': w.audit || t.edits, 'lines': list_concat(w.lines, CAST(t.lines AS VARCHAR[]))}}) AS best
  FROM walk w LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id
    JOIN (SELECT * FROM fills WHERE b = 'a' OR (a = 'e' AND b = 'e')) t ON t.a = w.state
  WHERE w.pos = coalesce(f.n, 0) GROUP BY w.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM ends e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op13_conversation_repair", _SQL)
def conversation_repair(spark, folder):
    """All conversations with planted faults: what is wrong with each, and its cheapest repair."""
    return report(damaged(table(spark, folder, "conversations")), "gone", "copies")
