"""Conversation repair and the prefix trie against brute force, on given and on odd rows, cut into many blocks."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import cases
import numpy as np
import pytest

from spectrafold.llm import conversation_repair as cr
from spectrafold.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, pos long, code int, a long, depth long, copies long, `x.y` string"
MORE = (True, 2, 3, 4, 5, 6, "z")


def key(v):
    return (v is not None, v)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(-n // 4, n):
        size = rng.choice([1, 2, 5, longest])
        for t in range(size):
            if rng.random() < 0.9:
                text = rng.choice(["", " \t", "Yes.", "no", "Well?", cases.prose(rng.randint(0, 9), 3) + rng.choice([".", "!", " ", ",", ""]), None])
                rows.append((c, t + rng.choice([0, 0, 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
        if rng.random() < 0.2:
            rows.append((c, None, "system", "First."))
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA).repartition(parts)


# -- repair ------------------------------------------------------------------------------

def best_edits(codes):
    """All ways by a plain table of costs and strings."""
    ways = {cr.START: (0, "")}
    for c in codes:
        for _ in range(3):  # insertions
            for s, (cost, word) in list(ways.items()):
                to = cr._FILL[s]
                ways[to] = min(ways.get(to, (10**9, "")), (cost + 5, word + "I"))
        after = {}
        for s, (cost, word) in ways.items():
            options = [(2, "D", s)]
            initial, fault = "sua-"[c % 4], c // 4
            if fault != cr.GONE:
                extra = 5 * (fault == cr.CUT)
                if (s, initial) in cr._AFTER:
                    options.append((extra, "K", cr._AFTER[s, initial]))
                options += [(1 + extra, "R", cr._AFTER[s, r]) for r in "ua" if (s, r) in cr._AFTER]
            for price, edit, to in options:
                after[to] = min(after.get(to, (10**9, "")), (cost + price, word + edit))
        ways = after
    return min((cost + cr._TAIL[s][0], word + cr._TAIL[s][1]) for s, (cost, word) in ways.items())[1]


@pytest.mark.parametrize("seed", range(6))
def test_edits_are_cheapest_and_least(seed):
    rng = random.Random(seed)
    for size in [0, 1, 2, 3, 5, 8, 21, 60] * 8:
        codes = bytes(rng.choice(range(12)) if rng.random() < 0.4 else rng.randrange(3) for _ in range(size))
        assert cr.edits(codes) == best_edits(codes)


def test_joints_solve_conversations_over_blocks():
    rng = random.Random(3)
    for _ in range(200):
        parts = [bytes(rng.randrange(12) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 6))]
        found = []
        import json
        for b, p in enumerate(parts):
            ends = [[7, cr.crossing_table(p)]]
            if b == 0:
                ends = [[3, cr.crossing_table(b"\x01")], *ends]
            if b == len(parts) - 1:
                ends = [*ends[-1:], [9, cr.crossing_table(b"\x01")]] if b else [ends[0], ends[-1]]
            found.append((2 * b, json.dumps(ends)))
        joints = cr._joints(found)
        if len(parts) == 1:
            continue
        got = "".join(cr.edits(p, joints.get(2 * b, {}).get("in", cr.START), joints.get(2 * b, {}).get("out", cr.FREE) if b < len(parts) - 1 else cr.FREE)
                      for b, p in enumerate(parts))
        assert got == best_edits(b"".join(parts))


def plain_report(rows):
    """The contract, row by row; ``rows`` after damage, None for a dropped one's text."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c]
        if x is not None:
            by[c].append((t, r, x))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda v: (key(v[0]) if v[0] is not None else (False, 0), v[1], v[2]))
        seen, counts, codes = set(), defaultdict(int), []
        for t, r, x in turns:
            bare = x.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((r, x))
            counts[fault] += 1
            codes.append(("sua".index(r[:1]) if r[:1] and r[:1] in "sua" else 3) + 4 * (2 if fault in ("blank", "duplicate") else 1 if fault else 0))
        audit = best_edits(codes)
        state, k, lines, cost = cr.START, 0, [], 0
        for e in audit:
            if e == "I":
                state = cr._FILL[state]
                lines.append("user:" if state == cr.U else "assistant:")
                cost += 5
                continue
            t, r, x = turns[k]
            cost += {"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and codes[k] // 4 == 1)
            k += 1
            if e == "K":
                state = cr._AFTER[state, r[:1]]
                lines.append(f"{r}:{x}")
            elif e == "R":
                state = cr.A if state == cr.U else cr.U
                lines.append(("user:" if state == cr.U else "assistant:") + x)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def plain_damage(rows):
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            yield c, t, r, None
            continue
        x = "" if kind == 1 else x.translate({ord(m): None for m in ".!?"}) if kind == 2 else x
        r = "user" if kind == 4 else r
        for _ in range(2 if kind == 3 else 1):
            yield c, t, r, x


def fields(r):
    return tuple(r[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def test_repair_of_odd_conversations(spark):
    rows = conversations(1, 60, 40) + [(None, 1, "user", "Hi."), (None, None, None, None), (None, 1, "user", "Hi.")]
    rows += [(777, t % 9, "user", "Same.") for t in range(300)] + [(778, t, "system", "x" * 70_000 + ".") for t in range(3)] + rows[:20]
    want = plain_report(list(plain_damage(rows)))
    got = {r["conv_id"]: fields(r) for r in cr.report(cr.damaged(frame(spark, rows)), "gone", "copies").collect()}
    assert got == want


def test_one_conversation_over_all_blocks(spark):
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", "C!"]) + str(rng.randrange(4)) + rng.choice([".", ""])) for t in range(400)]
    rows += [(4, 0, "user", "Q?"), (6, 0, "assistant", "A.")]
    got = {r["conv_id"]: fields(r) for r in cr.report(frame(spark, rows)).collect()}
    assert got == plain_report(rows)
    table = cr.turns(frame(spark, rows))
    assert table.filter("conv_id = 5").select("block").distinct().count() > 1
    kept = [r for r in cr.repaired_turns(frame(spark, rows)).filter("conv_id = 5 and edit <> 'D'").orderBy("seq").collect()]
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == got[5][-1]


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.report(empty).collect() == [] and cr.repaired_turns(empty).collect() == []
    assert ct.prefix_trie(ct.shared_starts(empty)).collect() == []


# -- trie --------------------------------------------------------------------------------

def plain_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
            by[c].append(((t is not None, t or 0), int(digest[:15], 16), int(digest[15:30], 16), (r, x)))
    turns = {c: [v[-1] for v in sorted(rows, key=lambda v: v[:3])] for c, rows in by.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = defaultdict(set)
    for seq in nodes:
        if seq:
            children[seq[:-1]].add(seq)
    leaves, saved, out = {}, {}, set()
    for seq in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[seq]) - 1) * (len(seq[-1][1].encode()) if seq else 0)
        leaves[seq] = sum(leaves[k] for k in children[seq]) or 1
        saved[seq] = own + sum(saved[k] for k in children[seq])
    for seq, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(seq)))
        out.add((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(children[seq]), leaves[seq], saved[seq],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(nodes)


def nodes_of(df):
    return [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


@pytest.mark.parametrize("heavy, least, queue", [(ct.HEAVY, ct.LEAST_SHARD, ct.QUEUE), (40, 3, 2)])
def test_trie_of_odd_conversations(spark, heavy, least, queue):
    rows = conversations(2, 70, 12)
    rows += [(c, t, "user", "Hello there, everyone.") for c in range(1000, 1120) for t in range(3)] + [(None, 1, "user", "x"), (2000, None, None, None)]
    rows += rows[:30] + [(3000, t, "user", "é" * 10) for t in range(500)]
    want, n = plain_trie(rows)
    got = nodes_of(ct.prefix_trie(ct.shared_starts(frame(spark, rows)), heavy, least, queue))
    assert len(got) == n and set(got) == want


def test_spilling_queue():
    rng = random.Random(1)
    queue, plain, out = ct.SpillQueue(3, 50), [], []
    for _ in range(5000):
        if rng.random() < 0.6 or not plain:
            item = (rng.randrange(1000), rng.randrange(-2**62, 2**62), 1)
            queue.push(item)
            plain.append(item)
        else:
            assert queue.least() == min(plain)
            out.append(queue.pop())
            plain.remove(out[-1])
    while queue.least() is not None:
        out.append(queue.pop())
    assert queue.spilled > 5 and sorted(out[-len(plain):]) == sorted(plain)


def test_heavy_nodes_are_bounded(spark):
    rows = [(c, t, "user", "same") for c in range(200) for t in range(c % 7 + 1)]
    turns = ct.shared_starts(frame(spark, rows))
    pairs, lengths = ct.prefixes(turns), turns.groupBy("conv_id").agg({"length": "max"}).withColumnRenamed("max(length)", "length")
    for heavy in (1, 3, 10):
        limit, top = ct.heavy_nodes(pairs, lengths, heavy, 1)
        assert len(top) <= heavy
