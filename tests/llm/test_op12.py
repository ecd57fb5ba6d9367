"""The conversation trie against brute force, whole and split as far as it goes, and on odd rows."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hushframe.llm import op12_conversation_trie as op


def brute(rows):
    """All nodes, by looking at every beginning of every conversation."""
    turns = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in turns.items()}
    paths = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + x[h:]
    members = {}
    for c, x in paths.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved, out = {}, {}, set()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in kids.get(node, []))
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(paths[c]) == len(node)))
        out.add((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("depth", "sizes", "key", "n", "ends", "base", "h", "path")})


def conversations():
    draw = random.Random(5)
    rows = []
    for c in range(300):
        shared = 0 if c % 3 else 12  # a third begin with one long conversation
        n = shared + draw.randrange(1, 6)
        rows += [(c, t, "user" if t % 2 else "system", f"same {t}" if t < shared else draw.choice(["yes", "nö", "", "maybe"])) for t in range(n)]
    rows += [(c, t, "user", "copy") for c in range(1000, 1100) for t in range(4)]
    rows += [(2003, t, None if t % 7 else "x", None if t % 5 else f"long {t}") for t in range(400)]  # alone, and without the conversation that it begins with
    rows += [(3000, None, "user", "first"), (3000, 0, "user", "second"), (3000, 0, "user", "second"), (3000, 0, "a", "before"), (None, 1, "user", "nobody"), (-3, 0, "user", "below zero")]
    return rows


@pytest.mark.parametrize("limit", [op.LIMIT, 20, 3])
def test_equals_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(op, "LIMIT", limit)
    monkeypatch.setattr(op, "BUCKET", 4 * limit)
    monkeypatch.setattr(op, "PIECE", 50)
    rows = conversations()
    got = [tuple(r) for r in op.trie(op.rebuilt(made(spark, rows))).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_turnless_and_nothing(spark):
    assert op.trie(op.rebuilt(made(spark, []))).count() == 0
    assert op.trie(op.rebuilt(made(spark, [(None, 1, "user", "nobody")]))).count() == 0
    rows = [(3, 0, "user", "gone")]  # its own first turns are another's, which isn't there
    assert zlib.crc32(b"3") % 9 >= 1
    assert {tuple(r) for r in op.trie(op.rebuilt(made(spark, rows))).collect()} == brute(rows)


def test_own_sequences(spark):
    """Without the rebuilding: the operator's general form."""
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a"), (7, 0, "user", "ab")]
    got = {tuple(r)[:6] for r in op.trie(op.sequences(made(spark, rows))).collect()}
    assert got == {(1, 0, None, 3, 2, 2), (1, 1, 1, 2, 1, 1), (1, 2, 1, 1, 0, 1), (7, 1, 1, 1, 0, 1)}
