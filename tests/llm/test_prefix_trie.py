"""Subtree totals on random trees, and the trie against a plain account of the contract."""

import hashlib
import random
import zlib

from escalade.llm import prefix_trie as p
from escalade.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    nodes, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[:len(seq)] == seq]
        leaf = lambda s: not any(len(x) == len(s) + 1 and x[:-1] == s for x in nodes)
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members),
                    sum(len(x) == len(seq) + 1 for x in below), sum(leaf(s) for s in below),
                    sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in below if s),
                    hashlib.sha256(",".join(map(str, sorted(ends.get(seq, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, path, **extra):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as d", "'x' as conv").write.parquet(f"{path}/conversations.parquet")
    return sorted((tuple(r) for r in QUERIES["op12_prefix_trie"](spark, path).collect()), key=str)


def test_query_on_odd_rows(spark, tmpdir_path):
    rng = random.Random(12)
    rows = [(None, 0, "user", "x"), (0, None, None, "first"), (0, 1, "user", None), (100, 0, "user", "a"), (305, 1, "user", "lonely"),
            (2**40 + 7, 0, "user", "far")]
    for c in list(range(1, 40)) + list(range(101, 115)):
        rows += [(c, rng.choice([None, i, i, i + 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é😀", "", None]))
                 for i in range(rng.randrange(1, 9))]
    rows += [(50, 0, "user", "same")] * 6 + [(51, 0, "user", "same")] * 6 + [(52, 0, "user", "same")] * 7
    assert run(spark, rows, tmpdir_path) == brute(rows)


def test_long_conversation_over_parts_and_blocks(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(p, "_BLOCK", 16)
    rows = [(7, i, "user", f"t{i % 3}") for i in range(150)] + [(8, i, "user", f"t{i % 3}") for i in range(90)] + [(9, 0, "user", "t0")]
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    assert run(spark, rows, tmpdir_path) == brute(rows)


def test_many_copies_of_one_conversation(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(p, "_IDS", 8)
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(7)]
    got = run(spark, rows, tmpdir_path)
    assert got == brute(rows) and len(got) == 8


def test_no_conversations(spark, tmpdir_path):
    assert run(spark, [], tmpdir_path) == []
    assert run(spark, [(None, 1, "user", "x")], tmpdir_path + "/none") == []


def test_totals_of_random_trees(spark):
    rng = random.Random(5)
    for shape in ("bushy", "chain", "star", "caterpillar", "forest"):
        par = {0: None}
        for i in range(1, 120):
            par[i] = {"bushy": rng.randrange(i), "chain": i - 1, "star": 0, "caterpillar": i - 1 if i % 2 else max(0, i - 2),
                      "forest": None if i % 30 == 0 else rng.randrange(max(0, i - 3), i)}[shape]
        own = {i: (rng.randrange(5), rng.randrange(100)) for i in par}
        want = {i: list(own[i]) for i in par}
        for i in sorted(par, reverse=True):
            if par[i] is not None:
                want[par[i]][0] += want[i][0]
                want[par[i]][1] += want[i][1]
        names = {i: rng.randrange(2**62) for i in par}  # ids tell nothing about the tree
        rows = [(names[i], None if par[i] is None else names[par[i]], *own[i]) for i in par]
        got = p.subtree_totals(spark.createDataFrame(rows, "id bigint, par bigint, a bigint, b bigint"))
        assert {r.id: [r.a, r.b] for r in got.collect()} == {names[i]: w for i, w in want.items()}
