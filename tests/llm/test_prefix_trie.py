import hashlib
import zlib

import numpy as np
import pytest

from quillon.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, p string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """All nodes by dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members, ends = {}, {}
    for c, v in built.items():
        ends.setdefault(v, []).append(c)
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {k: 0 for k in members}
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(ends.get(k, []))) for k, m in members.items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def table():
    rnd, rows = np.random.default_rng(4), []
    for c in [*range(0, 40), 100, 103, 105, 106, 250, 251, *range(9000, 9030), -7]:
        for turn in range(int(rnd.integers(1, 9))):
            rows.append((c, turn, ["user", None, "assistant"][turn % 3], [None, "a", "bé😀", "", "long " * 9][int(rnd.integers(5))]))
    rows += [(c, t, "user", f"the same {t}") for c in range(20000, 20400) for t in range(3)]  # copies, many of one end
    rows += [(777, t, "user", f"deep {t}") for t in range(300)] + [(778, t, "user", f"deep {t}") for t in range(250)]
    return rows


@pytest.mark.parametrize("shard_rows", [1, 30, 100_000])
def test_every_node(spark, shard_rows):
    got = T.prefix_trie(frame(spark, table()), shard_rows)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect())) == brute(table())


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, "u", "first"), (1, 5, "u", "x"), (1, 5, "u", "x"), (2, None, None, None), (2, None, None, None), (None, 1, "u", "nobody"), (3, 0, "", ""), (100, 0, "u", "first")]
    assert sorted(map(tuple, T.prefix_trie(frame(spark, rows)).collect())) == brute(rows)


def test_a_tie_of_different_turns_has_one_order(spark):
    rows = [(1, 1, "u", t) for t in "abcdef"] + [(101, 1, "u", t) for t in "fedcba"]
    got = T.prefix_trie(frame(spark, rows)).collect()
    again = T.prefix_trie(frame(spark, rows[::-1])).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_empty_table(spark):
    assert T.prefix_trie(frame(spark, [])).collect() == []
    assert T.prefix_trie(frame(spark, [(None, 1, "u", "x")])).collect() == []


def test_turnless_conversations(spark):
    short = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 4)
    rows = [(short, 0, "u", "a"), (short, 1, "u", "b")]  # its own turns end before the fourth, and there is no conversation 0
    assert sorted(map(tuple, T.prefix_trie(frame(spark, rows)).collect())) == brute(rows) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_louds():
    parent = np.array([0, 0, 1, 1, 2, 3, 5])  # nodes 1..7
    louds = T.Louds.build(parent)
    assert "".join(map(str, louds.bits)) == "110" + "110" + "10" + "10" + "0" + "10" + "0" + "0"
    assert louds.parents().tolist() == parent.tolist()
    assert louds.degrees().tolist() == [2, 2, 1, 1, 0, 1, 0, 0]
    assert louds.levels() == [(1, 3), (3, 6), (6, 8)]
    assert T.rollup(louds, np.ones(7, np.int64))[0].tolist() == [4, 3, 2, 1, 2, 1, 1]
    again = T.Louds.unpack(louds.pack(), 7)
    assert again.bits.tolist() == louds.bits.tolist()
