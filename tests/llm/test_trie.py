"""The node table against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from commlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", "p") for r in rows], SCHEMA)


def plain(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            parts = [hashlib.sha256(str(len(p.encode())).encode() + b":" + p.encode()).hexdigest() for p in (role, text)]
            tie = hashlib.sha256("".join(parts).encode()).digest()
            talks.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    talks = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in talks.items()}
    rebuilt = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        template = c - int(np.fmod(c, 100))
        rebuilt[c] = tuple(talks.get(template, [])[:h] + own[h:])
    members = {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += p not in children
        saved[p] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if rebuilt[c] == p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, convs, texts, longest):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows


CASES = {
    "shared": talk(1, range(60), ["a", "b"], 9),
    "templates": talk(2, [*range(0, 30), *range(100, 130), *range(205, 220), -7, -100, -1, -150], ["x", "yy", "é🙂", None, ""], 8),
    "copies": [(c, t, "user", f"{t}") for c in range(300) for t in range(4)] + [(c, 4, "user", "end") for c in range(0, 300, 3)],
    "one long": [(5, t, "user", str(t % 7)) for t in range(700)] + [(c, t, "user", str(t % 7)) for c in (6, 7) for t in range(500)] + talk(3, range(20), ["0", "1"], 4),
    "ties": [(1, 0, "a", "z"), (1, 0, "a", "y"), (1, None, None, None), (1, None, None, None), (2, None, "", ""), (2, None, "u", "q")] * 2
    + [(None, 1, "user", "left out"), (100, 0, "u", "t"), (101, 0, "u", "t"), (102, 1, "u", None)],
    "one": [(3, 0, "u", "t")],
    "none": [],
}


@pytest.mark.parametrize("shard", [1 << 17, 150, 13])
@pytest.mark.parametrize("case", sorted(CASES))
def test_node_table(spark, case, shard):
    if shard == 13 and case not in ("one long", "ties"):
        pytest.skip("many parts are tried on two cases")
    rows = CASES[case]
    random.Random(4).shuffle(rows)
    shard = 60 if shard == 13 and case == "one long" else shard
    got = sorted(map(tuple, trie.node_table(frame(spark, rows).repartition(3), shard).collect()), key=str)
    assert got == plain(rows)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 1 << 63, (20_000, 4)).astype(np.uint64)
    table = trie.PerfectHash(digests)
    slots = table.slots(digests)
    assert sorted(slots) == list(range(len(digests))) and (table.digests[slots] == digests).all()
    # same hash inputs, other first number: only the comparison of whole digests tells them apart
    others = digests.copy()
    others[:, 0] ^= np.uint64(1)
    assert (table.slots(others) == -1).all()
