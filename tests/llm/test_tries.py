"""The conversation trie against plain Python, and the centroid steps by themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from caselog.llm import tries
from tests.llm import cases

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{role}\0{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[-1] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def plain(convs):
    """All columns of all nodes, by walking every prefix of every conversation."""
    member, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            member.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    child = {}
    for k in member:
        if k:
            child.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(member, 0), dict.fromkeys(member, 0)
    for k in member:
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in child
            saved[k[:d]] += (len(member[k]) - 1) * len(k[-1][1].encode()) if k else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(member[k]), len(k), min(member[k[:-1]]) if k else None, len(member[k]), len(child.get(k, [])), leaves[k], saved[k],
                    digest(ends.get(k, []))) for k in member), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        for turn in range(rng.choice((1, 2, 3, 5, 8, 12))):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(("user", "assistant", None, "")), rng.choice(("a", "é", "", None, "bb"))))
    return rows


@pytest.mark.parametrize("small", [1 << 16, 40, 2])
def test_trie_equals_plain_python(spark, small):
    rows = random_rows(3)
    frame = spark.createDataFrame(rows, SCHEMA)
    turns = tries.turns(frame)
    assert got(tries.trie(*tries.spliced(turns), small=small)) == plain(rebuilt(rows))


def test_long_and_common_conversations(spark, monkeypatch):
    """A chain over several chunks, a third of all conversations equal, extra columns."""
    monkeypatch.setattr(tries, "CHUNK", 16)
    rows = [(500, i, "user", f"t{i}") for i in range(300)] + [(501, i, "user", f"t{i}") for i in range(250)]
    rows += [(c, i, "user", f"same {i}") for c in range(40) for i in range(3)]
    rows += [(10**6, 0, "user", "x" * 200_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("pos", "id", "up", "depth", "rows", "comp", "h1", "_tie", "_row_id", "len"):
        frame = frame.withColumn(name, frame.role)
    assert got(tries.trie(*tries.spliced(tries.turns(frame)), small=32)) == plain(rebuilt(rows))


def test_repeats_null_ids_and_nothing(spark):
    rows = [(None, 0, "user", "lost"), (3, 1, "user", "b"), (3, 1, "user", "b"), (3, None, None, None), (8, 0, "u", "only")]
    assert got(tries.trie(*tries.spliced(tries.turns(spark.createDataFrame(rows, SCHEMA))))) == plain(rebuilt(rows))
    assert tries.trie(*tries.spliced(tries.turns(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_centroid_sums_of_random_forests():
    rng = np.random.default_rng(1)
    for n, chain in ((1, 1.0), (200, 0.0), (400, 0.9), (3000, 1.0)):
        parent = np.array([-1] + [i - 1 if rng.random() < chain else int(rng.integers(0, i)) for i in range(1, n)])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        order = np.argsort(depth, kind="stable")
        place = np.empty(n, int)
        place[order] = np.arange(n)
        parent = np.where(parent[order] < 0, -1, place[parent[order]])
        depth = depth[order]
        weight, values = rng.integers(1, 5, n), rng.integers(0, 10, (2, n))
        want, rows = values.copy(), weight.copy()
        for i in range(n - 1, 0, -1):
            want[:, parent[i]] += want[:, i]
            rows[parent[i]] += rows[i]
        assert (tries.centroid_sums(parent, depth, rows, values) == want).all()


def test_clashing_columns_do_not_matter(spark, sf):
    frame = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in frame.collect()]
    for name in cases.CLASHES:
        frame = frame.withColumn(name, frame.role)
    assert got(tries.trie(*tries.spliced(tries.turns(frame)))) == plain(rebuilt(rows))
