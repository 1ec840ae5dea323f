"""Removal of repeated byte strings against comparing all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from caselog.llm import suffixes
from tests.llm import cases


def plain(rows, size):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of (doc_id, text) in order of doc_id."""
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        bad = [False] * len(raw)
        for i in range(len(raw) - size + 1):
            window = raw[i:i + size]
            if window in seen:
                bad[i:i + size] = [True] * size
            seen.add(window)
        kept = bytes(b for b, gone in zip(raw, bad, strict=True) if not gone)
        spans = sum(gone and not (i and bad[i - 1]) for i, gone in enumerate(bad))
        out.append((doc, len(raw), sum(bad), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def texts(seed, n=40):
    rng = random.Random(seed)
    common = [passage(rng, rng.randrange(8, 60)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(common) if rng.random() < 0.5 else passage(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 5))]
        text = rng.choice(("", " ", "\n")).join(parts)
        if rng.random() < 0.3 and text:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1:]
        out.append(text)
    return out


def got(df):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return [tuple(r) for r in df.select(*columns).orderBy("doc_id").collect()]


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_removal_equals_plain_python(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "SHARD", 3000)
    monkeypatch.setattr(suffixes, "BUCKET", 20_000)
    rows = [t for t in cases.odd_texts()] + texts(1) + ["ab" * 300, "ab" * 200 + "c", "a" * 500, "a" * 99, "a" * 100, "x" + "a" * 100]
    rows += [" ".join(cases.words(101_000, 5, 50_000)), " ".join(cases.words(30_000, 5, 50_000)[2000:])]
    docs = cases.documents(spark, rows, clash=True).repartition(6)
    ordered = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"] is not None)
    ordered = sorted(ordered + [(r["doc_id"], None) for r in docs.filter("text is null").collect()], key=lambda r: r[0])
    assert got(suffixes.cleaned(docs, hot=hot)) == plain(ordered, 100)


def test_null_ids_repeats_and_nothing(spark):
    long = passage(random.Random(2), 60)
    docs = spark.createDataFrame([(None, long), (4, long + "!"), (4, long + "!"), (9, "?" + long), (9, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.cleaned(docs).collect()), key=str)
    n = len(long.encode())
    assert rows == sorted([(4, n + 1, 0, 0), (4, n + 1, 0, 0), (9, n + 1, n, 1), (9, 0, 0, 0), (None, n, n, 1)], key=str)
    assert suffixes.cleaned(cases.empty(spark)).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.cleaned(docs).filter("n_bytes > 0").collect()}
    assert kept == {None: b"", 4: long.encode() + b"!", 9: b"?"}


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ordered = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert got(suffixes.cleaned(docs)) == plain(ordered, 100)


@pytest.mark.parametrize("size", [1, 5, 7, 8, 12, 100])
def test_merged_shards_equal_all_windows(size):
    rng = random.Random(size)
    strings = [bytes(rng.choice(b"ab") if size < 20 else rng.choice(b"abcdefgh") for _ in range(rng.randrange(0, 60) + size - 1)) for _ in range(40)]
    strings += [s[3:] + b"xyz" for s in strings[:10]] + [bytes([0, 255]) * size]
    documents, at = np.arange(len(strings)), np.zeros(len(strings), np.int64)
    for shard in (50, 700, 1 << 18):
        string, offset = suffixes.repeats(strings, documents, at, size, shard)
        seen, want = set(), set()
        for i, s in enumerate(strings):
            for j in range(len(s) - size + 1):
                want |= {(i, j)} if s[j:j + size] in seen else set()
                seen.add(s[j:j + size])
        assert set(zip(string.tolist(), offset.tolist(), strict=True)) == want


def test_stretches_cover_all_windows_and_depend_on_them_alone():
    rng = random.Random(7)
    base = passage(rng, 200).encode() + b"zz" * 150 + b"q" * 200
    raw = np.frombuffer(passage(rng, 30).encode() + base + base, np.uint8)
    begin, n, _ = suffixes.stretches(raw, 100, 32)
    assert begin[0] == 0 and (begin[1:] == (begin + n)[:-1]).all() and (begin + n)[-1] == len(raw) - 99 and n.max() <= 69
    inside = lambda at: {(b - at, k) for b, k in zip(begin.tolist(), n.tolist(), strict=True) if at <= b and b + k + 99 <= at + len(base)}
    first = len(raw) - 2 * len(base)
    assert len(inside(first) & inside(first + len(base))) > 0.9 * len(inside(first)) - 2


def test_no_candidate_is_lost():
    """Stretches of one anchor, cut down to what may repeat, give the same late windows."""
    rng = random.Random(11)
    anchor = passage(rng, 20).encode()[:32]
    lefts, rights = [passage(rng, 20).encode()[:60] for _ in range(4)], [passage(rng, 20).encode()[:60] for _ in range(4)]
    strings = []
    for _ in range(60):
        left, right = (bytearray(rng.choice(x)) for x in (lefts, rights))
        if rng.random() < 0.5:
            left[rng.randrange(60)] = 35
        if rng.random() < 0.5:
            right[rng.randrange(60)] = 35
        strings.append(bytes(left[rng.randrange(0, 20):]) + anchor + bytes(right[:rng.randrange(45, 60)]))
    strings = sorted(set(s for s in strings if len(s) >= 100))
    hash_ = suffixes.gram_hashes(np.frombuffer(anchor, np.uint8), 32).view(np.int64)
    numbers, zero = np.arange(len(strings)), np.zeros(len(strings), np.int64)
    want = set(zip(*(x.tolist() for x in suffixes.repeats(strings, numbers, zero, 100)), strict=True))
    string, begin, n = suffixes.candidates(strings, np.repeat(hash_, len(strings)), 100, 32)
    parts = [strings[i][b:b + k + 99] for i, b, k in zip(string.tolist(), begin.tolist(), n.tolist(), strict=True)]
    row, offset = suffixes.repeats(parts, string, begin, 100)
    assert want and set(zip(string[row].tolist(), (offset + begin[row]).tolist(), strict=True)) == want
    assert len(parts) < len(strings)
