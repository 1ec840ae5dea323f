"""Whole results of operators without SQL, worked out again in plain Python."""

from __future__ import annotations

import collections
import math
import re

from caselog.llm import passages, quality, queries, sharding
from tests.llm import cases

SMALL = "/root/testdata/sf0.01"


def hilbert(cells, bits):
    """Place on the curve of one point, by following the turns of each level (Skilling 2004)."""
    x, n = list(cells), len(cells)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def cut_cell(values, bits):
    """Cell of each value: values are cut where the rows split evenly; null is cell 0."""
    counts = collections.Counter(v for v in values if v is not None)
    total, before, cuts = sum(counts.values()), 0, {}
    for v in sorted(counts, key=lambda v: v.encode()):
        cuts.setdefault(math.floor((before + counts[v] / 2) * (1 << bits) / total), v)
        before += counts[v]
    found = sorted(cuts.values(), key=lambda v: v.encode())
    return [0 if v is None else sum(c.encode() <= v.encode() for c in found) for v in values]


def scaled_cell(values, bits):
    known = [v for v in values if v is not None]
    lo, hi = min(known), max(known)
    span = hi - lo if hi > lo else 1.0
    return [0 if v is None else min(max(math.floor((v - lo) / span * (1 << bits)), 0), (1 << bits) - 1) for v in values]


def test_shards_follow_the_curve_and_the_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    bits, top = 5, 31
    sizes = [len((r["text"] or "").encode()) for r in rows]
    dims = (cut_cell([r["source"] for r in rows], bits), cut_cell([r["lang"] for r in rows], bits),
            scaled_cell([float(r["doc_id"]) for r in rows], bits), scaled_cell([math.log2(n + 1.0) for n in sizes], bits))
    curve = {r["doc_id"]: hilbert([min(d[i], top) for d in dims], bits) for i, r in enumerate(rows)}
    got = sorted(sharding.document_shards(docs).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert sorted(curve) == sorted(r["doc_id"] for r in got)
    assert [curve[r["doc_id"]] for r in got] == sorted(curve.values())
    total, start = sum(sizes) + 8 * len(rows), 0
    for r in got:
        assert r["shard"] == min(23, math.floor((start + r["size"] / 2) * 24 / total))
        start += r["size"]


CLASSES = ("[\x80-\xff]", "[a-z]", "[A-Z]", "[0-9]", "[ \t\v\f\r]", "\n", r"[.,;:'\"()-]", r"[!#$%&*+/<=>?@\[\\\]^_`{|}~]", r"[\x00-\x08\x0e-\x1f\x7f]")


def plain_verdicts(rows):
    words = lambda text: re.findall(cases.LETTERS, cases.ascii_lower(text))
    classes = lambda text: [len(re.findall(c, (text or "").encode().decode("latin-1"))) for c in CLASSES]
    by_language = collections.defaultdict(lambda: (collections.Counter(), [0] * 9))
    for _, lang, text in rows:
        if lang is not None and text:
            by_language[lang][0].update(words(text))
            by_language[lang][1][:] = [a + b for a, b in zip(by_language[lang][1], classes(text), strict=True)]
    known = {}
    for lang, (counts, characters) in by_language.items():
        if counts.total() >= quality.REFERENCE_WORDS:
            common = {w: n / counts.total() for w, n in counts.items() if n >= quality.WORD_SHARE * counts.total()}
            known[lang] = (common, 1 - sum(common.values()), [n / sum(characters) for n in characters])

    def distance(p, q):
        if not sum(p):
            return 0.0
        p = [x / sum(p) for x in p]
        kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
        m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
        return math.sqrt(min(max((kl(p, m) + kl(q, m)) / 2, 0.0), 1.0))

    out = {}
    for doc, lang, text in rows:
        found, raw = words(text), (text or "").encode()
        tokens = re.findall(cases.WS, text or "")
        failed = len(tokens) < 20 or 100 * cases.repeat_words(text) > 30 * len(tokens)
        best = None
        for name in known if lang is None else [lang] if lang in known else []:
            common, rest, characters = known[name]
            counts = collections.Counter(w if w in common else None for w in found)
            by_class = distance(classes(text), characters) if len(raw) >= quality.MIN_CHARACTERS else 0.0
            by_word = distance([counts[w] for w in common] + [counts[None]], [*common.values(), rest]) if len(found) >= quality.MIN_WORDS else 0.0
            if best is None or by_class + by_word < sum(best):
                best = by_class, by_word
        by_class, by_word = best or (0.0, 0.0)
        near = (by_class <= quality.CHARACTER_LIMIT + quality.CHANCE / math.sqrt(max(len(raw), 1))
                and by_word <= quality.WORD_LIMIT + quality.CHANCE / math.sqrt(max(len(found), 1)))
        out[doc] = (failed, near and not failed, round(by_class, 9), round(by_word, 9))
    return out


def test_verdicts_of_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain_verdicts([(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["base_failed"], r["kept"], round(r["character_distance"], 9), round(r["word_distance"], 9))
           for r in quality.scored(docs).collect()}
    assert got == want
    assert 0 < sum(kept for _, kept, _, _ in got.values()) < len(got)


def test_held_out_scores_rank_the_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r["quality"] is not None}
    held = [r for r in queries.op5_passage_classifier(spark, SMALL).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == y] for y in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert len(held) > 50 and auc > 0.97
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) > 0.9 * len(held)
    assert passages.FIT_DOCUMENTS >= len(labels)
