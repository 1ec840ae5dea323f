"""Jaccard join, decontamination, sentence spans, quotation linking and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caselog.llm import components, decontaminate, jaccard, mixing, quality, queries, quotes, spans
from tests.llm import cases


def edited(base: list[str], edits: int, rng: random.Random) -> str:
    words = base[:]
    for _ in range(edits):
        at = rng.randrange(len(words))
        if rng.random() < 0.5:
            words[at] = f"x{rng.randrange(10**6)}"
        else:
            del words[at]
    return " ".join(words)


def near_texts(seed: int, count: int = 220) -> list[str]:
    """Texts of 1 to 200 words in families around the limit, some within families of families."""
    rng = random.Random(seed)
    out = []
    while len(out) < count:
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice((1, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20, 40, 80, 200)))]
        for _ in range(rng.randrange(1, 7)):
            out.append(edited(base, rng.randrange(0, 1 + len(base) // 18 + rng.randrange(2)), rng) if len(base) > 2 else " ".join(base))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    texts = near_texts(seed) + cases.odd_texts()
    docs = cases.documents(spark, texts, clash=True)
    want = cases.components([(r["doc_id"], r["text"]) for r in docs.collect()])
    rows = jaccard.groups(docs).orderBy("doc_id").collect()
    assert [r["component_id"] for r in rows] == want
    assert [r["n_shingles"] for r in rows] == [len(cases.shingles(t)) for t in texts]


@pytest.mark.parametrize("spare", [True, False])
def test_pigeonhole_on_random_sets(monkeypatch, spare):
    """Every similar pair of sets shares a key with which the smaller probes, also where
    subsets are so few that neighbourhoods and empty segments have to be bought."""
    if not spare:
        monkeypatch.setattr(jaccard, "n_segments", lambda band: (2 << band) // 4 + 1)
    rng = np.random.default_rng(3)
    bought = collections.Counter()
    for _ in range(4000):
        n = int(rng.choice((4, 5, 6, 8, 10, 15, 16, 31, 33, 64, 100)))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop, add = rng.integers(0, n // 8 + 2), rng.integers(0, n // 8 + 2)
        y = np.unique(np.concatenate((rng.permutation(x)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64))))
        if len(y) < len(x):
            x, y = y, x
        both = len(np.intersect1d(x, y))
        if not jaccard.linked(len(x), len(y), len(x) + len(y) - 2 * both) or len(x) == both == len(y):
            continue
        asked = {}
        for band, segment, kind in jaccard.profile(x)[1]:
            asked.setdefault(band, {jaccard.DELETED: set(), jaccard.VOID: set()})[kind].add(segment)
            bought[kind] += 1
        (kx, hold), (ky, _) = jaccard.signatures(x, asked), jaccard.signatures(y, asked)
        found = np.isin(kx, ky)
        if (hold == jaccard.FORCED).any():
            assert found[hold == jaccard.FORCED].any()
        else:  # so many agree that any |X| // 4 + 1 of them hold one
            own = hold == jaccard.OWN
            assert own.sum() == jaccard.profile(x)[0] > len(x) // 4 and found[own].sum() >= own.sum() - len(x) // 4
    assert spare or bought[jaccard.DELETED] > 10


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 4, 63, 64, 65, 500):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate((x[n // 10:], rng.integers(0, 1 << 63, n // 7 + 1).astype(np.uint64)))
        a, b = (np.frombuffer(jaccard.sketch(np.unique(s)), np.uint8) for s in (x, y))
        size = min(len(a), len(b))
        differing = len(np.setxor1d(x, y))
        assert np.bitwise_count(jaccard.folded(a, size) ^ jaccard.folded(b, size)).sum() <= differing


def test_a_large_group_of_near_copies_and_its_strays(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    texts = [edited(base, rng.randrange(0, 4), rng) for _ in range(150)] + [edited(base, 12, rng) for _ in range(40)] + [" ".join(base)] * 60
    docs = cases.documents(spark, texts)
    want = cases.components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert [r["component_id"] for r in jaccard.groups(docs).orderBy("doc_id").collect()] == want
    kept = jaccard.deduplicate(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns


def test_blocks_and_components_of_any_size(spark, monkeypatch):
    """Blocks of three: components larger than a block, and shared blocks of small ones."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    docs = cases.documents(spark, near_texts(5, 90))
    want = cases.components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert [r["component_id"] for r in jaccard.groups(docs).orderBy("doc_id").collect()] == want


def test_join_of_null_ids_repeats_and_nothing(spark):
    text = " ".join(cases.words(30))
    rows = [(None, text), (9, text + " more"), (9, text + " more"), (None, "alone here"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard.groups(docs).collect()), key=str)
    assert got == sorted([(None, 9, 26), (9, 9, 27), (9, 9, 27), (None, None, 1), (4, 4, 0), (4, 4, 0)], key=str)
    assert {r["doc_id"] for r in jaccard.deduplicate(docs).collect()} == {9, None, 4}
    assert jaccard.deduplicate(docs).count() == 3
    assert jaccard.groups(cases.empty(spark)).count() == 0


def test_star_contraction(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (200, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long"), "t").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100}


ITEMS = [
    (1, " ".join(cases.words(30, 3))), (10, "Only Four words, here!"), (2, " ".join(cases.words(40, 4))), (3, None), (4, "  ?? "),
    (5, " ".join(cases.words(30, 3)[5:])), (6, "solo"), (6, " ".join(cases.words(14, 8))), (7, " ".join(cases.words(13, 11))),
]


def contaminated_texts() -> list[str | None]:
    a, b = cases.words(30, 3), cases.words(40, 4)
    return [
        *cases.odd_texts(), " ".join(a[:13]), " ".join(a[:12]), " ".join([*cases.words(60, 21), *a[4:22], *cases.words(60, 22)]),
        "ONLY four-words (here", " ".join(b * 3), " ".join([*b[:20], "gap", *b[20:]]), "Solo solo! x " * 5, " ".join(a[:20] + a[7:30]),
        " ".join(cases.words(13, 11)), " ".join(cases.words(400, 33) + cases.words(13, 11)),
    ]


def test_contamination_equals_plain_search(spark):
    texts = contaminated_texts()
    docs = cases.documents(spark, texts, clash=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit("clash"))
    rows = decontaminate.report(decontaminate.find(docs, items)).orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        n, hit, ids = cases.benchmark_hits(text, ITEMS)
        assert (row["n_words"], row["n_hit"], row["n_items"]) == (n, hit, len(ids))
        assert row["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert row["contaminated"] == (hit > 0 and 20 * hit >= n)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if not r["contaminated"]}


def test_contamination_of_repeats_and_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    text = ITEMS[0][1]
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (1, "else")], "doc_id long, text string")
    rows = decontaminate.report(decontaminate.find(docs, items)).collect()
    assert sorted((r["n_hit"], r["n_items"]) for r in rows) == [(0, 0), (30, 2), (30, 2), (30, 2)]
    assert [r["text"] for r in decontaminate.clean(docs, items).collect()] == ["else"]
    assert decontaminate.report(decontaminate.find(cases.empty(spark), items)).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(decontaminate.find(docs, items.limit(0))).collect())


def plain_spans(rows: list[tuple[int, str | None]]) -> list[str | None]:
    """The texts without the sentences of any span but the first, by a dictionary."""
    first, gone = {}, collections.defaultdict(set)
    for doc, text in sorted(rows, key=lambda r: r[0]):
        found = spans.sentences(text)
        n = len(found)
        short = n < 2 or sum(s[3] for s in found) < 12
        for i in range(n):
            end = n if short else next((e for e in range(i + 2, n + 1) if sum(s[3] for s in found[i:e]) >= 12), None)
            alone = [i + 1] if not short and found[i][3] >= spans.LONG else []
            for stop in alone + ([end] if end and not (short and i) else []):
                key = tuple(s[2] for s in found[i:stop])
                if first.setdefault(key, (doc, i)) != (doc, i):
                    gone[doc] |= set(range(i, stop))
    out = []
    for doc, text in rows:
        found = spans.sentences(text)
        drop = [(b, e) for i, (b, e, _, _) in enumerate(found) if i in gone[doc]]
        out.append(text if text is None else "".join(c for i, c in enumerate(text) if not any(b <= i < e for b, e in drop)))
    return out


@pytest.mark.parametrize("long_sentences", [0, 6])
def test_spans_equal_a_plain_search(spark, long_sentences):
    rng = random.Random(4)
    pool = [" ".join(f"s{rng.randrange(500)}" for _ in range(rng.randrange(1, 11))).capitalize() + rng.choice((".", "!", "?")) for _ in range(400)]
    pool += [" ".join(f"l{rng.randrange(9000)}" for _ in range(n)) + "." for n in (24, 25, 26, 60, 70)] * long_sentences
    shared = [pool[i:i + 7] for i in range(0, 70, 7)]
    texts: list[str | None] = list(cases.odd_texts())
    for i in range(80):
        body = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        if i % 3 == 0:
            body[len(body) // 2:len(body) // 2] = rng.choice(shared)
        texts.append("".join(s + rng.choice((" ", "\n", "  ")) for s in body))
    texts += texts[-5:]
    docs = cases.documents(spark, texts, clash=True)
    rows = spans.cleaned(docs).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == plain_spans([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])
    for r, text in zip(rows, texts, strict=True):
        assert r["n_sentences"] == len(spans.sentences(text))
        assert sum(x["end"] - x["begin"] for x in r["removed"]) == len(text or "") - len(r["text"] or "")
    if not long_sentences:  # a short end behind a span that needs no more words is in no span
        assert [r["n_removed"] for r in rows[-5:]] == [r["n_sentences"] for r in rows[-5:]]


def test_spans_of_repeats_and_nothing(spark):
    passage = "A sentence of a few words. And then another one that makes the passage long enough. "
    docs = spark.createDataFrame([(1, passage), (1, passage), (None, passage + "Own end."), (2, "Short.")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in spans.cleaned(docs).collect())
    assert got == [("1", passage), ("1", passage), ("2", "Short."), ("None", "Own end.")]
    assert spans.cleaned(cases.empty(spark)).count() == 0


def test_a_long_sentence_repeats_between_other_neighbours(spark):
    long = " ".join(f"d{i}" for i in range(60)).capitalize() + "."
    least = " ".join(f"e{i}" for i in range(spans.LONG)) + "."
    less = " ".join(f"f{i}" for i in range(spans.LONG - 1)) + "."
    rows = [(i, f"Own start number {i} of it.\n{long}\nOwn end number {i} of it.") for i in range(1, 5)]
    rows += [(5, long), (6, long.upper()), (7, f"Begins seven. {long}"), (8, f"{long} Tail here. Ends eight."), (9, f"{long} Tail here. Ends nine.")]
    rows += [(10, f"Ten. {least} And ten."), (11, f"Eleven. {least} And eleven."), (12, f"Twelve. {less} And twelve."), (13, f"Thirteen. {less} And thirteen.")]
    got = {r["doc_id"]: r["text"] for r in spans.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and all(got[i] == f"Own start number {i} of it.\nOwn end number {i} of it." for i in range(2, 5))
    # the short sentence behind it still goes with the span of two
    assert [got[i] for i in range(5, 10)] == ["", "", "Begins seven. ", "Tail here. Ends eight.", "Ends nine."]
    assert got[10] == rows[9][1] and got[11] == "Eleven. And eleven." and (got[12], got[13]) == (rows[11][1], rows[12][1])


MESSAGES = [
    (1, 0, "user", "How do I sort a list?\n\nIt is long and I am new here."),
    (1, 1, "assistant", "On Monday Ann wrote:\n> How do I sort a list?\n\nUse sorted on the list you have."),
    (1, 2, "user", "> > How do I sort a list?\n> Use sorted on the list  you have.\nThanks, that works for me."),
    (1, 3, "user", "> It is long and I am new here.\nWelcome to the place then."),
    (2, 0, "user", "> Use SORTED on the list you have.\nIs that stable or not?"),
    (2, 1, "assistant", "Yes it is stable, always."),
    (3, 0, "user", None), (3, 1, "user", ""), (3, 1, "user", "> never said anywhere at all\nok"),
    (4, 0, "user", "> Yes it is stable, always.\nGood to know that."),
    (None, 0, "user", "No conversation number here."),
]


def test_quotes_link_messages_and_conversations(spark):
    messages = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash"))
    rows = quotes.conversations(messages).orderBy("thread", "position").collect()
    assert len(rows) == len(MESSAGES)
    by = {(r["conv_id"], r["turn"]): r for r in rows if r["conv_id"] != 3}
    link = {k: (r["reply_conv"], r["reply_turn"]) for k, r in by.items() if r["reply_turn"] is not None}
    assert link == {(1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 0), (2, 0): (1, 1), (4, 0): (2, 1)}
    assert by[1, 1]["text"] == "Use sorted on the list you have." and by[1, 2]["text"] == "Thanks, that works for me."
    assert by[1, 2]["n_quotes"] == 2
    assert len({by[k]["thread"] for k in ((1, 0), (2, 1), (4, 0))}) == 1
    assert [by[k]["depth"] for k in ((1, 0), (2, 0), (4, 0))] == [0, 1, 2]
    place = {k: r["position"] for k, r in by.items()}
    assert all(place[k] > place[p] for k, p in link.items())
    per = collections.defaultdict(list)
    for r in rows:
        per[r["thread"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in per.values())
    assert {r["text"] for r in rows if r["conv_id"] == 3} == {None, "", "ok"}
    assert quotes.conversations(messages.limit(0)).count() == 0


def test_partial_rewrapped_and_short_quotes_link(spark):
    long = "The first point is about cost. The second point is about the time it takes to do it. Is there a third?"
    rows = [
        (1, 0, long), (1, 1, "Yes."), (1, 2, "> Yes.\nGood."), (1, 3, "> The second point is about\n> the time it takes to do it.\nFair."),
        (1, 4, "> > The first point is about cost. The second point\n> > is about the time it takes to do it.\nBoth."),
        (2, 0, "> Yes.\nOther talk here."), (2, 1, "OK\nIt is a plan."), (2, 2, "> ok\nFine."),
        (3, 0, "> The first point is about cost.\nFrom elsewhere."), (3, 1, "> Yes.\n> and words that nobody wrote\nHm."),
        (None, 0, "No way."), (None, 1, "> No way.\nWay.")]
    messages = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"]) for r in quotes.conversations(messages).collect() if r["reply_turn"] is not None}
    assert got == {(1, 2): (1, 1), (1, 3): (1, 0), (1, 4): (1, 0), (2, 2): (2, 1), (3, 0): (1, 0), (None, 1): (None, 0)}


def test_conversations_without_quotes_keep_their_turns(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = queries.op2_quotation_linking(spark, sf).collect()
    want = {(r["conv_id"], r["turn"]): r["text"] for r in given.collect()}
    assert {(r["conv_id"], r["turn"]): r["text"] for r in rows} == want
    per = collections.defaultdict(list)
    for r in rows:
        per[r["conv_id"]].append((r["position"], r["turn"]))
    assert all([t for _, t in sorted(p)] == sorted(t for _, t in p) for p in per.values())


def test_levels_and_own_words():
    text = "Hello all\n> one\n>> two\n> > two again\n>three\nbye"
    assert quotes.levels(text) == [(0, "Hello all"), (1, "one"), (2, "two\ntwo again"), (1, "three"), (0, "bye")]
    assert quotes.own_words(text) == "Hello all\n\nbye"
    assert quotes.own_words("a > b\n 1 < 2") == "a > b\n 1 < 2"


def test_pipeline_equals_its_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token files"]
    known = quality.references(docs)
    rows = [r for r in docs.orderBy("doc_id").collect()]
    good = []
    for r in rows:
        base = quality.base_counts(r["text"])
        if not base.failed and quality.divergence(r["text"], r["lang"], known)[3]:
            good.append(r)
    assert 0.6 * len(rows) < len(good) < len(rows)
    label = cases.components([(r["doc_id"], r["text"]) for r in good])
    good = [r for r, c in zip(good, label, strict=True) if r["doc_id"] == c]
    grams = {tuple(w[i:i + min(13, len(w))]) for _, t in items for w in [re.findall(cases.LETTERS, cases.ascii_lower(t))] for i in range(max(1, len(w) - 12))}

    def clean(text):
        w = re.findall(cases.LETTERS, cases.ascii_lower(text))
        hit = {i + j for n in {len(g) for g in grams} for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in grams for j in range(n)}
        return not hit or 20 * len(hit) < len(w)

    good = [r for r in good if clean(r["text"])]
    left = spark.createDataFrame(good, docs.schema)
    passes = mixing.applied(left, mixing.mix(left)).orderBy("doc_id").collect()
    got = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r["start"])
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r["doc_id"] for r in passes)
    from tests.llm.test_counts import plain_ids

    sizes = collections.Counter((r["doc_id"], len(ids)) for r, ids in zip(passes, plain_ids([r["text"] for r in passes]), strict=True))
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == sizes
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
