"""Token alignment against whole-text encoding and plain counting."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from caselog.llm import alignment, perfect_hash
from caselog.llm.token_files import _BYTE_LETTERS
from tests.llm import cases

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "a", " lead", "trail ", "two  spaces", "a\tb", "a \n b", "a\n\nb\n", "\nstart", "x y", "z\x1c q", "▁ no", "a▁",
    "<|endoftext|> <s> </s> <unk> <0x41>", "it's don't, 'quoted'", "Été, çà! (naïve) 3.14 1,000", "日本語 テスト", "\U0001F600 ok \U0001F468‍\U0001F469", "x́ y",
    "end.\nNext line, here\nand \there", "ab,cd.ef", "\r\n crlf \r\n", "a\x00b c", "①②³ ½ ﬁ", "." * 50, "word " * 40, "é" * 30, "  \n  \n",
]


def plain(texts):
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    back = {chr(x).translate(_BYTE_LETTERS): x for x in range(256)}
    rows = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ta) != whole or b"".join(tb) != whole:
            ia = ib = ta = tb = []
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        links = []
        j = 0
        for i, end in enumerate(ea):
            begin = ea[i - 1] if i else 0
            while j and (eb[j - 1] > begin):
                j -= 1
            while j < len(eb) and eb[j] <= begin:
                j += 1
            while j < len(eb) and (eb[j - 1] if j else 0) < end:
                links.append((ia[i], ib[j]))
                j += 1
        groups, i, j = [], 0, 0
        after_a, after_b = ({end: k for k, end in enumerate(e, 1)} for e in (ea, eb))
        for end in sorted(set(ea) & set(eb)):
            i2, j2 = after_a[end], after_b[end]
            groups.append(",".join(map(str, ia[i:i2])) + "|" + ",".join(map(str, ib[j:j2])))
            i, j = i2, j2
        rows.append((len(ia), len(ib), groups, links))
    counts = collections.Counter(p for r in rows for p in set(r[3]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(n, best.get(x, 0))
    return [(n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for n_a, n_b, groups, links in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def random_texts(n):
    rng = random.Random(4)
    bits = ["word", "Été", ",", ".", "\n", " ", "  ", "\t", "x", "12", "'s", " ", "日", "(a)", "end.", "\U0001F600", "-", "_", "\r"]
    return ["".join(rng.choice(bits) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("at_once", [alignment.PAIRS_AT_ONCE, 300])
def test_alignment_equals_plain_python(spark, sf, at_once):
    texts = ODD + random_texts(300) + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += [" ".join(cases.words(110_000, 3, 5000)), *ODD]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    for name in ("n_a", "pair", "block", "text_hash", "groups"):
        docs = docs.withColumn(name, docs.text)
    got = alignment.align(docs, *PATHS, at_once=at_once).orderBy("doc_id").select("doc_id", *COLUMNS).collect()
    assert [tuple(r)[1:] for r in got] == plain(texts)


def test_null_ids_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "a b"), (5, "a b"), (5, None)], "doc_id long, text string")
    for at_once in (100, 1):
        got = sorted((tuple(r) for r in alignment.align(docs, *PATHS, at_once=at_once).collect()), key=str)
        one = plain(["a b"] * 4)[0]
        assert got == sorted([(i, *one) for i in (None, None, 5, 5)] + [(5, 0, 0, 0, 0, 0, 0, "")], key=str)
    assert alignment.align(docs.limit(0), *PATHS).count() == 0


def test_a_small_cache_changes_nothing(monkeypatch):
    texts = random_texts(200)
    want = alignment.Aligner(*PATHS, True).batch(texts)
    monkeypatch.setattr(alignment, "CACHE_PIECES", 20)
    code = alignment.Aligner(*PATHS, True)
    for i in range(0, 200, 7):
        some = code.batch(texts[i:i + 7])
        assert some.groups == want.groups[i:i + 7] and (some.n_links == want.n_links[i:i + 7]).all()


def test_perfect_hash(spark):
    keys = np.unique(np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 30_000))
    frame = spark.createDataFrame([(int(k),) for k in keys], "pair long").repartition(4)
    function = perfect_hash.build(frame, len(keys))
    at = function(keys)
    assert sorted(at) == list(range(len(keys))) and (function.keys[at] == keys).all()
    assert (function(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert len(function.bits) * 8 < 4 * len(keys)
    empty = perfect_hash.build(frame.limit(0), 0)
    assert (empty(keys) == -1).all() and len(empty) == 0
