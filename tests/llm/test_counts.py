"""Quality rules, classifier, licences, sharding, mixing and token files."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest

from caselog.llm import licenses, mixing, passages, quality, queries, sharding, token_files
from tests.llm import cases


def test_base_counts_equal_plain_counts():
    for text in cases.odd_texts():
        found = re.findall(cases.WS, text or "")
        lines = [x for x in (text or "").split("\n") if re.search(cases.WS, x)]
        got = quality.base_counts(text)
        assert got == (
            len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            cases.repeat_words(text))


def test_distance_is_the_root_of_the_jensen_shannon_divergence():
    assert quality.distance(np.array([3, 0]), np.array([0.0, 1.0])) == pytest.approx(1.0)
    assert quality.distance(np.array([2, 2]), np.array([0.5, 0.5])) == 0.0
    assert quality.distance(np.array([0, 0]), np.array([0.5, 0.5])) == 0.0
    p, q = np.array([0.25, 0.75]), np.array([0.5, 0.5])
    m = (p + q) / 2
    want = (sum(p * np.log2(p / m)) + sum(q * np.log2(q / m))) / 2
    assert quality.distance(np.array([1, 3]), q) == pytest.approx(want ** 0.5)


def test_references_count_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("lang", "text").collect()
    known = quality.references(docs)
    assert set(known) == {r["lang"] for r in rows}
    for lang, reference in known.items():
        counts, characters = collections.Counter(), np.zeros(quality.CLASSES)
        for r in rows:
            if r["lang"] == lang:
                counts.update(w.encode() for w in re.findall(cases.LETTERS, cases.ascii_lower(r["text"])))
                characters += quality.character_counts(r["text"].encode())
        common = {w: n / counts.total() for w, n in counts.items() if n >= quality.WORD_SHARE * counts.total()}
        assert common == pytest.approx({w: reference.words[i] for w, i in reference.numbers.items()})
        assert reference.characters == pytest.approx(characters / characters.sum())


def test_quality_of_odd_documents(spark):
    docs = cases.documents(spark, clash=True)
    got = {r["doc_id"]: r for r in quality.scored(docs).collect()}
    assert len(got) == len(cases.odd_texts())
    assert not got[7]["kept"] and got[7]["base_failed"] and got[7]["n_words"] == 0
    assert quality.keep(docs).columns == docs.columns
    assert {r["kept"] for r in quality.keep(docs).collect()} == {"clash"}
    assert quality.scored(cases.empty(spark)).count() == 0


def test_clean_documents_stay_and_junk_goes(spark, sf):
    clean = " ".join(cases.words(300, 1, 60)) + "."
    rows = [f"{clean} {' '.join(cases.words(50, i, 60))}. " for i in range(40)]
    junk = [" ".join(f"{w.upper()}!!" for w in cases.words(200, 77, 5000)), " ".join(f"{w} ###|" for w in cases.words(200, 78, 5000))]
    got = [r["kept"] for r in quality.scored(cases.documents(spark, rows + junk).replace("de", "en", "lang")).orderBy("doc_id").collect()]
    assert got == [True] * 40 + [False] * 2


def small_language(spark):
    """One big language, a small one with 0.4 % of all words, one with a single document."""
    def text(kind, i, n=60):
        return " ".join(f"{kind}{w}" for w in cases.words(n, i, 40)) + "."

    rows = [(i, text("big", i, 4000), "en") for i in range(220)] + [(1000 + i, text("ño", i, 90), "small") for i in range(40)]
    rows += [(2000, text("xx", 1, 80), "rare"), (2001, text("ño", 99, 90), None), (2002, text("qq", 3, 80), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("together", [500, 1])
def test_small_languages_have_references_and_rare_ones_the_base_rule(spark, monkeypatch, together):
    monkeypatch.setattr(quality, "TOGETHER", together)
    docs = small_language(spark)
    assert set(quality.references(docs)) == {"en", "small"}
    rows = quality.scored(docs).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: (r["reference"], r["kept"]) for r in rows}
    assert all(got[1000 + i] == ("small", True) for i in range(40)) and all(got[i] == ("en", True) for i in range(220))
    # a named language without a reference stays, what names none is compared with all
    assert got[2000] == (None, True) and got[2001] == ("small", True) and not got[2002][1]


def test_classifier_learns_and_keeps_its_hands_off_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = queries.op5_passage_classifier(spark, sf)
    rows = {r["doc_id"]: r for r in scores.collect()}
    assert len(rows) == docs.count()
    for doc, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    turned = labels.withColumn("quality", passages.F.when(passages.held_out(passages.F.col("doc_id")), 1 - labels["quality"]).otherwise(labels["quality"]))
    again = {r["doc_id"]: r["score"] for r in passages.scored(docs, passages.train(docs, turned)).collect()}
    assert again == {doc: r["score"] for doc, r in rows.items()}


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(400):
        bag = rng.normal(0, 1, (rng.integers(2, 8), 6)).astype(np.float32)
        bag[:, 0] = -2
        labels.append(float(i % 2))
        bag[rng.integers(len(bag)), 0] = 2 if i % 2 else -2
        bags.append(bag)
    model = passages.fit(bags, np.array(labels), epochs=20)
    sizes = np.array([len(b) for b in bags])
    starts = np.cumsum(sizes) - sizes
    f = passages._forward(model, np.concatenate(bags), starts)
    assert ((f["score"] > 0.5) == np.array(labels)).mean() > 0.97
    found = [f["weight"][s:s + n].argmax() == b[:, 0].argmax() for s, n, b, y in zip(starts, sizes, bags, labels, strict=True) if y]
    assert np.mean(found) > 0.9


def test_classifier_of_odd_documents(spark):
    labels = spark.createDataFrame([(7, 1), (10, 0), (13, None), (None, 1), (16, 1), (16, 0)], "doc_id long, quality int")
    docs = cases.documents(spark, clash=True)
    model = passages.train(docs, labels)
    assert passages.scored(docs, model).count() == docs.count()
    assert passages.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in passages.scored(docs, None).collect()} == {0.5}
    assert passages.scored(cases.empty(spark), model).count() == 0


def test_licences_by_brute_force(spark):
    notice = dict(licenses.TEMPLATES)["Apache-2.0"]
    mit = licenses.TEMPLATES[0][1]
    texts = [None, "", "no licence here", f"Intro text.\n{notice}\nmore text", mit.upper(), f"{mit[:300]}\n{mit[300:]}\n\nother " + "tail " * 3,
             "Released under the MIT License", "released under the", *cases.odd_texts()]
    known = licenses.templates()
    rows = licenses.scan(cases.documents(spark, texts, clash=True)).orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        want = set()
        for kind, number, part in licenses.parts(text or ""):
            own = set(licenses.bigrams(part).tolist())
            scores = sorted((-2 * len(own & set(b.tolist())) / (len(own) + len(b)), n) for n, b in zip(known.names, known.bigrams, strict=True)) if own else []
            if scores and -scores[0][0] >= licenses.LIMIT:
                want.add((scores[0][1], round(-scores[0][0], 9), kind, number))
        assert {(f["license"], round(f["dice"], 9), f["part"], f["number"]) for f in row["found"]} == want
    assert [r["licenses"] for r in rows[:8]] == [[], [], [], ["Apache-2.0"], ["MIT"], ["MIT"], ["MIT"], []]
    assert licenses.scan(cases.empty(spark)).count() == 0


GRANT = ("This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as "
         "published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version. This program is "
         "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
         "FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General "
         "Public License along with this program. If not, see <https://www.gnu.org/licenses/>.")
BSD = max((x for n, x in licenses.TEMPLATES if n == "BSD-2-Clause"), key=len)
THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
         "this software without specific prior written permission. THIS SOFTWARE IS")


@pytest.mark.parametrize(("text", "name"), [
    (BSD, "BSD-2-Clause"),
    (BSD.replace("THIS SOFTWARE IS", THIRD), "BSD-3-Clause"),
    (GRANT.format(":", "", ",", 3), "GPL-3.0"),
    (GRANT.format(";", "", ";", 2), "GPL-2.0"),
    (GRANT.format(":", "Affero ", ",", 3), "AGPL-3.0"),
    (GRANT.split(" This program is dis")[0].replace("This program", "This library").format(";", "Lesser ", ";", "2.1"), "LGPL-2.1"),
    (GRANT.split(" This program is dis")[0].replace("This program", "This library").format(";", "Lesser ", ";", "3"), "LGPL-3.0"),
    (GRANT.split(" This program is dis")[0].format(":", "", ",", 3), "GPL-3.0"),
    ("licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
])
def test_siblings_are_not_taken_for_each_other(text, name):
    assert {m[0] for m in licenses.matches(text, licenses.templates(), licenses.LIMIT)} == {name}


def test_full_texts_are_found_as_themselves():
    known = licenses.templates()
    for name, text in licenses.TEMPLATES:
        best = max(licenses.matches(text, known, licenses.LIMIT), key=lambda m: m[1])
        assert best[:2] == (name, pytest.approx(1.0))
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= {n for n, x in licenses.TEMPLATES if len(x) > 5000}


@pytest.mark.parametrize("where", ["start", "middle", "end"])
@pytest.mark.parametrize("name", ["MIT", "BSD-3-Clause", "GPL-2.0"])
def test_licence_of_several_paragraphs_inside_a_long_document(where, name):
    if name == "MIT":
        mit = licenses.TEMPLATES[0][1]
        cuts = [0, mit.index("The above"), mit.index("THE SOFTWARE IS PROVIDED"), len(mit)]
        body = "\n\n".join(mit[a:b].strip() for a, b in zip(cuts, cuts[1:]))
    elif name == "BSD-3-Clause":
        body = re.sub(r" (?=[123]\. |THIS SOFTWARE IS)", "\n\n", BSD.replace("THIS SOFTWARE IS", THIRD))
    else:
        body = GRANT.format(";", "", ";", 2).replace(". This program", ".\n\nThis program").replace(". You should", ".\n \nYou should")
    other = [" ".join(cases.words(70, i)) for i in range(12)]
    texts = {"start": [body, *other], "middle": [*other[:6], body, *other[6:]], "end": [*other, body]}[where]
    found = licenses.matches("\n\n".join(texts), licenses.templates(), licenses.LIMIT)
    number = {"start": 0, "middle": 6, "end": 12}[where]
    assert [(m[0], m[3]) for m in found if m[2] == "run"] == [(name, number)]
    assert {m[0] for m in found} == {name}


def test_runs_equal_a_search_of_all_runs():
    known = licenses.templates()
    body = licenses.TEMPLATES[0][1].replace(". ", ".\n\n")
    text = "\n\n".join(["a b c", body, "of the software", " ".join(cases.words(40)), "\n\n".join(GRANT.format(";", "Affero ", ";", 3).split(". "))])
    pieces, best = text.split("\n\n"), {}
    for i in range(len(pieces)):
        for j in range(i + 1, len(pieces)):
            own = set(licenses.bigrams("\n\n".join(pieces[i:j + 1])).tolist())
            dice, name = max((2 * len(own & set(b.tolist())) / (len(own) + len(b)), n) for n, b in zip(known.names, known.bigrams, strict=True))
            if dice >= licenses.LIMIT:
                best[name] = max(best.get(name, 0), dice)
    got = {m[0]: m[1] for m in licenses.matches(text, known, licenses.LIMIT) if m[2] == "run"}
    assert got == {n: pytest.approx(best[n]) for n in ("MIT", "AGPL-3.0")}


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        index = sharding.curve_index(grid, bits)
        assert sorted(index.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards_are_even_gapless_and_prune(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.document_shards(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    assert set(by) == set(range(24)) and len(rows) == len(texts)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for shard in by.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
        assert abs(sum(r["size"] for r in shard) - total / 24) <= largest
    spread = np.mean([max(r["doc_id"] for r in s) - min(r["doc_id"] for r in s) for s in by.values()])
    assert spread < 0.5 * len(rows)


def test_shards_of_odd_documents(spark, tmp_path):
    docs = cases.documents(spark, clash=True)
    rows = sharding.document_shards(docs.union(docs)).collect()
    assert len(rows) == 2 * len(cases.odd_texts())
    assert min(r["size"] for r in rows) == 8 and {r["text_crc32"] for r in rows if r["size"] == 8} == {0}
    sharding.write_shards(cases.documents(spark), str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(cases.odd_texts())
    assert sharding.document_shards(cases.empty(spark)).count() == 0


def targets(sizes: list[int], share: float = 1.5) -> list[float]:
    """Shares by weight; what exceeds twice a source is shared anew."""
    weight = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    out, full = [0.0] * len(sizes), set()
    while True:
        left = share * sum(sizes) - sum(2 * sizes[i] for i in full)
        total = sum(weight[i] for i in range(len(sizes)) if i not in full)
        out = [2.0 * s if i in full else left * weight[i] / total for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in full and out[i] > 2 * sizes[i]}
        if not over:
            return out
        full |= over


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mix(docs)
    rows = mixing.taken(mixed).collect()
    sizes = {r["doc_id"]: len(re.findall(cases.WS, r["text"])) for r in docs.collect()}
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    by_source = collections.Counter()
    for doc, n in sizes.items():
        by_source[sources[doc]] += n
    names = sorted(by_source)
    want = dict(zip(names, targets([by_source[n] for n in names]), strict=True))
    got = collections.Counter()
    for r in rows:
        source = sources[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], by_source[source]) and r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[source])
        got[source] += r["taken"]
    assert all(abs(got[n] - want[n]) <= 0.01 * want[n] for n in names)
    slots = mixed.rows.select("slot", "source_no").distinct().collect()
    first = collections.Counter(r["source_no"] for r in slots if r["slot"] < len(slots) // 10)
    for no, n in collections.Counter(r["source_no"] for r in slots).items():
        assert abs(first[no] - n / 10) <= 5  # spread evenly, also within a tenth of the mix
    assert {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.mix(docs)).collect()} == {r["doc_id"]: r["taken"] for r in rows}


def test_mix_of_odd_documents(spark):
    docs = cases.documents(spark, clash=True)
    rows = mixing.taken(mixing.mix(docs.union(docs))).collect()
    assert len(rows) == 2 * len(cases.odd_texts()) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.taken(mixing.mix(cases.empty(spark))).count() == 0
    assert {r["taken"] for r in mixing.taken(mixing.mix(cases.documents(spark, [None, "", " "]))).collect()} == {0}
    mixed = mixing.mix(docs)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(mixed).collect()}
    out = mixing.applied(docs, mixed)
    assert out.columns == docs.columns
    by_doc = collections.Counter()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        assert texts[r["doc_id"]].startswith(r["text"])
        by_doc[r["doc_id"]] += len(re.findall(cases.WS, r["text"]))
    assert {d: n for d, n in taken.items() if n} == dict(by_doc)


def plain_ids(texts: list[str | None]) -> list[list[int]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check_tokens(rows, texts) -> None:
    start = 0
    for row, ids in zip(sorted(rows, key=lambda r: r["start"]), plain_ids(texts), strict=True):
        want = np.array(ids, "<u4")
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(want.tobytes()))
        start += len(ids)


def test_token_files_equal_the_tokenizer(spark, tmp_path):
    docs = cases.documents(spark, clash=True)
    path = str(tmp_path / "tokens")
    check_tokens(token_files.digests(docs, queries.tokenizer_path(), path=path).collect(), cases.odd_texts())
    mapped = {(r["doc_id"], r["start"], bytes(r["ids"])) for r in token_files.read(spark, path, mapped=True).collect()}
    assert mapped == {(r["doc_id"], r["start"], bytes(r["ids"])) for r in token_files.read(spark, path, mapped=False).collect()}
    offsets = np.concatenate([np.memmap(f, "<i8", "r") for f in sorted((tmp_path / "tokens/offsets").glob("part-*")) if f.stat().st_size])
    assert offsets.tolist() == sorted(s for _, s, _ in mapped)
    files = sorted((tmp_path / "tokens/parts/kind=tokens").glob("part-*"))
    ids = np.concatenate([np.memmap(f, "<u2", "r") for f in files if f.stat().st_size])
    assert ids.tolist() == [i for x in plain_ids(cases.odd_texts()) for i in x]


def test_token_files_of_null_ids_repeats_and_nothing(spark):
    rows = [(None, "b c"), (3, "x"), (3, "x"), (-5, "long " * 9), (3, "y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = token_files.digests(docs, queries.tokenizer_path()).collect()
    check_tokens(got, ["b c", "long " * 9, "x", "x", "y z"])
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, -5, 3, 3, 3]
    assert token_files.digests(cases.empty(spark), queries.tokenizer_path()).count() == 0


def test_encoder_starts_anew_when_its_words_are_many(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 3)
    code = token_files.Encoder(queries.tokenizer_path())
    texts = cases.odd_texts()
    for text, want in zip(texts, plain_ids(texts), strict=True):
        assert [*code.batch([text])[0].tolist(), 1] == want
