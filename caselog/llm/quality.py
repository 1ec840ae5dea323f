"""Quality rules: base counts, then divergence from language references.

References are made from the corpus itself, one per language that holds at least
``REFERENCE_WORDS`` words, whatever its share: how its characters spread over classes and how
often each of its common words occurs (a common word has a share of at least ``WORD_SHARE``
of the language's words). A document is compared with the reference of its language. One that
names no language is compared with all references, of which the nearest counts; one whose
language has no reference is left to the base rule. The measure is the Jensen-Shannon
distance (the root of the divergence to base 2, from 0 to 1). Short documents aren't judged,
as their histograms are noise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.llm.common import in_workers, partitions, sliced, stored
from caselog.llm.decontaminate import words as letter_words

#: Words from which a language's histograms are stable: references of this many words of
#: sf0.1 (six draws each of en and es) rejected no document labelled good.
REFERENCE_WORDS, WORD_SHARE = 2000, 0.004
#: Languages whose references are made, held and broadcast at a time.
TOGETHER = 500
MIN_CHARACTERS, MIN_WORDS = 200, 50
#: A distance may reach its limit plus what chance adds to a histogram of so few counts.
CHARACTER_LIMIT, WORD_LIMIT, CHANCE = 0.24, 0.19, 1.5

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
CLASSES = 9


def _class_of(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        return 0  # bytes of letters beyond ASCII, mostly
    if c.islower():
        return 1
    if c.isupper():
        return 2
    if c.isdigit():
        return 3
    if c in " \t\v\f\r":
        return 4
    if c == "\n":
        return 5
    return 6 if c in ".,;:'\"-()" else 7 if b > 0x20 and b < 0x7F else 8


CLASS = np.array([_class_of(b) for b in range(256)], np.int64)


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


def base_counts(text: str | None) -> Base:
    """The counts of one whole text; a null text has none of anything."""
    text = text or ""
    raw = text.encode()
    found = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return Base(
        len(found), len(text) - (len(raw) - len(raw.translate(None, SPACES))),
        len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeated(found))


def _repeated(found: list[bytes]) -> int:
    """Words that lie in an eight-word window which occurs at least twice."""
    n = len(found) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
    if len(numbers) == len(found):
        return 0
    # equal pairs, then fours, then eights get the same number: exact, without hashing
    size = 1
    while size < WINDOW:
        joined = at[:len(at) - size] * (int(at.max()) + 1) + at[size:]
        size *= 2
        kinds, at = np.unique(joined, return_inverse=True)
        if len(kinds) == len(joined):
            return 0
    again = np.bincount(at)[at] > 1
    steps = np.zeros(len(found) + 1, np.int64)
    steps[:n] += again
    steps[WINDOW:WINDOW + n] -= again
    return int((np.cumsum(steps) > 0).sum())


class Reference(NamedTuple):
    characters: np.ndarray
    """Shares of the character classes."""
    numbers: dict[bytes, int]
    """The common words, numbered."""
    words: np.ndarray
    """Their shares, then the share of all other words."""


def distance(counts: np.ndarray, shares: np.ndarray) -> float:
    """Jensen-Shannon distance between counts and shares; 0 without counts."""
    total = counts.sum()
    if not total:
        return 0.0
    p = counts / total
    middle = (p + shares) / 2
    both = sum((x[x > 0] * np.log2(x[x > 0] / middle[x > 0])).sum() for x in (p, shares)) / 2
    return float(np.sqrt(min(max(both, 0.0), 1.0)))


def word_counts(found: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    other = len(numbers)
    return np.bincount(np.fromiter((numbers.get(w, other) for w in found), np.int64, len(found)), minlength=other + 1)


def character_counts(raw: bytes) -> np.ndarray:
    return np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES)


def _gather(docs: DataFrame, per_batch, schema: str) -> DataFrame:
    """Rows of ``per_batch(language, texts)``, if any, for the languages of every batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            by_language: dict[str, list[str]] = {}
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if language is not None and text:
                    by_language.setdefault(language, []).append(text)
            for language, texts in by_language.items():
                columns = per_batch(language, texts)
                if columns is None:
                    continue
                columns["lang"] = [language] * len(next(iter(columns.values())))
                yield pa.record_batch({name: pa.array(columns[name]) for name in columns})

    return in_workers(docs).select("lang", "text").mapInArrow(run, schema)


def _reported(docs: DataFrame) -> DataFrame:
    """lang, word, n: every language's total, as the empty word, and words that may be common.

    Every batch of texts reports the words with a quarter of the share asked for, and its
    totals; a word that reaches the share in the whole language was reported for at least
    three quarters of it, so at most ``4 / (3 * WORD_SHARE)`` words of a language remain.
    """

    def reported(_: str, texts: list[str]) -> dict[str, list]:
        counts: Counter[bytes] = Counter()
        for text in texts:
            counts.update(letter_words(text))
        total = counts.total()
        often = [(w.decode(errors="replace"), n) for w, n in counts.items() if 4 * n >= WORD_SHARE * total]
        # the total rides along as the empty word, which no text contains
        return {"word": ["", *(w for w, _ in often)], "n": [total, *(n for _, n in often)]}

    sums = _gather(docs, reported, "word string, n long, lang string").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return stored(sums, "reported-words")


def _totals(sums: DataFrame) -> DataFrame:
    return sums.filter("word = ''").filter(F.col("n") >= REFERENCE_WORDS).select("lang", F.col("n").alias("total"))


def _between(column: str, first: str | None, after: str | None) -> Column:
    out = F.col(column).isNotNull()
    out = out if first is None else out & (F.col(column) >= F.lit(first))
    return out if after is None else out & (F.col(column) < F.lit(after))


def _ranges(sums: DataFrame) -> list[tuple[str | None, str | None]]:
    """Ranges of language names, from one up to before the next, that hold all names and at
    most ``TOGETHER`` languages with a reference each. Only the cuts reach the driver."""
    order = _totals(sums).select("lang").repartitionByRange(partitions(sums.sparkSession), "lang").sortWithinPartitions("lang")
    cuts = [r["lang"] for i, r in enumerate(order.toLocalIterator()) if i and i % TOGETHER == 0]
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def references(docs: DataFrame) -> dict[str, Reference]:
    """References of all languages, from all documents that name their language."""
    sums = _reported(docs)
    out: dict[str, Reference] = {}
    for first, after in _ranges(sums):
        out |= _references(docs, sums, first, after)
    return out


def _references(docs: DataFrame, sums: DataFrame, first: str | None, after: str | None) -> dict[str, Reference]:
    """References of the languages of one range of names, by exact counts of the reported
    words. What reaches the driver is bounded by ``TOGETHER`` languages with
    ``4 / (3 * WORD_SHARE)`` words, whatever the size of the corpus."""
    sums, docs = sums.filter(_between("lang", first, after)), docs.filter(_between("lang", first, after))
    rows = sums.join(_totals(sums), "lang").filter(F.col("n") >= 0.75 * WORD_SHARE * F.col("total")).collect()
    candidates: dict[str, dict[bytes, int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["word"])):
        numbers = candidates.setdefault(r["lang"], {})
        if r["word"]:
            numbers[r["word"].encode()] = len(numbers)
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def counted(language: str, texts: list[str]) -> dict[str, list] | None:
        numbers = shared.value.get(language)
        if numbers is None:
            return None
        counts = np.zeros(CLASSES + len(numbers) + 1, np.int64)
        for text in texts:
            counts[:CLASSES] += character_counts(text.encode())
            counts[CLASSES:] += word_counts(letter_words(text), numbers)
        return {"counts": pa.array([counts], pa.list_(pa.int64()))}

    exact = _gather(docs, counted, "counts array<long>, lang string").select("lang", F.posexplode("counts").alias("at", "n"))
    found = {lang: np.zeros(CLASSES + len(numbers) + 1) for lang, numbers in candidates.items()}
    for r in exact.groupBy("lang", "at").agg(F.sum("n").alias("n")).collect():
        found[r["lang"]][r["at"]] = r["n"]
    out = {}
    for lang, numbers in candidates.items():
        characters, counts = found[lang][:CLASSES], found[lang][CLASSES:]
        total = counts.sum()
        common = [(w, i) for w, i in numbers.items() if counts[i] >= WORD_SHARE * total]
        shares = np.array([counts[i] for _, i in common] + [0.0]) / max(total, 1)
        shares[-1] = 1 - shares.sum()
        out[lang] = Reference(characters / max(characters.sum(), 1), {w: k for k, (w, _) in enumerate(common)}, shares)
    return out


def divergence(text: str | None, language: str | None, known: dict[str, Reference]) -> tuple[str | None, float, float, bool]:
    """The reference taken, both distances, and whether they keep the document. A named
    language without a reference takes none and keeps it."""
    raw, found = (text or "").encode(), letter_words(text)
    best: tuple[str | None, float, float, bool] = (None, 0.0, 0.0, True)
    most_by_class = CHARACTER_LIMIT + CHANCE / max(len(raw), 1) ** 0.5
    most_by_word = WORD_LIMIT + CHANCE / max(len(found), 1) ** 0.5
    characters = character_counts(raw)
    for name in known if language is None else [language] if language in known else []:
        reference = known[name]
        by_class = distance(characters, reference.characters) if len(raw) >= MIN_CHARACTERS else 0.0
        by_word = distance(word_counts(found, reference.numbers), reference.words) if len(found) >= MIN_WORDS else 0.0
        if best[0] is None or by_class + by_word < best[1] + best[2]:
            best = (name, by_class, by_word, by_class <= most_by_class and by_word <= most_by_word)
    return best


SCORES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "reference": pa.string(),
    "character_distance": pa.float64(), "word_distance": pa.float64(),
}
_TYPES = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}


def scored(docs: DataFrame, known: dict[str, Reference] | None = None, prefix: str = "") -> DataFrame:
    """All rows and columns with the base counts, distances and the verdict ``kept``.

    The added names begin with ``prefix``; columns of the input of such a name give way. Null and empty texts
    fail the base rule. A document shorter than both minimum lengths or of a language without
    a reference, or a corpus in which no language has one, leaves the verdict to the base
    rule. Rows that repeat are scored alike.
    """
    docs = in_workers(docs).drop(*(prefix + name for name in SCORES))
    if known is not None:
        return _scored(docs, known, prefix)
    sums = _reported(docs)
    ranges = _ranges(sums)
    if len(ranges) == 1:
        return _scored(docs, _references(docs, sums, None, None), prefix)
    named, unnamed = [], docs.filter("lang is null")
    for i, (first, after) in enumerate(ranges):
        some = _references(docs, sums, first, after)
        named.append(_scored(docs.filter(_between("lang", first, after)), some, prefix))
        # what names no language takes the nearest of all ranges
        unnamed = _scored(unnamed, some, prefix, again=i > 0)
    for part in named:
        unnamed = unnamed.unionByName(part)
    return unnamed


def _scored(docs: DataFrame, known: dict[str, Reference], prefix: str, again: bool = False) -> DataFrame:
    """Scores against some references; ``again``: the rows have scores, and the nearer count."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    added_names = [prefix + name for name in SCORES]
    own = [c for c in docs.columns if not (again and c in added_names)]
    text, lang = (docs.columns.index(c) for c in ("text", "lang"))
    kinds = list(SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for t, language in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist(), strict=True):
                base = base_counts(t)
                name, by_class, by_word, near = divergence(t, language, shared.value)
                rows.append((*base, base.failed, near and not base.failed, name, by_class, by_word))
            if again:
                before = zip(*(batch.column(name).to_pylist() for name in added_names), strict=True)
                rows = [_nearer(old, new) for old, new in zip(before, rows, strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(SCORES)
            added = [pa.array(c, kind) for c, kind in zip(columns, SCORES.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *added], names=[*own, *added_names])

    def _nearer(old: tuple, new: tuple) -> tuple:
        name, by_class, by_word = (kinds.index(k) for k in ("reference", "character_distance", "word_distance"))
        nearer = new[name] is not None and (old[name] is None or new[by_class] + new[by_word] < old[by_class] + old[by_word])
        return new if nearer else old

    names = ", ".join(f"{prefix}{name} {_TYPES[kind]}" for name, kind in SCORES.items())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own) + ", " + names
    return docs.mapInArrow(run, schema)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    columns = docs.columns
    return scored(docs, prefix="_quality_").filter("_quality_kept").select(*columns)
