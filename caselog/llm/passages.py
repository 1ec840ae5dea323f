"""Quality classifier by attention over passages (multiple-instance learning).

A document is a bag of passages of 128 words. Each passage is described by statistics of its
words, encoded by a layer that is learned, and weighted by gated attention (Ilse and others,
2018); the weighted encoding is scored. Only the document has a label, and the weights of the
passages are learned from it. Descriptions, training and scores read nothing but the text.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.llm.common import in_workers, sliced
from caselog.llm.shingles import word_hashes

PASSAGE = 128
#: Distinct words whose statistics a worker keeps before it starts anew (about 200 MB).
CACHE_WORDS = 500_000
#: Most labelled documents a fit reads, taken by the hash of their id.
FIT_DOCUMENTS = 4000
HASHED = 24
_SYMBOLS, _PUNCTUATION = frozenset("#*$%&|<>@^~_=+{}[]\\/"), frozenset(".,;:!?'\"-()")
_PER_WORD = 12


def _word_row(word: str) -> list[float]:
    """What is known of one word, whatever its place."""
    letters = sum(c.isalpha() for c in word)
    upper = sum(c.isupper() for c in word)
    return [
        min(len(word), 40), letters, upper, sum(c.isdigit() for c in word), sum(c in _SYMBOLS for c in word),
        sum(c in _PUNCTUATION for c in word), sum(c > "\x7f" for c in word), letters == 0, letters > 1 and upper == letters,
        word[:1].isupper(), word[-1:] in ".!?", word[-2:] == "!!",
    ]


class _Words:
    """Words numbered as they come, with their statistics in the rows of one array."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = defaultdict(itertools.count().__next__)
        self.rows, self.cells = np.zeros((0, _PER_WORD)), np.zeros(0, np.int64)

    def numbered(self, words: list[str]) -> np.ndarray:
        known = len(self.numbers)
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > known:
            new = list(itertools.islice(self.numbers, known, None))
            self.rows = np.concatenate((self.rows, np.array([_word_row(w) for w in new])))
            hashed = word_hashes([w.lower().encode(errors="replace") for w in new]) % np.uint64(HASHED)
            self.cells = np.concatenate((self.cells, hashed.astype(np.int64)))
        return at


FEATURES = _PER_WORD + 7 + HASHED


def describe(texts: list[str | None], words: _Words) -> list[np.ndarray]:
    """For each text one row of features a passage; a text without words is one zero row.

    Words are numbered for the whole batch at once, as each numbering extends the arrays."""
    split = [(t or "").split() for t in texts]
    at = words.numbered(list(itertools.chain.from_iterable(split)))
    ends = np.cumsum([len(s) for s in split])
    return [_describe(at[end - len(s):end], words) if s else np.zeros((1, FEATURES), np.float32) for s, end in zip(split, ends, strict=True)]


def _describe(at: np.ndarray, words: _Words) -> np.ndarray:
    n = len(at)
    starts = np.arange(0, n, PASSAGE)
    passage = np.arange(n) // PASSAGE
    sizes = np.diff(np.append(starts, n)).astype(float)
    means = np.add.reduceat(words.rows[at], starts) / sizes[:, None]
    pairs, counts = np.unique(passage * (at.max() + 1) + at, return_counts=True)
    of = pairs // (at.max() + 1)
    distinct = np.bincount(of, minlength=len(starts)) / sizes
    most = np.zeros(len(starts))
    np.maximum.at(most, of, counts)
    same = np.zeros(n)
    same[1:] = at[1:] == at[:-1]
    seen = np.ones(n)
    seen[np.unique(at, return_index=True)[1]] = 0
    spread = np.add.reduceat(words.rows[at, 0] ** 2, starts) / sizes - means[:, 0] ** 2
    cells = np.bincount(passage * HASHED + words.cells[at], minlength=len(starts) * HASHED).reshape(-1, HASHED) / sizes[:, None]
    own = np.stack([
        distinct, most / sizes, np.add.reduceat(same, starts) / sizes, np.add.reduceat(seen, starts) / sizes,
        np.sqrt(np.maximum(spread, 0)), np.log1p(sizes), np.full(len(starts), np.log1p(n))], axis=1)
    return np.concatenate((means, own, cells), axis=1).astype(np.float32)


class Model(NamedTuple):
    """Scaling, encoder (w, b), attention (v, u, a) and score (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m: Model, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Encodings, attention weights and scores of bags whose passages begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(x)))
    h = np.tanh(((x - m.mean) / m.scale) @ m.w + m.b)
    t, g = np.tanh(h @ m.v), _sigmoid(h @ m.u)
    e = (t * g) @ m.a
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(weight[:, None] * h, starts)
    return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "score": _sigmoid(z @ m.c + m.d[0])}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, epochs: int = 40, rate: float = 0.01, seed: int = 7) -> Model:
    """Trains on bags of passages with one label each (Adam on the log loss)."""
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    d = every.shape[1]
    shapes = {"w": (d, hidden), "b": (hidden,), "v": (hidden, 16), "u": (hidden, 16), "a": (16,), "c": (hidden,), "d": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), 64):
            few = [bags[i] for i in order[lo:lo + 64]]
            y, x = labels[order[lo:lo + 64]], np.concatenate(few)
            sizes = np.array([len(b) for b in few])
            starts = np.cumsum(sizes) - sizes
            m = Model(mean, scale, **p)
            f = _forward(m, x, starts)
            slope = (f["score"] - y) / len(y)
            dz = slope[:, None] * m.c
            dz_rows = np.repeat(dz, sizes, axis=0)
            dh = f["weight"][:, None] * dz_rows
            pull = (f["h"] * dz_rows).sum(1)
            de = f["weight"] * (pull - np.repeat(np.add.reduceat(f["weight"] * pull, starts), sizes))
            dt, dg = de[:, None] * m.a * f["g"] * (1 - f["t"] ** 2), de[:, None] * m.a * f["t"] * f["g"] * (1 - f["g"])
            dh = (dh + dt @ m.v.T + dg @ m.u.T) * (1 - f["h"] ** 2)
            grads = {
                "w": ((x - mean) / scale).T @ dh + 1e-4 * m.w, "b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg,
                "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ slope + 1e-4 * m.c, "d": np.array([slope.sum()])}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, **p)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> Model | None:
    """Fits on at most ``most`` labelled documents that aren't held out, those with the
    smallest hashes of their ids. Documents are described by the executors; the driver gets
    the rows of their passages. None where no label can be learned from.

    Rows with a null id or label are not used; of an id with several labels the smallest
    counts, and a repeated document is used once.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = chosen.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("long").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in sliced(batches, uses="word hashes"):
            rows = [b.ravel() for b in describe(batch.column("text").to_pylist(), words)]
            yield pa.record_batch({"id": batch.column("id"), "quality": batch.column("quality"), "rows": pa.array(rows, pa.list_(pa.float32()))})

    # at most ``most`` pairs of numbers are broadcast
    joined = in_workers(docs).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    found = joined.select("id", "quality", "text").mapInArrow(run, "id long, quality long, rows array<float>").toPandas()
    found = found.sort_values("id", kind="stable").drop_duplicates("id")
    if found.empty:
        return None
    bags = [np.asarray(r, np.float32).reshape(-1, FEATURES) for r in found["rows"]]
    return fit(bags, found["quality"].to_numpy(float))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, n_passages and the number of the passage with most weight.

    Every whole text is scored, null and empty ones as one passage without words. Without a
    model the score is 0.5. A null id is not held out. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in sliced(batches, uses="word hashes"):
            if len(words.numbers) > CACHE_WORDS:
                words = _Words()
            bags = describe(batch.column("text").to_pylist(), words)
            sizes = np.array([len(b) for b in bags])
            starts = np.cumsum(sizes) - sizes
            if shared.value is None:
                score, top = np.full(len(bags), 0.5), np.zeros(len(bags), np.int64)
            else:
                f = _forward(shared.value, np.concatenate(bags), starts)
                score, top = f["score"], np.array([f["weight"][s:s + n].argmax() for s, n in zip(starts, sizes, strict=True)])
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score),
                "n_passages": pa.array(sizes), "top_passage": pa.array(top)})

    slim = in_workers(docs).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, n_passages long, top_passage long")
