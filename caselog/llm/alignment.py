"""Token alignment between a byte-level and a sentence-piece tokenizer, with corpus counts.

Both tokenizers' tokens of a text cover the same bytes. Where tokens of both end, a group
ends; between any two neighbouring ends of either, one token of each overlaps, which is a
link. Three passes read the documents: the first gives the distinct linked pairs, on which a
minimal perfect hash is built; the second counts in how many documents each pair is linked,
in a dense vector a task that are summed in a tree; the third aligns again and looks counts
up by hash, verified by the stored key.

Whole texts are encoded by runs that neither tokenizer's tokens cross: words with the space
or line feed before them, and punctuation behind letters. A worker encodes a run once.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.llm import perfect_hash
from caselog.llm.common import in_workers, sliced, stored, worker_cache
from caselog.llm.token_files import _BYTE_LETTERS, _Grown

#: Pieces whose alignment a worker keeps before it starts anew (about 300 MB), and their
#: characters at most.
CACHE_PIECES, CACHE_CHARACTERS = 1_000_000, 20_000_000
#: Pairs counted at a time. All pairs of two vocabularies could be 1.6e9; texts link few of
#: them. More are counted and looked up in rounds, by a hash of the pair.
PAIRS_AT_ONCE = 8_000_000
#: Counts of a block of a vector; vectors that one task sums; tasks that make vectors.
BLOCK, FAN, VECTORS = 1 << 14, 128, 1 << 14
#: New words encoded in a row.
JOINED = 512
#: Pairs that a task remembers to have sent.
SENT = 2_000_000
#: Fixed pattern: where byte-level tokenizers split a text before the merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTERS = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#$%&*\"()-]*)")
_MIXED = re.compile(r"[^▁]▁|\n|[A-Za-zÀ-ÖØ-öø-ÿ][.,;:!?|#$%&*\"()-]")


class Aligned(NamedTuple):
    """Of a batch: a row a text, and the links of all texts one after the other."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray  # numbers into ``Aligner.pairs``
    groups: list[bytes]


class Aligner:
    def __init__(self, path_a: str, path_b: str, groups: bool = False):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letter_bytes = {chr(b).translate(_BYTE_LETTERS): b for b in range(256)}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letter_bytes[c] for c in token) if all(c in letter_bytes for c in token) else token.encode()
        with open(path_a, encoding="utf-8") as file:
            about = json.load(file)
        split = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        byte_level = about["normalizer"] is None and split.items() <= (about["pre_tokenizer"] or {}).items()
        vocab, merges = about["model"]["vocab"], (m if isinstance(m, str) else " ".join(m) for m in about["model"]["merges"])
        self.encode_a = lambda text: self.a.encode(text, add_special_tokens=False).ids
        if byte_level and all(vocab[m.replace(" ", "")] == 256 + i for i, m in enumerate(merges)):
            # ids in the order of the merges are ranks: the same ids by the faster library
            ranks = {self.a_bytes[i]: i for i in vocab.values()}
            self.encode_a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # no piece may reach over a place where runs are cut; else whole texts are runs
        self.cuts = byte_level and not any(_MIXED.search(p) for p in pieces)
        self.want_groups = groups
        kinds = ((len(self.a_bytes), b","), (len(self.a_bytes), b"|"), (len(pieces), b","), (len(pieces), b";"))
        self.marked = [b"%d%s" % (i, mark) for n, mark in kinds for i in range(n)] if groups else []
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in kind], np.int64) for kind in (self.a_bytes, self.b_bytes))
        self.reset()

    def reset(self) -> None:
        self.characters = 0
        self.numbers: dict = defaultdict(itertools.count().__next__)
        self.first, self.second = _Grown("i4"), _Grown("i4")
        #: May a piece begin or end a run? Bits 1 and 2: no.
        self.loose = _Grown("i1")
        #: Run 0 has nothing. Of each run: tokens, groups, place and number of links.
        self.runs: dict[str, int] = {"": 0}
        self.n_a, self.n_b, self.n_groups = _Grown("i4", 0), _Grown("i4", 0), _Grown("i4", 0)
        self.valid = _Grown("i1", 1)
        self.starts, self.lengths, self.links = _Grown("i8", 0), _Grown("i4", 0), _Grown("i4")
        self.groups: list[bytes] = [b""]
        self.pair_numbers: dict[int, int] = defaultdict(itertools.count().__next__)
        self.pairs = _Grown("i8")

    def _learn(self, pieces: list) -> None:
        """A piece is a word behind a space, or with a line feed before it; a tuple holds a
        stretch with its white space as it stands."""
        first, second, loose, new = [], [], [], []
        runs = self.runs
        for piece in pieces:
            stretch = isinstance(piece, tuple)
            text = piece[0] if stretch else piece
            self.characters += len(text)
            m = None if stretch or not self.cuts else _LETTERS.fullmatch(text)
            if m:
                run, rest, bad = (m[1] or " ") + m[2], m[3], 0
            elif stretch:
                run, rest, bad = text, "", 0
            else:
                word = text[1:] if text.startswith("\n") else text
                bad = 3 if not word else (1 if word[0].isspace() else 0) | (2 if word[-1].isspace() else 0)
                # a loose piece is met only as a part of a stretch
                run, rest = "" if bad else text if text.startswith("\n") else " " + text, ""
            loose.append(bad)
            for name, numbers in ((run, first), (rest, second)):
                known = runs.get(name)
                if known is None:
                    known = runs[name] = len(runs)
                    new.append(name)
                numbers.append(known)
        self.first.extend(first)
        self.second.extend(second)
        self.loose.extend(loose)
        if new:
            self._align(new)

    def _encoded(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Both tokenizers' ids of the runs in a row, unless these are not the runs' bytes.
        The second tokenizer puts a space before a text; it is taken off again before any
        other character, which a line feed shields from it."""
        text = "".join(runs)
        shield = "" if text[0] in " \n" else "\n"
        a = self.encode_a(text)
        b = self.b.encode(text[1:] if text[0] == " " else shield + text)
        b = b if text[0] == " " else b[1 + len(shield):]
        raw = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def _align(self, new: list[str]) -> None:
        # words can be encoded many in a row: each begins where both tokenizers cut
        words = [i for i, run in enumerate(new) if len(run) > 1 and run[0] in " \n" and not run[1].isspace() and not run[-1].isspace()]
        together = [words[i:i + JOINED] for i in range(0, len(words), JOINED)] if self.cuts else [[i] for i in words]
        alone = set(range(len(new))).difference(words)
        order, some_a, some_b, bad = [], [], [], []
        queue = [*together, *([i] for i in sorted(alone))]
        for few in queue:
            found = self._encoded([new[i] for i in few])
            if found is None and len(few) > 1:
                queue += [[i] for i in few]  # the loop goes on to them
                continue
            order += few
            if found is None:
                bad += few
                continue
            some_a.append(found[0])
            some_b.append(found[1])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (some_a, some_b))
        spoiled = np.isin(order, bad)
        sizes = np.array([0 if gone else len(new[i].encode()) for i, gone in zip(order, spoiled.tolist(), strict=True)], np.int64)
        run_ends = np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends, common = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        codes = (a[np.searchsorted(ends_a, ends)] << 16) | b[np.searchsorted(ends_b, ends)]
        unique, back = np.unique(codes, return_inverse=True)
        known, number = len(self.pair_numbers), self.pair_numbers
        local = np.fromiter(map(number.__getitem__, unique.tolist()), np.int32, len(unique))
        if len(number) > known:
            self.pairs.extend(np.fromiter(itertools.islice(number, known, None), np.int64, len(number) - known))
        per_run = [np.diff(np.r_[0, np.searchsorted(e, run_ends, "right")]) for e in (ends_a, ends_b, common, ends)]
        n_a, n_b, n_groups, n_links = per_run
        starts = self.links.n + np.cumsum(n_links) - n_links
        self.links.extend(local[back])
        # runs are numbered in the order of ``new``
        rank = np.empty(len(new), np.int64)
        rank[order] = np.arange(len(new))
        for room, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.starts, starts), (self.lengths, n_links),
                             (self.valid, ~spoiled)):
            room.extend(values[rank])
        if self.want_groups:
            texts = self._group_texts(a, b, ends_a, ends_b, common, n_a + n_b)
            self.groups += [texts[i] for i in rank.tolist()]

    def _group_texts(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, common: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The ids of the groups of each run: every id with the mark that follows it."""
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        marked_a = a + np.where(np.r_[np.diff(group_a), 1] > 0, len(self.a_bytes), 0)
        marked_b = b + 2 * len(self.a_bytes) + np.where(np.r_[np.diff(group_b), 1] > 0, len(self.b_bytes), 0)
        side = np.r_[np.zeros(len(a), np.int8), np.ones(len(b), np.int8)]
        order = np.lexsort((side, np.r_[group_a, group_b]))
        marks = list(map(self.marked.__getitem__, np.r_[marked_a, marked_b][order].tolist()))
        ends = np.cumsum(sizes).tolist()
        return [b"".join(marks[end - size:end])[:-1] for end, size in zip(ends, sizes.tolist(), strict=True)]

    def batch(self, texts: list[str | None]) -> Aligned:
        if len(self.numbers) > CACHE_PIECES or self.characters > CACHE_CHARACTERS:
            self.reset()
        number = self.numbers
        if self.cuts:
            split = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        else:
            split = [[(" " + t,)] if t else [] for t in texts]
        at = self._numbered(split)
        sizes = np.array([len(x) for x in split], np.int64)
        loose = np.flatnonzero(self.loose.room[at])
        if len(loose):
            ends = np.cumsum(sizes)
            for i in np.unique(np.searchsorted(ends, loose, "right")).tolist():
                split[i] = self._stretches(split[i], self.loose.room[at[ends[i] - sizes[i]:ends[i]]])
            at = self._numbered(split)
            sizes = np.array([len(x) for x in split], np.int64)
        runs = np.stack((self.first.room[at], self.second.room[at]), axis=1).ravel().astype(np.int64)
        ends = 2 * np.cumsum(sizes)
        valid = _sums(1 - self.valid.room[runs].astype(np.int64), ends) == 0
        kept = np.repeat(valid, 2 * sizes)
        runs = np.where(kept, runs, 0)
        n_a, n_b, n_groups, n_links = (_sums(x.room[runs].astype(np.int64), ends) for x in (self.n_a, self.n_b, self.n_groups, self.lengths))
        lengths = self.lengths.room[runs].astype(np.int64)
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        links = self.links.room[np.repeat(self.starts.room[runs] - (upto - lengths), lengths) + np.arange(total)]
        texts_of_groups = []
        if self.want_groups:
            begin = 0
            for end in ends.tolist():
                some = runs[begin:end]
                texts_of_groups.append(b";".join(map(self.groups.__getitem__, some[some > 0].tolist())))
                begin = end
        return Aligned(n_a, n_b, n_groups, n_links, links, texts_of_groups)

    def _numbered(self, split: list[list]) -> np.ndarray:
        known = len(self.numbers)
        at = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))
        if len(self.numbers) > known:
            self._learn(list(itertools.islice(self.numbers, known, None)))
        return at

    @staticmethod
    def _stretches(pieces: list, loose: np.ndarray) -> list:
        """Pieces joined where white space meets white space or an end."""
        out, begin = [], 0
        for i in range(1, len(pieces) + 1):
            if i < len(pieces) and (loose[i - 1] & 2 or loose[i] & 1):
                continue
            if i - begin == 1 and not loose[begin]:
                out.append(pieces[begin])
            else:
                out.append(("".join(p if p.startswith("\n") else " " + p for p in pieces[begin:i]),))
            begin = i
        return out


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.r_[0, np.cumsum(values)]
    return upto[ends] - upto[np.r_[0, ends[:-1]]] if len(ends) else np.zeros(0, np.int64)


_aligners: dict[tuple, Aligner] = {}


def aligner(paths: tuple[str, str], groups: bool = False) -> Aligner:
    """The worker's aligner, kept from task to task; one at a time."""
    if (paths, groups) not in _aligners:
        _aligners.clear()
        _aligners[paths, groups] = Aligner(*paths, groups)
    return _aligners[paths, groups]


def _drop() -> bool:
    some = bool(_aligners)
    _aligners.clear()
    return some


worker_cache("aligned runs", _drop)


def _texts(docs: DataFrame) -> DataFrame:
    return in_workers(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))


def linked_pairs(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """The distinct pairs linked in any text, one number each: A's id times 65,536 plus B's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = aligner(paths)
        found: set[int] = set()
        for batch in sliced(batches, uses="aligned runs"):
            some = code.batch(batch.column("text").to_pylist())
            new = set(code.pairs.room[np.unique(some.links)].tolist()) - found
            found |= new
            if len(found) > SENT:
                found = set()
            yield pa.record_batch({"pair": pa.array(list(new), pa.int64())})

    return _texts(docs).select("text").mapInArrow(run, "pair long").distinct()


class _Numbers:
    """Hash numbers of an aligner's pairs, looked up once for each pair it knows."""

    def __init__(self, hashed: perfect_hash.PerfectHash):
        self.hashed, self.owner, self.known = hashed, None, np.zeros(0, np.int64)

    def of(self, code: Aligner, links: np.ndarray) -> np.ndarray:
        if self.owner is not code.pair_numbers:
            self.owner, self.known = code.pair_numbers, np.zeros(0, np.int64)
        if code.pairs.n > len(self.known):
            self.known = np.r_[self.known, self.hashed(code.pairs.room[len(self.known):code.pairs.n])]
        return self.known[links]


def document_counts(docs: DataFrame, paths: tuple[str, str], hashed: perfect_hash.PerfectHash) -> np.ndarray:
    """In how many documents each key of the hash is linked.

    Each task counts in a vector as long as the keys and sends its blocks; blocks are summed
    by groups of ``FAN`` tasks, then over the groups."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hashed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, numbers = aligner(paths), _Numbers(shared.value)
        counts = np.zeros(-(-len(shared.value) // BLOCK) * BLOCK, np.int64)
        for batch in sliced(batches, uses="aligned runs"):
            some = code.batch(batch.column("text").to_pylist())
            at = numbers.of(code, some.links)
            row = np.repeat(np.arange(batch.num_rows), some.n_links)
            each = np.unique((row[at >= 0] << 40) | at[at >= 0]) & ((1 << 40) - 1)
            np.add.at(counts, each, 1)
        task = TaskContext.get().partitionId()
        for block, part in enumerate(counts.reshape(-1, BLOCK)):
            if part.any():
                yield pa.record_batch({"task": pa.array([task]), "block": pa.array([block]), "counts": pa.array([part.tobytes()], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for part in table.column("counts"):
            total += np.frombuffer(part.as_buffer(), np.int64)
        return pa.table({
            "task": table.column("task").slice(0, 1), "block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "task long, block long, counts binary"
    vectors = _texts(docs).select("text").coalesce(VECTORS).mapInArrow(run, kind)
    branches = vectors.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "block").applyInArrow(added, kind)
    out = np.zeros(-(-len(hashed) // BLOCK) * BLOCK, np.int64)
    for r in branches.groupBy("block").applyInArrow(added, kind).collect():
        out[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["counts"]), np.int64)
    shared.destroy()
    return out[:len(hashed)]


SCHEMA = ("doc_id long, text_hash long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
          "count_sum long, groups_sha256 string")


def _looked_up(docs: DataFrame, paths: tuple[str, str], hashed: perfect_hash.PerfectHash, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((hashed, counts, counts == best[hashed.keys >> 16]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function, counted, is_best = shared.value
        code, numbers = aligner(paths, True), _Numbers(function)
        for batch in sliced(batches, uses="aligned runs"):
            some = code.batch(batch.column("text").to_pylist())
            at, ends = numbers.of(code, some.links), np.cumsum(some.n_links)
            here = at >= 0
            at = np.where(here, at, 0)
            n_best = _sums((is_best[at] & here).astype(np.int64) if len(counted) else at, ends)
            total = _sums(np.where(here, counted[at], 0) if len(counted) else at, ends)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in some.groups]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_a": pa.array(some.n_a), "n_b": pa.array(some.n_b),
                "n_groups": pa.array(some.n_groups), "n_links": pa.array(some.n_links), "n_best": pa.array(n_best),
                "count_sum": pa.array(total), "groups_sha256": pa.array(digests, pa.string())})

    return _texts(docs).mapInArrow(run, SCHEMA)


def align(docs: DataFrame, path_a: str, path_b: str, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """Of each document tokens, groups and links, the links that are the most common of their
    A token in the corpus (ties included), the sum of the links' document counts, and the
    SHA-256 of its groups.

    A text that is null or empty, or whose tokens don't join to its own bytes, has no tokens,
    zeros and an empty digest, and links nothing. Rows that repeat are documents of their own
    and each counts. Null ids stay null; an empty table gives no rows; other columns are not
    read. The ids of both tokenizers must be below 65,536.
    """
    paths = (path_a, path_b)
    pairs = stored(linked_pairs(docs, paths), "linked-pairs")
    n = pairs.count()
    rounds = max(1, -(-n // at_once))
    functions, vectors = [], []
    best = np.zeros(1 << 16, np.int64)
    for part in range(rounds):
        some = pairs if rounds == 1 else stored(pairs.filter(F.pmod(F.xxhash64("pair"), F.lit(rounds)) == part), "pairs-of-round")
        functions.append(perfect_hash.build(some, n if rounds == 1 else some.count()))
        vectors.append(document_counts(docs, paths, functions[-1]))
        np.maximum.at(best, functions[-1].keys >> 16, vectors[-1])
    out = [_looked_up(docs, paths, f, v, best) for f, v in zip(functions, vectors, strict=True)]
    if rounds == 1:
        return out[0].drop("text_hash")
    every = out[0].withColumn("round", F.lit(0))
    for i, part in enumerate(out[1:], 1):
        every = every.union(part.withColumn("round", F.lit(i)))
    # equal rows of a round give equal sums; each row of the input comes back once
    own = [c for c in every.columns if c not in ("n_best", "count_sum", "round")]
    per_round = every.groupBy(*own, "round", "n_best", "count_sum").agg(F.count("*").alias("copies"))
    sums = per_round.groupBy(*own).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("copies").alias("copies"))
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(c for c in out[0].columns if c != "text_hash"))
