"""Token ids of documents as flat files of unsigned integers with 64-bit offsets.

Layout of a folder written by ``write``:

* ``parts/kind=tokens/part-*``: the ids of one range of documents after the other in
  ascending doc_id, nothing else, little-endian, 2 bytes each where the vocabulary has at
  most 65,536 ids and 4 otherwise. Each document ends with the end id.
* ``parts/kind=index/part-*``: a record a document, ``INDEX``: doc_id, number of ids.
* ``offsets/part-*``: the 64-bit number of ids before each document, over all parts, flat.
* ``bases``: Parquet, one row a part: its documents and ids, and those of all parts before.

Spark's own file writer writes all of them, so a lost task leaves nothing behind and any
file system Spark reaches will do. It ends every row with a separator; that is the end id in
``parts`` and the top byte of an offset, which is zero below 2^56, in ``offsets``.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselog.llm.common import in_workers, partitions, sliced, worker_cache
from caselog.session import scratch_path

#: Pieces whose ids a worker keeps before it starts anew (about 60 MB).
CACHE_WORDS = 200_000
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#$%&*\"()-]*)")
#: Byte-level tokenizers write a byte as the character of its number if that is printable in
#: Latin-1, and as the next free one from 256 on otherwise.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = str.maketrans({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)})


def index_type(end_bytes: int) -> np.dtype:
    """A record of the index. A negative number of ids marks a null doc_id."""
    return np.dtype([("doc_id", "<i8"), ("n", "<i8"), ("end", f"V{end_bytes}")])


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: str, *first: int):
        self.room, self.n = np.zeros(1024, dtype), 0
        self.extend(list(first))

    def extend(self, values: list[int] | np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate((self.room, np.zeros(max(len(self.room), len(values)), self.room.dtype)))
        self.room[self.n:self.n + len(values)] = values
        self.n += len(values)


class Encoder:
    """Ids of whole texts by a tokenizer that drops white space and never joins across it.

    Such a tokenizer's ids of a text are those of its space-separated pieces in order, so
    each piece is encoded once. A piece of Latin-1 letters and closing punctuation is two
    runs for the tokenizer's splitting rule, each encoded once as well; a run of letters in
    lower case, as its bytes are written, is all its model has to see. Any other piece is one
    run.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[str, int] = defaultdict(itertools.count().__next__)
        #: Run 0 has no ids. Each piece has two runs; each run has a place and a length in ids.
        self.runs: dict[str, int] = {"": 0}
        self.first, self.second = _Grown("i4"), _Grown("i4")
        self.starts, self.lengths, self.ids = _Grown("i8", 0), _Grown("i4", 0), _Grown(f"u{self.width}")

    def _learn(self, pieces: list[str]) -> None:
        first, second, ids, lengths = [], [], [], []
        runs, tokenize, base = self.runs, self.model.tokenize, self.ids.n

        def run_number(text: str, letters: bool) -> int:
            if letters:
                new = [t.id for t in tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_LETTERS))]
            else:
                new = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids.extend(new)
            lengths.append(len(new))
            number = runs[text] = len(runs)
            return number

        for piece in pieces:
            m = _LETTERS.fullmatch(piece)
            letters, rest = (m[1].lower(), m[2]) if m else (piece, "")
            number = runs.get(letters)
            first.append(run_number(letters, bool(m)) if number is None else number)
            number = runs.get(rest)
            second.append(run_number(rest, False) if number is None else number)
        self.first.extend(first)
        self.second.extend(second)
        sizes = np.array(lengths, np.int64)
        self.starts.extend(base + np.cumsum(sizes) - sizes)
        self.lengths.extend(lengths)
        self.ids.extend(ids)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.numbers) > CACHE_WORDS:
            self.reset()
        known, number = len(self.numbers), self.numbers
        split = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        counts = np.array([len(x) for x in split])
        at = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64, counts.sum())
        if len(number) > known:
            self._learn(list(itertools.islice(number, known, None)))
        runs = np.stack((self.first.room[at], self.second.room[at]), axis=1).ravel()
        sizes = self.lengths.room[runs].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.ids.room[np.repeat(self.starts.room[runs] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return np.split(ids, ends[2 * np.cumsum(counts)[:-1] - 1])


_encoders: dict[str, Encoder] = {}


def _drop() -> bool:
    some = bool(_encoders)
    _encoders.clear()
    return some


worker_cache("token pieces", _drop)


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _records(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Two rows a document, in the order of the rows: its ids and its record of the index,
    both without the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen = encoder(tokenizer), 0
        for batch in sliced(batches, uses="token pieces"):
            size = batch.num_rows
            ids = [x.tobytes() for x in code.batch(batch.column("text").to_pylist())]
            index = np.zeros(size, np.dtype([("doc_id", "<i8"), ("n", "<i8")]))
            index["doc_id"] = batch.column("doc_id").fill_null(0)
            n = np.array([len(x) // code.width + 1 for x in ids], np.int64)
            index["n"] = np.where(batch.column("doc_id").is_null(), -n, n)
            raw, place = index.tobytes(), pa.array(np.arange(seen, seen + size))
            seen += size
            for kind, values in (("index", [raw[i * 16:i * 16 + 16] for i in range(size)]), ("tokens", ids)):
                yield pa.record_batch({
                    "kind": pa.array([kind] * size), "place": place, "value": pa.array(values, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "kind string, place long, value binary")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the files of all documents and returns ``bases``.

    Null texts are empty, so only the end id; null ids come first; rows with one doc_id
    keep the order of the input. An empty table gives no parts and empty bases.
    """
    width = Encoder(tokenizer).width
    end = end_id.to_bytes(width, "little").decode("latin-1")
    slim = in_workers(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn(
        "tie", F.monotonically_increasing_id())
    # the texts are moved, not the ids: cutting the ranges reads the rows once more
    placed = slim.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    (_records(placed, tokenizer).sortWithinPartitions("kind", "place").select("kind", F.col("value").cast("string").alias("value"))
     .write.partitionBy("kind").option("lineSep", end).option("encoding", "ISO-8859-1").text(f"{path}/parts"))
    spark = docs.sparkSession
    bases = _bases(spark, path, width)
    bases.write.parquet(f"{path}/bases")
    bases = spark.read.schema(bases.schema).parquet(f"{path}/bases")
    starts = read_index(spark, path, width).select("part", "row", "start")
    parts = partitions(spark)
    digits = F.lpad(F.hex("start"), F.lit(16), F.lit("0"))
    low_bytes = F.to_binary(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(7))), F.lit("hex"))
    (starts.repartitionByRange(parts, "part", "row").sortWithinPartitions("part", "row")
     .select(low_bytes.cast("string").alias("value"))
     .write.option("lineSep", "\0").text(f"{path}/offsets"))
    return bases


PART_NUMBER = r"part-(\d+)"


def _files(spark: SparkSession, path: str, kind: str, *columns: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/parts/kind={kind}")
    return files.select(F.regexp_extract("path", PART_NUMBER, 1).cast("int").alias("part"), *columns)


def _has(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/parts/kind=index")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _index(spark: SparkSession, path: str, width: int) -> DataFrame:
    """part, row, doc_id, n and ids before it in its part, from the records of the index."""
    schema = "part int, row long, doc_id long, n long, before long"
    if not _has(spark, path):
        return spark.createDataFrame([], schema)
    kind = index_type(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
                records = np.frombuffer(content.as_buffer(), kind)
                n = np.abs(records["n"])
                yield pa.record_batch({
                    "part": pa.array(np.full(len(n), part, np.int32)), "row": pa.array(np.arange(len(n))),
                    "doc_id": pa.array(np.ascontiguousarray(records["doc_id"]), mask=records["n"] < 0),
                    "n": pa.array(n), "before": pa.array(np.cumsum(n) - n)})

    return _files(spark, path, "index", "content").mapInArrow(run, schema)


def _bases(spark: SparkSession, path: str, width: int) -> DataFrame:
    """One row a part, in order, with the sums over the parts before it."""
    sums = _index(spark, path, width).groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "part", "n_docs", "n_ids", F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("ids_before"))


def read_index(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Each document with its part, row, place in the part, and ``start`` over all parts."""
    bases = spark.read.parquet(f"{path}/bases").select("part", "ids_before")  # one row a part
    index = _index(spark, path, width).join(F.broadcast(bases), "part")
    return index.withColumn("start", F.col("ids_before") + F.col("before"))


def read(spark: SparkSession, path: str, width: int = 2, mapped: bool | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian of the stored width) of each document.

    Where the folder is on a mounted file system the token files are memory-mapped in the
    tasks; elsewhere Spark reads them, one part at a time (``mapped`` settles it).
    """
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not _has(spark, path):
        return spark.createDataFrame([], schema)
    if mapped is None:
        mapped = urlparse(path).scheme in ("", "file")
    kind = index_type(width)
    tokens = _files(spark, path, "tokens", *(["path"] if mapped else [F.col("content").alias("tokens")]))
    bases = spark.read.parquet(f"{path}/bases").select("part", "ids_before")
    index = _files(spark, path, "index", F.col("content").alias("index"))
    parts = tokens.join(index, "part").join(bases, "part").repartition(partitions(spark), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                ids = (np.memmap(unquote(urlparse(row["path"].as_py()).path), np.uint8, "r") if mapped
                       else np.frombuffer(row["tokens"].as_buffer(), np.uint8))
                records, base = np.frombuffer(row["index"].as_buffer(), kind), row["ids_before"].as_py()
                n = np.abs(records["n"])
                starts = np.cumsum(n) - n
                for lo in range(0, len(n), 512):
                    few = slice(lo, lo + 512)
                    yield pa.record_batch({
                        "doc_id": pa.array(np.ascontiguousarray(records["doc_id"][few]), mask=records["n"][few] < 0),
                        "start": pa.array(base + starts[few]), "n_tokens": pa.array(n[few]),
                        "ids": pa.array([ids[s * width:(s + k) * width].tobytes() for s, k in zip(starts[few], n[few], strict=True)], pa.binary())})

    return parts.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes the documents' token files and reads them back: doc_id, start, n_tokens and the
    CRC-32 of the ids as little-endian 32-bit integers."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write(docs, path, tokenizer, end_id)
    width = Encoder(tokenizer).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{width}").astype("<u4")) for x in batch.column("ids")]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"),
                "ids_crc32": pa.array(crc, pa.int64())})

    return read(spark, path, width).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
