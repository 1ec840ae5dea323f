"""Event logs in XES files (plain or gzip XML).

One ``trace`` element is one row holding its attributes and its events, so whatever
concerns a single trace is computed inside the row. A gzip file is read by one task:
large logs should come as many files, or be staged to Parquet once (see
``caselog.streaming.staging``). Files up to ``SMALL_FILE`` bytes are parsed by expat, which
takes a fraction of the XML source's time; greater ones are streamed by the XML source.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselog.session import configure, in_workers

# Element names of typed attributes.
ATTRIBUTE_TAGS = ("string", "date", "int", "float", "boolean", "id")

_ATTRIBUTE = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())])
_BAG = [T.StructField(tag, T.ArrayType(_ATTRIBUTE)) for tag in ATTRIBUTE_TAGS]
TRACE = T.StructType(_BAG + [T.StructField("event", T.ArrayType(T.StructType(_BAG)))])

# Fixed patterns: ISO-8601 times. The first is the everyday form, which Spark casts as it
# is; the second adds the basic form and hours alone; the third is the week date.
COMMON_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
FULL_TIME = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
WEEK_TIME = r"^(\d{4})(-?)W(\d{2})(?:\2([1-7]))?(\D.*)?$"

# Fixed value: white space around identifiers.
BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def bag(element: Column | None = None) -> Column:
    """All attributes of an element as one array; those without a key are left out."""
    parts = [
        F.coalesce(F.col(tag) if element is None else element[tag], F.array().cast(T.ArrayType(_ATTRIBUTE)))
        for tag in ATTRIBUTE_TAGS
    ]
    return F.filter(F.concat(*parts), lambda a: a["_key"].isNotNull())


def attribute(attributes: Column, key: str, keep: str = "first") -> Column:
    """Value of an attribute, empty when it is missing. A repeated key gives its first
    value (as the loader reads it) or its last (as the audit does)."""
    found = F.filter(attributes, lambda a: a["_key"] == key)
    return F.coalesce(F.try_element_at(found, F.lit(1 if keep == "first" else -1))["_value"], F.lit(""))


def attribute_map(attributes: Column, keep: str = "first") -> Column:
    """The attributes as a map, one value per key."""
    ordered = attributes if keep == "first" else F.reverse(attributes)
    keys = F.transform(ordered, lambda a: a["_key"])
    once = F.filter(ordered, lambda a, i: F.array_position(keys, a["_key"]) == i + 1)
    return F.map_from_entries(F.transform(
        once, lambda a: F.struct(a["_key"].alias("key"), F.coalesce(a["_value"], F.lit("")).alias("value"))
    ))


def _full_time(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, FULL_TIME, i)
    two = lambda i: F.when(part(i) == "", "00").otherwise(part(i))
    return F.concat(
        part(1), F.lit("-"), part(3), F.lit("-"), part(4), F.lit(" "), two(5), F.lit(":"), two(7), F.lit(":"),
        two(8), F.lit("."), F.rpad(part(9), 6, "0"),
        F.regexp_replace(part(10), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2"),
    )


def _week_to_date(text: Column) -> Column:
    """Text with its week date replaced by the calendar date; NULL for a week the year
    does not have."""
    part = lambda i: F.regexp_extract(text, WEEK_TIME, i)
    week = part(3).cast("int")
    january_4 = F.concat(part(1), F.lit("-01-04")).try_cast("date")
    day = F.when(part(4) == "", 1).otherwise(part(4).try_cast("int"))
    found = F.date_add(F.date_trunc("week", january_4).cast("date"), (week - 1) * 7 + day - 1)
    return F.when(
        (week >= 1) & (F.weekofyear(found) == week), F.concat(F.date_format(found, "yyyy-MM-dd"), part(5))
    )


def parse_time(text: Column) -> Column:
    """ISO-8601 text to a timestamp, NULL when it is not one. The shape is tested first:
    a plain cast also takes fragments such as a lone year. The everyday form costs one
    pattern and one cast, inside generated code; rarer forms are rewritten step by step,
    each step bound to a lambda variable so that the text is not computed again."""
    rewritten = F.transform(
        F.array(text), lambda t: F.when(t.rlike(WEEK_TIME), _week_to_date(t)).otherwise(t)
    )
    plain = F.transform(rewritten, lambda t: F.when(t.rlike(FULL_TIME), _full_time(t)))
    return F.when(text.rlike(COMMON_TIME), text.try_cast("timestamp")).otherwise(
        F.regexp_replace(F.element_at(plain, 1), r":$", ":00").try_cast("timestamp")
    )


# Options of the XML source: values are kept as written, namespaces are ignored.
OPTIONS = {
    "rowTag": "trace", "mode": "FAILFAST", "ignoreSurroundingSpaces": "false", "ignoreNamespace": "true",
    "inferSchema": "false",
}


def place_traces(raw: DataFrame) -> DataFrame:
    """Scanned trace elements (with their source_file) as rows with a position. It must be
    applied before any shuffle: there the generated id grows along each file."""
    return raw.select(
        "source_file",
        F.monotonically_increasing_id().alias("trace_pos"),
        bag().alias("attributes"),
        F.transform(F.coalesce("event", F.array().cast(TRACE["event"].dataType)), bag).alias("events"),
    )


# Stored bytes of a file that a task parses whole, names that say it is packed
# other than by gzip, bytes handed to the parser at a time.
SMALL_FILE, PACKED, CHUNK = 64 << 20, r"\.(bz2|deflate|snappy|lz4|zst|zstd|xz)$", 1 << 20
_PLACED = "source_file string, attributes array<struct<_key:string,_value:string>>, events array<array<struct<_key:string,_value:string>>>"


class _Lists:
    """Flat columns of attribute lists: keys, values and ranks of the tags, and where lists end."""

    def __init__(self):
        self.keys, self.values, self.ranks, self.ends = [], [], [], []

    def close(self, unordered: bool) -> None:
        """Ends a list; its attributes come in the order of the tags, then of the document."""
        if unordered:
            first = self.ends[-1] if self.ends else 0
            order = sorted(range(first, len(self.keys)), key=self.ranks.__getitem__)
            for column in (self.keys, self.values, self.ranks):
                column[first:] = [column[i] for i in order]
        self.ends.append(len(self.keys))

    def take(self, n: int) -> pa.ListArray:
        """The first ``n`` lists, which are then dropped."""
        ends = [0, *self.ends[:n]]
        cut = ends[-1]
        pairs = pa.StructArray.from_arrays(
            [pa.array(self.keys[:cut], pa.string()), pa.array(self.values[:cut], pa.string())], ["_key", "_value"])
        for column in (self.keys, self.values, self.ranks):
            del column[:cut]
        self.ends[:] = [e - cut for e in self.ends[n:]]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def _parser(own: _Lists, events: _Lists, trace_ends: list[int]):
    """An expat parser that fills the lists of traces and of events. ``trace_ends`` gets the number of
    events up to the end of each trace. Attributes inside attributes are left out, as are
    elements of other names."""
    ranks = {tag: i for i, tag in enumerate(ATTRIBUTE_TAGS)}
    rank_of = ranks.get
    # depth of the element at hand and the depth at which elements count: children of a trace or event
    depth, at, last, unordered, held = 0, -1, 0, False, (0, False)
    in_event = False
    key, value, rank_to = own.keys.append, own.values.append, own.ranks.append

    def start(name: str, found: list[str]) -> None:
        nonlocal depth, at, last, unordered, held, in_event, key, value, rank_to
        depth += 1
        if depth != at:
            if at < 0 and name.rpartition(":")[2] == "trace":
                at, last, unordered = depth + 1, 0, False
            return
        rank = rank_of(name)
        if rank is None and ":" in name:
            name = name.rpartition(":")[2]
            rank = rank_of(name)
        if rank is not None:
            if len(found) == 4 and found[0] == "key" and found[2] == "value":
                key(found[1])
                value(found[3])
            else:
                pairs = {k.rpartition(":")[2]: v for k, v in zip(found[::2], found[1::2])}
                if "key" not in pairs:
                    return
                key(pairs["key"])
                value(pairs.get("value"))
            rank_to(rank)
            if rank < last:
                unordered = True
            last = rank
        elif name == "event" and not in_event:
            held, in_event, at = (last, unordered), True, depth + 1
            last, unordered = 0, False
            key, value, rank_to = events.keys.append, events.values.append, events.ranks.append

    def end(name: str) -> None:
        nonlocal depth, at, last, unordered, in_event, key, value, rank_to
        depth -= 1
        if depth + 2 != at:
            return
        if in_event:
            events.close(unordered)
            in_event, at, (last, unordered) = False, at - 1, held
            key, value, rank_to = own.keys.append, own.values.append, own.ranks.append
        else:
            own.close(unordered)
            trace_ends.append(len(events.ends))
            at = -1

    parser = expat.ParserCreate("UTF-8")
    parser.ordered_attributes = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    return parser


def _parsed(file: str, chunks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """The traces of a document; after each chunk those that are complete."""
    own, events, trace_ends = _Lists(), _Lists(), []
    parser = _parser(own, events, trace_ends)
    for chunk in chain(chunks, [None]):
        try:
            parser.Parse(chunk or b"", chunk is None)
        except expat.ExpatError as e:
            raise ValueError(f"malformed file {file}: {e}") from e
        if trace_ends:
            n, done = len(trace_ends), trace_ends[-1]
            nested = pa.ListArray.from_arrays(pa.array([0, *trace_ends], pa.int32()), events.take(done))
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.string()), own.take(n), nested], ["source_file", "attributes", "events"])
            trace_ends.clear()


def _unpacked(file: str, content: memoryview) -> Iterator[bytes]:
    """The bytes of a file in chunks; a gzip file may have several members."""
    if not file.endswith(".gz"):
        yield from (bytes(content[i:i + CHUNK]) for i in range(0, len(content), CHUNK))
        return
    while len(content):
        member, data = zlib.decompressobj(31), content
        while not member.eof:
            try:
                chunk = member.decompress(data, CHUNK)
            except zlib.error as e:
                raise ValueError(f"malformed file {file}: {e}") from e
            if not chunk and not member.eof and not member.unconsumed_tail:
                raise ValueError(f"malformed file {file}: it ends early")
            yield chunk
            data = member.unconsumed_tail
        content = memoryview(member.unused_data)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for files in batches:
        for file, content in zip(files.column(0), files.column(1)):
            file, content = file.as_py(), memoryview(content.as_buffer())
            if not len(content):
                continue
            yield from _parsed(file, _unpacked(file, content))


def read_traces(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """One row per trace: source file, position in it, attributes, events in file order.
    A malformed file fails the read unless ``mode`` is given. With options, and for files that
    are large or packed other than by gzip, the XML source reads."""
    def by_source(*paths: str) -> DataFrame:
        raw = configure(spark).read.format("xml").schema(TRACE).options(**{**OPTIONS, **options}).load(list(paths))
        return place_traces(raw.withColumn("source_file", F.col("_metadata.file_path")))

    if options:
        return by_source(path)
    in_workers(spark)
    files = configure(spark).read.format("binaryFile").load(path)
    apart = (F.col("length") > SMALL_FILE) | F.col("path").rlike(PACKED)
    large = [r.path for r in files.where(apart).select("path").collect()]
    small = files.where(~apart).select(F.col("_metadata.file_path").alias("source_file"), "content").mapInArrow(_parse_files, _PLACED)
    placed = small.select("source_file", F.monotonically_increasing_id().alias("trace_pos"), "attributes", "events")
    return placed.unionByName(by_source(*large)) if large else placed


def flatten_traces(traces: DataFrame, keep: str = "last") -> DataFrame:
    """Trace rows with the identifier as text, without the events."""
    return traces.select(
        "source_file", "trace_pos", strip(attribute(F.col("attributes"), "concept:name", keep)).alias("document_id"),
        F.size("events").alias("events"),
    )


def flatten_events(traces: DataFrame, keep: str = "last") -> DataFrame:
    """One row per event, keyed by its position in the source."""
    exploded = traces.select(
        "source_file", "trace_pos",
        strip(attribute(F.col("attributes"), "concept:name", keep)).alias("document_id"),
        F.posexplode("events").alias("event_pos", "e"),
    )
    e = F.col("e")
    return exploded.select(
        "source_file", "trace_pos", "event_pos", "document_id",
        attribute(e, "EventID", keep).alias("event_id"),
        attribute(e, "concept:name", keep).alias("activity"),
        attribute(e, "time:timestamp", keep).alias("raw_time"),
        attribute(e, "org:resource", keep).alias("resource"),
        attribute(e, "lifecycle:transition", keep).alias("lifecycle_transition"),
        attribute(e, "Action", keep).alias("action"),
        attribute(e, "EventOrigin", keep).alias("event_origin"),
    )
