"""Large JSON files, one object or array each, read by byte range.

A file ``{"id": record, ...}`` or ``[record, ...]`` is cut into ranges of a few megabytes. What a byte means depends on
all bytes before it: whether it stands inside a string, and how deep. So a first pass sums up each range for both cases
(it begins inside a string, or not): how many quotes, how the depth changes. A prefix scan over those rows, one per
range, gives every range its true start. A second pass finds the commas of the outermost level and takes the entries
that begin in its range, reading on to the end of the last one. A range may begin anywhere, also inside a string,
after a backslash or inside a character.

Entries that are no JSON, and text outside the outermost level, are rows with a ``problem``; nothing is dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a range. A task holds one range, and the entry that leads out of it.
RANGE_BYTES = 4 << 20
#: Entries of a range that are rows at once; a range of small entries holds a hundred thousand.
BATCH_ENTRIES = 4096

_QUOTE, _BACK, _COMMA = 0x22, 0x5C, 0x2C
_DEPTH = np.zeros(256, dtype=np.int8)
_DEPTH[[0x7B, 0x5B]] = 1
_DEPTH[[0x7D, 0x5D]] = -1
_MARK = _DEPTH != 0
_MARK[_COMMA] = True
_KEY = re.compile(r'\s*("(?:[^"\\]|\\.)*")\s*:\s*', re.S)
_BLANK = b" \t\r\n\xef\xbb\xbf"


class Source:
    """Byte ranges of one file; ``pyarrow.fs`` knows local, shared, HDFS and object stores."""

    def __init__(self, path: str):
        self.fs, self.at = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))

    def __enter__(self) -> Source:
        self.file = self.fs.open_input_file(self.at)
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, start: int, size: int) -> bytes:
        return self.file.read_at(size, start)

    def odd_backslashes(self, start: int) -> bool:
        """Does an odd number of backslashes stand right before ``start``? Then its first byte is escaped."""
        n, step = 0, 64
        while start > 0:
            part = self.read(max(0, start - step), min(step, start))
            run = len(part) - len(part.rstrip(b"\\"))
            n, start = n + run, start - run
            if run < len(part):
                break
            step *= 4
        return n % 2 == 1


def marks(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes that open or close a string, and of brackets and commas."""
    buf = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(buf == _QUOTE)
    back = buf == _BACK
    if len(quotes) and (escaped or back.any()):
        at = np.flatnonzero(back)  # a run of backslashes counts if it ends right before a quote
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        size = np.diff(first, append=len(at)) + ((at[first] == 0) & escaped)
        ends = at[np.append(first[1:], len(at)) - 1] if len(at) else at
        place = np.searchsorted(ends, quotes - 1)
        run = np.zeros(len(quotes), dtype=np.int64)
        near = np.minimum(place, max(0, len(ends) - 1))
        if len(ends):
            run = np.where(ends[near] == quotes - 1, size[near], 0)
        run += (quotes == 0) & escaped
        quotes = quotes[run % 2 == 0]
    return quotes, np.flatnonzero(_MARK[buf])


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, length, part, start, size`` of every range; names and lengths come from Spark's listing."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    last = F.ceil(F.col("length") / range_bytes).cast("bigint") - 1
    parts = files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
    sized = parts.withColumn("start", F.col("part") * range_bytes)
    return _dealt(sized.withColumn("size", F.least(F.lit(range_bytes), F.col("length") - F.col("start"))))


def _dealt(parts: DataFrame) -> DataFrame:
    """Ranges spread over the tasks; a file's rows would stay together else, and be read by one task."""
    return parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "start")


def summaries(parts: DataFrame) -> DataFrame:
    """The ranges with ``quotes`` (their number) and the change of depth if they begin ``outside`` or ``inside`` a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, start, size in zip(*(b.column(c).to_pylist() for c in ("file", "start", "size"))):
                with Source(file) as src:
                    data = src.read(start, size)
                    quotes, at = marks(data, src.odd_backslashes(start))
                buf = np.frombuffer(data, dtype=np.uint8)
                step, within = _DEPTH[buf[at]].astype(np.int64), np.searchsorted(quotes, at) % 2
                rows.append((len(quotes), int(step[within == 0].sum()), int(step[within == 1].sum())))
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.record_batch([*b.columns, *cols], names=[*b.schema.names, "quotes", "outside", "inside"])

    return parts.mapInArrow(run, "file string, length bigint, part bigint, start bigint, size bigint, quotes bigint, outside bigint, inside bigint")


def placed(found: DataFrame) -> DataFrame:
    """The ranges with their true start: ``in_string`` and ``depth``. One row per range meets in this window."""
    before = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    known = found.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    known = known.withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    return known.select("file", "length", "start", "size", "in_string", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"))


def _separators(buf: np.ndarray, quotes: np.ndarray, at: np.ndarray, in_string: bool, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the outermost level's separators and whether an entry may follow each, and the depth at the end."""
    at = at[(np.searchsorted(quotes, at) + in_string) % 2 == 0]
    step = _DEPTH[buf[at]].astype(np.int64)
    after = depth + np.cumsum(step)
    opens, closes = (step == 1) & (after == 1), (step == -1) & (after <= 0)
    comma = (step == 0) & (after == 1)
    which = opens | closes | comma
    return at[which], ~closes[which], int(after[-1]) if len(after) else depth


def entries_of(src: Source, length: int, start: int, size: int, in_string: bool, depth: int) -> Iterator[tuple[int, bytes, bool, bool]]:
    """(place, text, ended by a comma or bracket, inside the outermost level) of what begins in a range."""
    data = src.read(start, size)
    quotes, at = marks(data, src.odd_backslashes(start))
    buf = np.frombuffer(data, dtype=np.uint8)
    cut, leads, depth_end = _separators(buf, quotes, at, in_string, depth)
    outside = depth <= 0 and not in_string
    if start == 0 or outside:  # what stands before the first separator, outside the outermost level
        first = int(cut[0]) if len(cut) else size
        if outside and data[:first].strip(_BLANK):
            yield start, data[:first], True, False
    pairs = zip(cut[:-1].tolist(), cut[1:].tolist(), leads[:-1].tolist(), leads[1:].tolist())
    for i, j, lead, more in pairs:
        text = data[i + 1 : j]
        nothing = not text.strip(_BLANK)
        if not (nothing and (not lead or (buf[i] != _COMMA and not more))):  # an empty object or array has no entry
            yield start + i + 1, text, True, lead
    if not len(cut):
        return
    i = int(cut[-1])
    if not leads[-1]:
        if data[i + 1 :].strip(_BLANK):
            yield start + i + 1, data[i + 1 :], True, False
        return
    text, stop, within, ended = [data[i + 1 :]], start + size, (len(quotes) + in_string) % 2 == 1, False
    step = 1 << 16
    while stop < length and not ended:  # the entry goes on in the next ranges
        more = src.read(stop, min(step, length - stop))
        q, a = marks(more, src.odd_backslashes(stop))
        ends, lead, after = _separators(np.frombuffer(more, dtype=np.uint8), q, a, within, depth_end)
        ended = len(ends) > 0
        text.append(more[: ends[0]] if ended else more)
        if ended and not lead[0] and buf[i] != _COMMA and not b"".join(text).strip(_BLANK):
            return
        stop, within, depth_end, step = stop + len(more), (len(q) + within) % 2 == 1, after, min(2 * step, RANGE_BYTES)
    yield start + i + 1, b"".join(text), ended, True


def json_entries(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, at, key, value, problem``: one row for each entry of the outermost object or array of each file.

    ``at`` is the entry's place in bytes, ``key`` null in an array, ``value`` the JSON text. ``problem`` is null for
    good entries, else ``truncated`` (the file ends inside), ``blank`` (nothing between two commas), ``outside`` (text
    outside the outermost level) or ``text`` (no JSON value; its text is kept). Several objects or arrays in a
    file are read one after the other; repeated keys are a row each. Empty files and folders give no rows. A file whose
    quotes or brackets do not match is cut wrongly from there on, and shows as problems.
    """
    found = _dealt(placed(summaries(ranges(spark, path, range_bytes))))

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                with Source(row[0]) as src:
                    found = entries_of(src, *row[1:])
                    while rows := [(row[0], *_entry(*e)) for e in islice(found, BATCH_ENTRIES)]:
                        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "at", "key", "value", "problem"])

    return found.mapInArrow(run, "file string, at bigint, key string, value string, problem string")


def _entry(at: int, text: bytes, ended: bool, within: bool) -> tuple[int, str | None, str, str | None]:
    try:
        value = text.strip(_BLANK).decode()
    except UnicodeDecodeError:
        return at, None, text.decode(errors="replace"), "text"
    if not within:
        return at, None, value, "outside"
    if not ended:
        return at, None, value, "truncated"
    if not value:
        return at, None, value, "blank"
    key, whole = None, value
    try:
        if m := _KEY.match(value):
            key, value = json.loads(m[1], strict=False), value[m.end() :]
        json.loads(value)
    except (ValueError, RecursionError):
        return at, key, whole, "text"
    return at, key, value, None
