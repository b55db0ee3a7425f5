"""Helpers shared by the operators: texts in Arrow batches, stored tables, hashing."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import shutil
import tempfile
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes of text that one numpy step works on.
PIECE_BYTES = 2 << 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.lru_cache(maxsize=4)
def _archive(context_id: str) -> str:
    package = Path(__file__).resolve().parents[1]
    return shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once for each application; they may not have it installed."""
    context = spark.sparkContext
    if not any(Path(x).name == "tidemark.zip" for x in context.listFiles):
        context.addPyFile(_archive(context.applicationId))


def map_arrow(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def release() -> None:
    """Give what this Python worker no longer uses back to the system: idle workers stay while other stages run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins and ends; null counts as empty."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, bounds, data = texts.buffers()
    begin = texts.offset
    offsets = np.frombuffer(bounds, np.int64)[begin : begin + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes in all; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class WordCache(dict):
    """What ``make`` gives for a word, kept for words that are likely to come again.

    Long words are not kept, and a full cache keeps only its short words: they
    make up most of a text. Bounds memory, never results.
    """

    def __init__(self, make: Callable, entries: int, longest: int = 16, lasting: int = 6) -> None:
        super().__init__()
        self.make, self.entries, self.longest, self.lasting = make, entries, longest, lasting

    def __missing__(self, word):
        found = self.make(word)
        if len(word) <= self.longest and len(self) < 2 * self.entries:
            self[word] = found
        return found

    def trim(self) -> None:
        """To be called between texts."""
        if len(self) >= self.entries:
            short = {k: v for k, v in self.items() if len(k) <= self.lasting}
            self.clear()
            if len(short) < self.entries // 2:
                self.update(short)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64's finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15


#: Bytes that are hashed in one step; a longer word is hashed by itself.
_HASH_BYTES = 1 << 18


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        steps = np.full(_HASH_BYTES + 1, base % 2**64, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return run(_BASE), run(pow(_BASE, -1, 2**64))


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER_BYTES = _lower_table()

#: True for the bytes of a word: everything but 0x20 and 0x09 to 0x0D.
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])

#: Scripts written without spaces: each character is a word.
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


@functools.cache
def _kinds() -> np.ndarray:
    """0, 1 or 2 for each code point: outside words, part of a word, or a word alone."""
    out = np.array([unicodedata.category(chr(x))[0] in "LMN" for x in range(0x110000)], np.uint8)
    for x in np.flatnonzero(out).tolist():
        if x > 0x7F and _UNSPACED.match(chr(x)):
            out[x] = 2
    return out


def _alnum(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte of UTF-8 texts is in a word, and where a word may touch another."""
    kinds = _kinds()
    kind = kinds[np.minimum(data, 0x7F)]
    begin = np.flatnonzero(data >= 0xC0)
    if len(begin) == 0:
        return kind > 0, begin
    lead = data[begin].astype(np.int64)
    sizes = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    point = lead & (0x7F >> sizes)
    after = [np.minimum(begin + k, len(data) - 1) for k in (1, 2, 3)]
    for k, at in enumerate(after, 1):
        point = np.where(sizes > k, point << 6 | data[at] & 0x3F, point)
    own = kinds[np.minimum(point, 0x10FFFF)]
    kind[data >= 0x80] = 1
    kind[begin] = own
    for k, at in enumerate(after, 1):
        mine = (sizes > k) & (data[at] & 0xC0 == 0x80)
        kind[at[mine]] = own[mine]
    alone = begin[own == 2]
    cuts = np.concatenate([alone, alone + sizes[own == 2]])
    return kind > 0, cuts


def alnum_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as by ``words``, of Unicode letters, marks and digits; one for each character of unspaced scripts."""
    return _words(data, offsets, *_alnum(data))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of consecutive texts: begin, end and 64-bit hash of each, A-Z lower-cased.

    A word is a longest run of bytes for which ``kind`` is true, within one text.
    """
    return _words(data, offsets, kind[data], np.empty(0, np.int64))


def _words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words from the bytes that are inside one, cut between texts and at ``cuts``."""
    begin, end = word_bounds(data, offsets, inside, cuts)
    return begin, end, _hashes(data, begin, end)


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each longest run of bytes that are inside a word, cut between texts and at ``cuts``."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = offsets if cuts is None else np.concatenate([offsets, cuts])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[inside[cuts] & inside[cuts - 1]]
    marks = np.flatnonzero(edge)
    if len(joined):
        joined = np.unique(joined)
        marks = np.sort(np.concatenate([marks, joined, joined]))
    return marks[0::2], marks[1::2]


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words, from prefix sums over stretches of whole words."""
    powers, inverse = _powers()
    out = np.empty(len(begin), np.uint64)
    first = 0
    while first < len(begin):
        base = begin[first]
        last = int(np.searchsorted(end, base + _HASH_BYTES, "right"))
        if last == first:
            word = LOWER_BYTES[data[base : end[first]]].tobytes()
            out[first] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            first += 1
            continue
        part = LOWER_BYTES[data[base : end[last - 1]]].astype(np.uint64)
        part += np.uint64(1)
        part *= powers[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        a, b = begin[first:last] - base, end[first:last] - base
        out[first:last] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        first = last
    return mix(out)


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive hashes, in order."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + m]
    return mix(out)


def annotate(df: DataFrame, fn, added: str, keep: list[str] | None = None, done: Callable | None = None) -> DataFrame:
    """The columns ``keep`` (default all) and those that ``fn`` makes of each Arrow batch.

    ``added`` is the DDL of the new columns; they replace input columns of the same names.
    ``done`` is called after the last batch of each partition.
    """
    new = T.StructType.fromDDL(added)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    schema = T.StructType([df.schema[c] for c in kept] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], schema.names)
        if done:
            batch = made = None
            done()

    return map_arrow(df, run, schema)


def draw(rows: DataFrame, by: str, per_value: int) -> DataFrame:
    """At most ``per_value`` rows for each value of ``by``: those of the smallest ``draw`` (a 64-bit hash column).

    The share of the hash range that holds a few more rows than wanted follows
    from the counts, so only that many rows are shuffled, however hot a value.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("__n"))
    share = F.least(F.lit(1.0), F.lit(per_value * 1.2 + 20) / F.col("__n"))
    # Stored, so that its size is known when the join is planned.
    limits = stored(counts.select(by, (share * 2.0**64 - 2.0**63).alias("__limit")), "limits")
    rank = F.row_number().over(Window.partitionBy(by).orderBy("draw"))
    return (
        rows.join(limits, by).where(F.col("draw") <= F.col("__limit"))
        .withColumn("__rank", rank).where(F.col("__rank") <= per_value).drop("__rank", "__limit")
    )
