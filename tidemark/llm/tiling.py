"""Benchmark passages in documents, found by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import alnum_words, annotate, map_arrow, pieces, runs_of, utf8

#: Benchmark text that is held in memory, and sent to the executors, at a time.
BLOCK_BYTES = 16 << 20

_MODULUS = (1 << 61) - 1
_BASE = 1_000_003


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Running Karp-Rabin greedy string tiling: (place in pattern, place in text, length), longest first.

    Windows of the search length are hashed over unmarked stretches of the
    text and looked up from unmarked stretches of the pattern. Matches are
    extended as far as both sides are unmarked; one of more than twice the
    search length starts the search again with its length. The longest are
    marked first; what a mark leaves of a match waits its turn by its length, or
    for the pass of its length. Then the search length shrinks down to ``least``.
    """
    marked_p, marked_t = [False] * len(pattern), [False] * len(text)
    found, length = [], max(least, min(20, len(pattern)))
    while True:
        longest, matches = length, []
        table: dict[int, list[int]] = {}
        for at, value in _windows(text, marked_t, length):
            table.setdefault(value, []).append(at)
        for p, value in _windows(pattern, marked_p, length):
            for t in table.get(value, ()):
                n = 0
                while (
                    p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n]
                    and not marked_p[p + n] and not marked_t[t + n]
                ):
                    n += 1
                if n >= length:
                    longest = max(longest, n)
                    matches.append((n, p, t))
                if longest > 2 * length:
                    break
            if longest > 2 * length:
                break
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-n, p, t) for n, p, t in matches]
        heapq.heapify(queue)
        while queue:
            n, p, t = heapq.heappop(queue)
            rest = _free(marked_p[p : p - n], marked_t[t : t - n])
            if rest == [(0, -n)]:
                marked_p[p : p - n] = marked_t[t : t - n] = [True] * -n
                found.append((p, t, -n))
                continue
            for first, size in rest:
                if size >= length:
                    heapq.heappush(queue, (-size, p + first, t + first))
        if length == least:
            return found
        length = max(least, length // 2 if length > 2 * least else least)


def _free(marked_p: list[bool], marked_t: list[bool]) -> list[tuple[int, int]]:
    """Where neither side of a match is marked: (begin, length) of each stretch."""
    out, first = [], 0
    for k, marked in enumerate([*map(or_, marked_p, marked_t), True]):
        if marked:
            if k > first:
                out.append((first, k - first))
            first = k + 1
    return out


def _windows(tokens: list[int], marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Where each unmarked window of ``length`` tokens begins, with its rolling hash."""
    lead, value, run = pow(_BASE, length - 1, _MODULUS), 0, 0
    for k, token in enumerate(tokens):
        if marked[k]:
            value = run = 0
            continue
        if run == length:
            value -= tokens[k - length] * lead
            run -= 1
        value = (value * _BASE + token) % _MODULUS
        run += 1
        if run == length:
            yield k - length + 1, value


class Seeds:
    """An index of the seeds of some items, the runs of ``length`` tokens."""

    def __init__(self, items: dict[int, np.ndarray], length: int) -> None:
        self.length = length
        seeds = [runs_of(x, length) for x in items.values()]
        every = np.concatenate(seeds)
        item = np.repeat(np.array(list(items)), [len(x) for x in seeds])
        place = np.concatenate([np.arange(len(x)) for x in seeds])
        order = np.argsort(every, kind="stable")
        self.seeds = np.unique(every)
        first = np.searchsorted(every[order], self.seeds)
        self.first, self.ends = first.tolist(), np.append(first[1:], len(every)).tolist()
        self.item, self.place = item[order].tolist(), place[order].tolist()
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, begin: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[int], set[int]]]:
        """For each text and item that share a seed: text, item, the words where seeds begin, places in the item."""
        seeds = runs_of(hashes, self.length)
        if len(seeds) == 0:
            return
        at = np.flatnonzero(self.maybe[(seeds >> np.uint64(44)).astype(np.int64)])
        seed = np.searchsorted(self.seeds, seeds[at])
        seed[seed == len(self.seeds)] = 0
        real = self.seeds[seed] == seeds[at]
        at, seed = at[real], seed[real]
        doc = np.searchsorted(offsets, begin[at], "right") - 1
        inside = begin[at + self.length - 1] < offsets[doc + 1]
        at, seed, doc = at[inside], seed[inside], doc[inside]
        bounds = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            hits: dict[int, tuple[list[int], set[int]]] = {}
            for word, s in zip(at[a:b].tolist(), seed[a:b].tolist(), strict=True):
                for k in range(self.first[s], self.ends[s]):
                    where, covered = hits.setdefault(self.item[k], ([], set()))
                    where.append(word)
                    covered.add(self.place[k])
            for item, (where, covered) in sorted(hits.items()):
                yield int(doc[a]), item, where, covered


class Benchmark:
    """The items of a block: tokens, and indexes of their seeds; an item of less than ``least`` tokens is one seed."""

    def __init__(self, items: list[tuple[object, str | None]], least: int, threshold: float) -> None:
        self.threshold = threshold
        self.ids = [x for x, _ in items]
        raw = [(x or "").encode() for _, x in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        begin, _, hashes = alnum_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        bounds = np.searchsorted(begin, offsets)
        own = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.tokens = [x.tolist() for x in own]
        self.seeds = []
        for length in range(1, least + 1):
            some = {k: x for k, x in enumerate(own) if min(len(x), least) == length}
            if some:
                self.seeds.append(Seeds(some, length))

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
        """For each text and item over the threshold: text, item, tokens covered, byte spans in the text."""
        if not self.seeds:
            return
        begin, end, hashes = alnum_words(data, offsets)
        for seeds in self.seeds:
            least = seeds.length
            for doc, item, where, covered in seeds.hits(begin, hashes, offsets):
                size = len(self.tokens[item])
                if _covered(covered, least) < self.threshold * size:
                    continue
                start, places = int(offsets[doc]), _stretches(where, least)
                text = [-k if w is None else int(hashes[w]) for k, w in enumerate(places, 1)]
                found = tiles(self.tokens[item], text, least)
                total = sum(n for _, _, n in found)
                if total >= self.threshold * size:
                    spans = sorted((int(begin[places[t]]) - start, int(end[places[t + n - 1]]) - start) for _, t, n in found)
                    yield doc, item, total, spans


def _covered(starts: set[int], length: int) -> int:
    """How many places windows of ``length`` cover: no tiling can cover more."""
    total, free = 0, 0
    for x in sorted(starts):
        total += x + length - max(x, free)
        free = x + length
    return total


def _stretches(starts: list[int], length: int) -> list[int | None]:
    """The places that windows cover, in order, with None between stretches."""
    out: list[int | None] = []
    free = starts[0]
    for x in starts:
        if x > free:
            out.append(None)
        out += range(max(x, free), x + length)
        free = max(free, x + length)
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, least: int, threshold: float) -> Iterator[Benchmark]:
    """The benchmark in blocks of about BLOCK_BYTES at most, by hash, so that any size fits."""
    size = F.octet_length(F.coalesce(text_col, F.lit("")))
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    count = 1 + int(total) // (BLOCK_BYTES // 2)
    block = F.pmod(F.xxhash64(item_col, text_col), F.lit(count))
    for k in range(count):
        rows = benchmark.where(block == k).select(item_col, text_col).collect()
        yield Benchmark([(x[0], x[1]) for x in rows], least, threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 4,
               id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item whose tokens it covers to ``threshold``.

    Returns id_col, item_col, n_tokens (of the item), n_matched, coverage and
    spans (bytes of the document, each a tile). Tokens are runs of Unicode
    letters, marks and digits, A-Z lower-cased, and single characters of scripts
    without spaces; a tile has ``least`` tokens or more, so tiles may come in any
    order. Items with fewer tokens match whole. Items without tokens never match,
    nor do null or empty texts. Rows that share an id are judged
    one by one.
    """
    schema = T.StructType([docs.schema[id_col], benchmark.schema[item_col]] + T.StructType.fromDDL(
        "n_tokens long, n_matched long, coverage double, spans array<struct<begin: long, end: long>>"
    ).fields)
    spark = docs.sparkSession
    item_type = pa.string() if schema[1].dataType == T.StringType() else None
    found = []
    for block in _blocks(benchmark, item_col, text_col, least, threshold):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                data, offsets = utf8(batch.column(text_col))
                for first, last in pieces(offsets):
                    part = offsets[first : last + 1] - offsets[first]
                    rows = list(own.leaks(data[offsets[first] : offsets[last]], part))
                    if not rows:
                        continue
                    sizes = [len(own.tokens[x[1]]) for x in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(id_col).take(pa.array([first + x[0] for x in rows])),
                            pa.array([own.ids[x[1]] for x in rows], item_type),
                            pa.array(sizes, pa.int64()),
                            pa.array([x[2] for x in rows], pa.int64()),
                            pa.array([x[2] / n for x, n in zip(rows, sizes, strict=True)], pa.float64()),
                            pa.array(
                                [[{"begin": a, "end": b} for a, b in x[3]] for x in rows],
                                pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])),
                            ),
                        ],
                        schema.names,
                    )

        found.append(map_arrow(docs.select(id_col, text_col), run, schema))
    return reduce(DataFrame.union, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 4,
               item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The documents that cover no benchmark item, judged as by ``find_leaks``; all columns stay."""
    spark, columns = docs.sparkSession, docs.columns
    flag = "__leaked"
    for block in _blocks(benchmark, item_col, text_col, least, threshold):
        shared = spark.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> list[pa.Array]:
            data, offsets = utf8(batch.column(text_col))
            leaked = np.zeros(len(batch), bool)
            for first, last in pieces(offsets):
                part = offsets[first : last + 1] - offsets[first]
                for x in shared.value.leaks(data[offsets[first] : offsets[last]], part):
                    leaked[first + x[0]] = True
            return [pa.array(leaked)]

        docs = annotate(docs, run, f"{flag} boolean").where(~F.col(flag)).drop(flag)
    return docs.select(*(F.col(f"`{c}`") for c in columns))
