"""Exact-substring dedup: strings that an earlier document holds are cut out of later ones."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import annotate, mix, pieces, ship, stored
from tidemark.llm.suffix_sort import deep_shallow_order
from tidemark.session import shared_dir

#: Text of one batch of documents, at the most that hashing makes likely.
BATCH_BYTES = 32 << 20

#: Windows of one stretch; their verdicts fit a 64-bit mask.
STRETCH = 64

ALL = np.uint64(2**64 - 1)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed hash of the ``size`` bytes from each place."""
    base, n = 0x9E3779B97F4A7C15, len(data)
    power, width = data.astype(np.uint64) + np.uint64(1), 1
    done, covered = np.zeros(n, np.uint64), 0
    while True:
        if size & width:
            done = done[: n - covered - width + 1] * np.uint64(pow(base, width, 2**64)) + power[covered : n - width + 1]
            covered += width
        if width * 2 > size:
            return mix(done)
        power = power[:-width] * np.uint64(pow(base, width, 2**64)) + power[width:]
        width *= 2


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    power = 1
    low = values
    while power * 2 <= width:
        low = np.minimum(low[:-power], low[power:])
        power *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - power :]) if power < width else low


class Stretches:
    """The windows of a few texts, cut where the smallest gram hash in the window changes.

    Equal windows have equal smallest hashes, and where texts agree for long
    they are cut alike. ``anchor`` is that hash; ``begin`` and ``windows`` give
    the first window and their number, ``doc`` the text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> None:
        sizes = np.diff(offsets)
        self.begin = self.windows = self.doc = np.empty(0, np.int64)
        self.anchor = np.empty(0, np.uint64)
        if not (sizes >= length).any():
            return
        low = _sliding_min(_gram_hashes(data, gram), length - gram + 1)
        full = np.flatnonzero(sizes >= length)
        change = np.zeros(len(low) + 1, np.int8)
        change[offsets[full]] += 1
        change[offsets[full] + sizes[full] - length + 1] -= 1
        valid = np.cumsum(change[:-1], dtype=np.int8) > 0
        first = np.ones(len(low), bool)
        first[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
        first[offsets[full]] = True
        marks = np.flatnonzero(first | ~valid)
        ends = np.append(marks[1:], len(low))
        keep = valid[marks]
        marks, ends = marks[keep], ends[keep]
        if (ends - marks > STRETCH).any():
            count = -(-(ends - marks) // STRETCH)
            last = np.repeat(ends, count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            marks = np.repeat(marks, count) + STRETCH * step
            ends = np.minimum(marks + STRETCH, last)
        self.begin, self.windows = marks, ends - marks
        self.anchor = low[marks]
        self.doc = np.searchsorted(offsets, marks, "right") - 1


class Batch:
    """The documents of a batch, in a fixed order, with their stretches."""

    def __init__(self, table: pa.Table, length: int, gram: int, buckets: int) -> None:
        rows = sorted(
            zip(table["doc"].to_pylist(), table["packed"].to_pylist(), range(table.num_rows), strict=True)
        )
        self.ids = [x[0] for x in rows]
        unpack = zstandard.ZstdDecompressor().decompress
        self.texts = [unpack(x[1]) for x in rows]
        self.length, self.buckets = length, buckets
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.texts], dtype=np.int64)]).astype(np.int64)
        parts = []
        for first, last in pieces(offsets):
            data = np.frombuffer(b"".join(self.texts[first:last]), np.uint8)
            own = offsets[first : last + 1] - offsets[first]
            cut = Stretches(data, own, length, gram)
            parts.append((cut.anchor, cut.begin - own[cut.doc], cut.windows, cut.doc + first))
        columns = zip(*parts, strict=True) if parts else [[np.empty(0, np.uint64)], *([np.empty(0, np.int64)],) * 3]
        self.anchor, self.begin, self.windows, self.doc = (np.concatenate(x) for x in columns)
        self.bucket = ((self.anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        self.short = self.anchor.astype(np.uint32)

    def anchors(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By bucket: the different anchors, whether each is in two documents or more, the stretches in order."""
        order = np.lexsort((self.doc, self.short, self.bucket))
        bounds = np.flatnonzero(np.diff(self.bucket[order], prepend=-1, append=self.buckets))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = order[a:b]
            short, doc = self.short[own], self.doc[own]
            first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
            last = np.append(first[1:], len(own)) - 1
            yield int(self.bucket[own[0]]), short[first], doc[first] != doc[last], own

    def shared(self, flags: dict[int, bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """By bucket: the stretches whose anchor other documents hold too, in order of document and place."""
        for bucket, short, _, own in self.anchors():
            if bucket in flags:
                bits = np.unpackbits(np.frombuffer(flags[bucket], np.uint8), count=len(short)).astype(bool)
                yield bucket, np.sort(own[bits[np.searchsorted(short, self.short[own])]])

    def strings(self, stretches: np.ndarray) -> tuple[dict[bytes, int], np.ndarray]:
        """The different strings of stretches, each with its first document, and each stretch's string."""
        found: dict[bytes, int] = {}
        firsts: dict[bytes, int] = {}
        place = np.empty(len(stretches), np.int64)
        columns = (self.doc[stretches], self.begin[stretches], self.windows[stretches] + self.length - 1)
        for k, (doc, begin, size) in enumerate(zip(*(x.tolist() for x in columns), strict=True)):
            string = self.texts[doc][begin : begin + size]
            place[k] = found.setdefault(string, len(found))
            firsts.setdefault(string, self.ids[doc])
        return firsts, place


def _blocks(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.table([pa.array(x, k) for x, (_, k) in zip(columns, kinds, strict=True)], names=[x for x, _ in kinds])


_INT, _BIN = pa.int32(), pa.binary()


def _shared_anchors(blocks: pa.Table) -> pa.Table:
    """For each batch's block of a bucket: bits of the anchors that more than one document holds."""
    parts = [
        (np.frombuffer(a, np.uint32), np.unpackbits(np.frombuffer(b, np.uint8)))
        for a, b in zip(blocks["anchors"].to_pylist(), blocks["twice"].to_pylist(), strict=True)
    ]
    every = np.sort(np.concatenate([x[0] for x in parts]))
    more = [x[0][x[1][: len(x[0])] > 0] for x in parts]
    several = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *more]))
    rows = []
    for batch, bucket, (short, _) in zip(blocks["batch"].to_pylist(), blocks["bucket"].to_pylist(), parts, strict=True):
        at = np.searchsorted(several, short)
        at[at == len(several)] = 0
        bits = several[at] == short if len(several) else np.zeros(len(short), bool)
        if bits.any():
            rows.append((batch, bucket, 0, np.packbits(bits).tobytes()))
    return _blocks(rows, _VERDICTS)


_ANCHORS = [("bucket", _INT), ("batch", _INT), ("anchors", _BIN), ("twice", _BIN)]
_VERDICTS = [("batch", _INT), ("bucket", _INT), ("kind", _INT), ("payload", _BIN)]
_STRINGS = [("bucket", _INT), ("batch", _INT), ("strings", _BIN), ("sizes", _BIN), ("docs", _BIN)]


def _judged(blocks: pa.Table, length: int) -> pa.Table:
    """For each batch's block of a bucket: for each of its strings a mask of windows that are cut.

    All windows if an earlier document than the batch's first holder has the
    string; else, for that first holder, the windows that earlier documents
    have in other strings.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    known: dict[bytes, int] = {}
    first: list[int] = []
    blocks_own = []
    for raw, sizes, docs in zip(*(blocks[x].to_pylist() for x in ("strings", "sizes", "docs")), strict=True):
        raw, own, at = unpack(raw), [], 0
        for size, doc in zip(np.frombuffer(sizes, np.uint8).tolist(), np.frombuffer(docs, np.int64).tolist(), strict=True):
            string = raw[at : at + size]
            at += size
            k = known.setdefault(string, len(known))
            if k == len(first):
                first.append(doc)
            elif doc < first[k]:
                first[k] = doc
            own.append((k, doc))
        blocks_own.append(own)
    text = np.frombuffer(b"".join(known), np.uint8)
    sizes = np.array([len(x) for x in known], np.int64)
    windows = sizes - length + 1
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, new = deep_shallow_order(text, begin[owner] + place, length)
    least = np.array(first, np.int64)
    earliest = np.minimum.reduceat(least[owner[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = order[earliest < least[owner[order]]]
    masks = np.zeros(len(sizes), np.uint64)
    np.bitwise_or.at(masks, owner[hit], np.uint64(1) << place[hit].astype(np.uint64))
    rows = []
    for batch, bucket, own in zip(blocks["batch"].to_pylist(), blocks["bucket"].to_pylist(), blocks_own, strict=True):
        k, doc = (np.array(x, np.int64) for x in zip(*own, strict=True))
        verdict = np.where(least[k] < doc, ALL, masks[k])
        rows.append((batch, bucket, 1, zstandard.compress(verdict.tobytes(), 1)))
    return _blocks(rows, _VERDICTS)


def _cut(own: Batch, flags: dict[int, bytes], masks: dict[int, bytes]) -> list[list[tuple[int, int]]]:
    """The removed runs of bytes of each document."""
    marks: list[list[tuple[int, int]]] = [[] for _ in own.texts]
    for bucket, stretches in own.shared(flags):
        firsts, place = own.strings(stretches)
        holder = list(firsts.values())
        verdict = np.frombuffer(zstandard.ZstdDecompressor().decompress(masks[bucket]), np.uint64).tolist()
        full = int(ALL)
        for k, at in zip(place.tolist(), stretches.tolist(), strict=True):
            doc, begin, windows = int(own.doc[at]), int(own.begin[at]), int(own.windows[at])
            mask = verdict[k] if own.ids[doc] == holder[k] else full
            if mask == full:
                marks[doc].append((begin, begin + windows + own.length - 1))
            elif mask:
                marks[doc] += [(begin + w, begin + w + own.length) for w in range(windows) if mask >> w & 1]
    out = []
    for spans in marks:
        runs: list[list[int]] = []
        for a, b in sorted(spans):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        out.append([(a, b) for a, b in runs])
    return out


def cut_repeats(docs: DataFrame, length: int = 50, gram: int = 20, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, spans (removed runs of bytes: begin, end) and kept (binary) of each row.

    A byte is removed if a string of ``length`` bytes that covers it also
    starts in a document with a smaller id; all strings are those of the input,
    and none crosses documents. A null text is empty. Rows without an id keep
    everything and count for nothing. Rows that share an id are no smaller than
    one another. Ids are long.

    Windows are cut into stretches by the smallest hash of a gram in them, so
    only stretches whose hash another document has are looked at. The strings
    of those meet by hash; a batch of documents sends each different string
    once, so a passage that a third of all documents hold is as many strings
    as there are batches. All windows of a bucket's different strings are
    sorted by deep-shallow sorting, and equal neighbours share the smallest id.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // BATCH_BYTES + 1)
    buckets = min(batches, 4096)

    def pack(batch: pa.RecordBatch) -> list[pa.Array]:
        compress = zstandard.ZstdCompressor(level=1).compress
        return [pa.array([compress(x.as_py() or b"") for x in batch.column("text").cast(pa.binary())], _BIN)]

    name = f"texts_{uuid.uuid4().hex}"
    packed = rows.where("doc IS NOT NULL").withColumn(
        "batch", F.pmod(F.xxhash64("doc", "text"), F.lit(batches)).cast("int")
    )
    (
        annotate(packed, pack, "packed binary", ["batch", "doc"]).repartition(batches, "batch")
        .write.bucketBy(batches, "batch").option("path", shared_dir(spark, "texts")).saveAsTable(name)
    )
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")

    def anchors(table: pa.Table) -> pa.Table:
        batch = table["batch"][0].as_py()
        own = Batch(table, length, gram, buckets)
        return _blocks(
            [(k, batch, a.tobytes(), np.packbits(b).tobytes()) for k, a, b, _ in own.anchors()], _ANCHORS
        )

    verdicts = "batch int, bucket int, kind int, payload binary"
    flags = stored(
        texts.groupBy("batch").applyInArrow(anchors, "bucket int, batch int, anchors binary, twice binary")
        .groupBy("bucket").applyInArrow(_shared_anchors, verdicts),
        "shared-anchors",
    )

    def payloads(table: pa.Table, kind: int) -> dict[int, bytes]:
        columns = (table[x].to_pylist() for x in ("bucket", "kind", "payload"))
        return {a: c for a, b, c in zip(*columns, strict=True) if b == kind}

    def strings(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            batch = left["batch"][0].as_py()
            own = Batch(left, length, gram, buckets)
            for bucket, stretches in own.shared(payloads(right, 0)):
                firsts, _ = own.strings(stretches)
                out.append((
                    bucket, batch, zstandard.compress(b"".join(firsts), 1),
                    np.array([len(x) for x in firsts], np.uint8).tobytes(),
                    np.array(list(firsts.values()), np.int64).tobytes(),
                ))
        return _blocks(out, _STRINGS)

    judged = stored(
        texts.groupBy("batch").cogroup(flags.groupBy("batch"))
        .applyInArrow(strings, "bucket int, batch int, strings binary, sizes binary, docs binary")
        .groupBy("bucket").applyInArrow(lambda x: _judged(x, length), verdicts),
        "judged-strings",
    )
    kinds = [
        (id_col, pa.int64()), ("n_bytes", pa.int64()),
        ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", _BIN),
    ]
    result = f"`{id_col}` long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _blocks([], kinds)
        own = Batch(left, length, gram, buckets)
        out = []
        for doc, text, spans in zip(own.ids, own.texts, _cut(own, payloads(right, 0), payloads(right, 1)), strict=True):
            edges = [0, *(x for span in spans for x in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((doc, len(text), [{"begin": a, "end": b} for a, b in spans], kept))
        return _blocks(out, kinds)

    found = texts.groupBy("batch").cogroup(flags.union(judged).groupBy("batch")).applyInArrow(finish, result)
    unnamed = rows.where("doc IS NULL").select(
        F.col("doc").alias(id_col),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.array().cast("array<struct<begin: long, end: long>>").alias("spans"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"),
    )
    return found.union(unnamed)
