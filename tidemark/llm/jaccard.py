"""Near-duplicate texts: Jaccard join of word shingles with PartEnum signatures."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import Components
from tidemark.llm.frames import NOT_SPACE, annotate, map_arrow, mix, pieces, runs_of, stored, utf8, words

#: Members of one row of the table of groups, and members that one copy of a centre is compared with.
GROUP_ROWS = 4096

#: Members of one block of a group whose pairs are compared, and elements of their sets.
PAIR_ROWS = 1024
PAIR_ELEMENTS = 2_000_000

#: Rounds in which each member of an open group is compared with one candidate only, before all pairs that are left.
#: Their number changes how many pairs are listed, never what is found.
STAR_ROUNDS = 3

#: Sets of one block of signatures.
BLOCK_SETS = 10_000

#: Rows with hashes that a task holds as Python objects at once.
HASH_ROWS = 256

#: Bits for each wanted id, and at most in all, of the map that tells which texts to read again. Their number changes
#: how many texts are read for nothing, never what is found.
BITS_PER_ID = 64
MOST_BITS = 1 << 27

#: An element of this many sets of a block may count as frequent, up to so many elements in all. Which ones do
#: changes only how many comparisons are made, never what is found.
FREQUENT = 4
FREQUENT_ELEMENTS = 500_000


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of ``width`` consecutive words, or of all its words if fewer."""
    data, offsets = utf8(column)
    for first, last in pieces(offsets):
        own = offsets[first : last + 1] - offsets[first]
        begin, _, hashes = words(data[offsets[first] : offsets[last]], own, NOT_SPACE)
        bounds = np.searchsorted(begin, own)
        shingles = runs_of(hashes, width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(shingles[a : b - width + 1])
            else:
                yield mix(runs_of(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else hashes[:0]


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


class Signatures:
    """PartEnum for Jaccard similarity of at least num / den.

    Sizes fall into bands [l, u] with u the largest size that can be similar to
    l. A pair is found in the band of its larger set, so a set takes part in
    its own band and, as the smaller one, in the next. Within a band a set of
    n elements and a larger one of at most m are similar only if they differ
    in at most k = (n + m)(den - num) / (den + num) elements. The feature domain
    is cut into partitions; sets that differ in k elements agree in all but k
    partitions. Of the subsets of partitions that PartEnum enumerates those of
    one partition suffice here: a set signs its first k + 1 non-empty ones, in
    one order for all. Of the k + 1 of either set at least one agrees, and the
    agreeing one that comes first by the shorter of the two lists is on both.
    A set with fewer non-empty partitions signs all of them, and one name that
    all such sets of the band share.

    Any division of the domain serves, so ``frequent`` elements, such as those
    of a passage that many texts share, get partitions of their own that come
    last: most sets sign only partitions of rare elements, on which texts do not
    agree by a passage alone.
    """

    def __init__(self, num: int, den: int, frequent: np.ndarray | None = None) -> None:
        self.num, self.den = num, den
        self.lows: list[int] = [1]
        self.frequent = np.empty(0, np.uint64) if frequent is None else np.sort(frequent)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.frequent >> np.uint64(42)).astype(np.int64)] = True

    def _band(self, size: int) -> int:
        while self._high(len(self.lows) - 1) < size:
            self.lows.append(self._high(len(self.lows) - 1) + 1)
        return bisect.bisect_right(self.lows, size) - 1

    def _high(self, band: int) -> int:
        return max(self.lows[band], self.lows[band] * self.den // self.num)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The 64-bit signatures of a set of sorted hashes."""
        n = len(hashes)
        own, largest = self._band(n), n * self.den // self.num
        hashes, rare = self._rare_first(hashes)
        out = [self._signed(hashes, rare, own, min(self._high(own), largest))]
        if self._band(largest) > own:
            out.append(self._signed(hashes, rare, own + 1, largest))
        return np.concatenate(out)

    def _rare_first(self, hashes: np.ndarray) -> tuple[np.ndarray, int]:
        """The elements, rare ones first, each kind in order; how many are rare."""
        common = self.maybe[(hashes >> np.uint64(42)).astype(np.int64)]
        if common.any():
            at = np.flatnonzero(common)
            found = np.searchsorted(self.frequent, hashes[at])
            found[found == len(self.frequent)] = 0
            common[at] = self.frequent[found] == hashes[at]
            return np.concatenate([hashes[~common], hashes[common]]), int((~common).sum())
        return hashes, len(hashes)

    def _signed(self, hashes: np.ndarray, rare: int, band: int, partner: int) -> np.ndarray:
        low = self.lows[band]
        parts = int(0.45 * low + 1.5 * low**0.5) + 2
        need = (len(hashes) + partner) * (self.den - self.num) // (self.den + self.num) + 1
        place = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        place[rare:] += np.uint64(parts)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        name = np.uint64(band * 0x9E3779B97F4A7C15 % 2**64)
        if len(first) > need:
            hashes, first = hashes[: first[need]], first[:need]
        signed = mix(np.add.reduceat(hashes, first) + name + place[first] * np.uint64(0xD6E8FEB86659FD93))
        return signed if len(first) == need else np.append(signed, mix(np.array([name])))


def _frequent(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Elements that many different sets hold: at least FREQUENT in some block of sets, the most common first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), BLOCK_SETS):
                own = {}
                for hashes in shingle_sets(batch.column(text_col).slice(begin, BLOCK_SETS), width):
                    if len(hashes):
                        own.setdefault(set_id(hashes), hashes)
                every = np.concatenate([np.empty(0, np.uint64), *own.values()])
                own.clear()
                every.sort()
                # Only elements that come FREQUENT times in a row are looked at again.
                last = FREQUENT - 1
                found = np.unique(every[last:][every[last:] == every[: len(every) - last]])
                counts = np.searchsorted(every, found, "right") - np.searchsorted(every, found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["element", "n"]
                )

    counts = map_arrow(docs.select(text_col), run, "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))
    chosen = counts.orderBy(F.desc("n"), "element").limit(FREQUENT_ELEMENTS).select("element").toArrow()
    return chosen["element"].to_numpy().astype(np.int64).view(np.uint64)


def _sign(docs: DataFrame, text_col: str, width: int, signatures: Signatures, buckets: int) -> DataFrame:
    """Blocks of signatures: bucket, 32-bit signatures, the place of each one's set among ``sets``."""
    shared = docs.sparkSession.sparkContext.broadcast(signatures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = shared.value
        for batch in batches:
            for begin in range(0, len(batch), BLOCK_SETS):
                names: dict[int, int] = {}
                signed = []
                for hashes in shingle_sets(batch.column(text_col).slice(begin, BLOCK_SETS), width):
                    if len(hashes) and (name := set_id(hashes)) not in names:
                        names[name] = len(names)
                        signed.append(signatures.of(hashes))
                if signed:
                    yield _blocks(np.array(list(names), np.int64), signed, buckets)

    return map_arrow(docs.select(text_col), run, "bucket int, signed binary, places binary, sets binary")


def _blocks(names: np.ndarray, signed: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    every = np.concatenate(signed)
    place = np.repeat(np.arange(len(signed), dtype=np.uint16), [len(x) for x in signed])
    bucket = ((every >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, place, short = bucket[order], place[order], every[order].astype(np.uint32)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        used, local = np.unique(place[a:b], return_inverse=True)
        rows.append((int(bucket[a]), short[a:b].tobytes(), local.astype(np.uint16).tobytes(), names[used].tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(x, y) for x, y in zip(zip(*rows, strict=True), kinds, strict=True)],
        ["bucket", "signed", "places", "sets"],
    )


def _groups(blocks: DataFrame) -> DataFrame:
    """Sets that share a signature: name of the group, its smallest set, up to GROUP_ROWS members a row."""

    def run(table: pa.Table) -> pa.Table:
        parts = [
            (np.frombuffer(a, np.uint32), np.frombuffer(c, np.int64)[np.frombuffer(b, np.uint16)])
            for a, b, c in zip(*(table[x].to_pylist() for x in ("signed", "places", "sets")), strict=True)
        ]
        signed, sets = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(signed, kind="stable")
        signed, sets = signed[order], sets[order]
        same = signed[1:] == signed[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        signed, sets = signed[shared], sets[shared]
        order = np.lexsort((sets, signed))
        signed, sets = signed[order], sets[order]
        new = np.concatenate([[True], (signed[1:] != signed[:-1]) | (sets[1:] != sets[:-1])])[: len(sets)]
        signed, sets = signed[new], sets[new]
        first = np.flatnonzero(np.concatenate([[True], signed[1:] != signed[:-1]])[: len(signed)])
        sizes = np.diff(first, append=len(signed))
        names = np.add.reduceat(mix(sets.view(np.uint64)), first) if len(first) else first.astype(np.uint64)
        keep = np.zeros(len(first), bool)
        keep[np.unique(names, return_index=True)[1]] = True
        out: list[tuple[int, int, np.ndarray]] = []
        for k in np.flatnonzero(keep & (sizes > 1)).tolist():
            a, b = int(first[k]), int(first[k] + sizes[k])
            name, centre = int(names[k].view(np.int64)), int(sets[a])
            out += [(name, centre, sets[x : min(x + GROUP_ROWS, b)]) for x in range(a, b, GROUP_ROWS)]
        bounds = np.concatenate([[0], np.cumsum([len(x[2]) for x in out])]).astype(np.int32)
        members = np.concatenate([np.empty(0, np.int64), *(x[2] for x in out)])
        return pa.table(
            [
                pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(members)),
            ],
            names=["name", "centre", "members"],
        )

    return blocks.groupBy("bucket").applyInArrow(run, "name long, centre long, members array<long>")


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, len(batch), HASH_ROWS):
            yield batch.slice(begin, HASH_ROWS)


def _roles(best: DataFrame) -> DataFrame:
    """For (set, centre): each set's centre and its number of copies (own_salts), and copies of the set as a centre (salts)."""
    salts = best.groupBy("centre").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("salts"))
    return (
        best.join(salts.withColumnRenamed("salts", "own_salts"), "centre")
        .join(salts.withColumnRenamed("centre", "set"), "set", "full")
    )


def _links_to_centres(sets: DataFrame, value: str, similar: Callable[[bytes, int, bytes, int], bool]) -> DataFrame:
    """(a, b): each set with the centre chosen for it, if ``similar`` says so of their values and sizes.

    A centre goes, in as many copies as its members fill tasks, to its members.
    """
    roles = F.concat(
        F.when(F.col("centre").isNotNull(), F.array(F.struct(
            F.col("centre").alias("at"),
            F.pmod(F.xxhash64("set"), F.col("own_salts")).alias("salt"),
            F.lit(1).alias("member"),
        ))).otherwise(F.array()),
        F.transform(
            F.when(F.col("salts") > 0, F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(F.array()),
            lambda x: F.struct(F.col("set").alias("at"), x.alias("salt"), F.lit(0).alias("member")),
        ),
    )
    rows = (
        sets.select("set", "size", F.col(value).alias("value"), F.explode(roles).alias("role"))
        .select("role.*", "set", "size", "value")
        .repartition("at", "salt").sortWithinPartitions("at", "salt", "member")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, head = None, None
        for batch in _sliced(batches):
            found: list[tuple[int, int]] = []
            columns = (batch.column(x).to_pylist() for x in ("at", "member", "set", "value", "size"))
            for at, member, name, *own in zip(*columns, strict=True):
                if not member:
                    centre, head = at, own
                elif at == centre and similar(*head, *own):
                    found.append((at, name))
            yield _edges(found)

    return map_arrow(rows, run, "a long, b long")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"]
    )


def sketch(hashes: np.ndarray) -> bytes:
    """For each residue of the hashes whether an odd number of elements has it, as bits.

    Two sets differ in at least as many elements as their sketches in bits. The
    number of bits is a power of two, and the halves of a sketch, xored, are the
    sketch of half the size.
    """
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width // 8), np.uint64)
    for k, raw in enumerate(sketches):
        words = np.frombuffer(raw, np.uint64)
        while len(words) * 8 > width:
            half = len(words) // 2
            words = words[:half] ^ words[half:]
        out[k] = words
    return out


def _may_be_similar(a: bytes, size_a: int, b: bytes, size_b: int, num: int, den: int) -> bool:
    """Whether sizes and sketches of two sets allow them to be similar."""
    if num * max(size_a, size_b) > den * min(size_a, size_b):
        return False
    x, y = _folded([a, b])
    return int(np.bitwise_count(x ^ y).sum()) <= (size_a + size_b) * (den - num) // (den + num)


def _dealt(listed: DataFrame) -> DataFrame:
    """The members of each group, dealt over tasks that compare two blocks of about PAIR_ROWS or PAIR_ELEMENTS at most."""
    sizes = listed.groupBy("name").agg(
        F.ceil(F.greatest(F.count("*") / PAIR_ROWS, F.sum("size") / PAIR_ELEMENTS)).alias("blocks")
    )
    own = F.pmod(F.xxhash64("set"), F.col("blocks"))
    return (
        listed.join(sizes, "name")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "name", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
            *(x for x in listed.columns if x != "name"),
        )
        .repartition("name", "i", "j").sortWithinPartitions("name", "i", "j")
    )


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each key (name, i, j), one key after the other."""
    key, members = None, []
    for batch in _sliced(batches):
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if row[:3] != key:
                if len(members) > 1:
                    yield members
                key, members = row[:3], []
            members.append(row)
    if len(members) > 1:
        yield members


def _candidates(listed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): members of one group in different components that sizes and sketches allow to be similar.

    If the members bring their hashes, the pairs are compared, and those that are similar and join parts of a block
    that no pair before them joined are given: fewer rows than members, however many pairs a block has.
    """
    exact = "hashes" in listed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _blocks_of(batches):
            sets, a, b = _close(members, num, den)
            if exact:
                joining = _joining(members, a.tolist(), b.tolist(), num, den)
                a, b = a[joining], b[joining]
            yield _edges(list(zip(sets[a].tolist(), sets[b].tolist(), strict=True)))

    order = ["name", "set", "component", "size", "sketch", *(["hashes"] if exact else [])]
    return map_arrow(_dealt(listed.select(order)), run, "a long, b long").distinct()


def _joining(members: list[tuple], a: list[int], b: list[int], num: int, den: int) -> list[int]:
    """The places of pairs of members that are similar and join what similar pairs before them left apart."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        left, right = find(members[x][5]), find(members[y][5])
        if left != right and _similar(*(np.frombuffer(members[z][8], np.uint64) for z in (x, y)), num, den):
            parent[left] = right
            out.append(k)
    return out


def _stars(listed: DataFrame, num: int, den: int) -> DataFrame:
    """(name, a, b): for each member that has candidates in its block, the one of them with the most, b.

    At most one row for each member of a block, so their number follows that of the members. A member without a
    row has no candidate in that block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _blocks_of(batches):
            sets, a, b = _close(members, num, den)
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            degree = np.bincount(a, minlength=len(sets))
            order = np.lexsort((sets[b], -degree[b], a))
            first = order[np.unique(a[order], return_index=True)[1]]
            columns = (np.full(len(first), members[0][0], np.int64), sets[a[first]], sets[b[first]])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["name", "a", "b"])

    return map_arrow(_dealt(listed), run, "name long, a long, b long")


def _close(members: list[tuple], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of a block, and the places of the pairs that may be similar, the smaller set first."""
    _, i, j, own, sets, components, sizes, sketches, *_ = zip(*members, strict=True)
    own, sets, components, sizes = (np.array(x, np.int64) for x in (own, sets, components, sizes))
    bits = _folded(list(sketches))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, (1 << 20) // bits.size)
    for first in range(0, len(sets), step):
        part = slice(first, first + step)
        most = (sizes[part, None] + sizes[None]) * (den - num) // (den + num)
        fits = (components[part, None] != components[None]) & (sets[part, None] < sets[None])
        fits &= sizes[part, None] * num <= sizes[None] * den
        fits &= sizes[None] * num <= sizes[part, None] * den
        if i[0] != j[0]:
            fits &= own[part, None] != own[None]
        a, b = np.nonzero(fits)
        if len(a):
            differ = np.bitwise_count(bits[part][a] ^ bits[b]).sum(1, dtype=np.int64)
            near = differ <= most[a, b]
            left.append(first + a[near])
            right.append(b[near])
    return sets, np.concatenate(left), np.concatenate(right)


def _links_of_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    needed = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    small = stored(sets.select("set", "hashes").join(needed, "set"), "sets")
    for side in ("a", "b"):
        pairs = pairs.join(small.select(F.col("set").alias(side), F.col("hashes").alias(f"hashes_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            rows = zip(*(batch.column(x).to_pylist() for x in ("a", "b", "hashes_a", "hashes_b")), strict=True)
            yield _edges([
                (a, b) for a, b, x, y in rows
                if _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den)
            ])

    return map_arrow(pairs.select("a", "b", "hashes_a", "hashes_b"), run, "a long, b long")


def _bit(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def _marked(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for each remainder of an id's hash, by their number a power of two: set if one of ``ids`` has it."""
    n = ids.count()
    bits = min(max(1 << (BITS_PER_ID * n).bit_length(), 1 << 15), MOST_BITS)
    at = ids.select(_bit(F.col(column), bits).alias("at"))
    maps = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % (1 << 15)).alias("bits"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for row in maps.toArrow().to_pylist():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5, id_col: str = "doc_id",
                    text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, ``keep``, n_shingles and component_id of each row: the smallest id reachable by links.

    A text's set has its distinct runs of ``width`` words (by white space, A-Z
    lower-cased), or all its words as one run if fewer. Two texts link if
    den * intersection >= num * union. Null and empty texts, and those without
    words, have empty sets: they link with nothing and are their own component.
    Rows without an id are counted, but link with nothing and have a null
    component. Rows that share an id are compared each by its own text.

    Equal sets are one from the start. Sets that share a signature form groups.
    First each set is compared with one centre, the smallest of the group that
    most of its signatures lead to. Where a group then still has members of
    different components, sizes and sketches name the pairs of different
    components that may be similar. In some rounds each member is compared with
    one of its candidates only, the one that has the most candidates itself, so
    families of copies grow together around their most central texts; members
    without a candidate are done. All pairs that are left are compared at the
    end. So no link is lost, and groups of copies that are similar to one
    another cost a few comparisons for each member.
    """
    spark = docs.sparkSession
    kept = [id_col, *(keep or [])]
    rows = docs.select(*kept, text_col)
    named = rows.where(F.col(id_col).isNotNull())

    def measure(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, names, sketches = [], [], []
        for hashes in shingle_sets(batch.column(text_col), width):
            sizes.append(len(hashes))
            names.append(set_id(hashes) if len(hashes) else None)
            sketches.append(sketch(hashes) if len(hashes) else None)
        return [pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, pa.binary())]

    members = stored(annotate(rows, measure, "n_shingles long, set long, __sketch binary", kept), "members")
    classes = members.where(F.col(id_col).isNotNull() & F.col("set").isNotNull()).groupBy("set").agg(
        F.min(id_col).alias("doc"))

    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    signatures = Signatures(num, den, _frequent(named, text_col, width))
    groups = stored(_groups(_sign(named, text_col, width, signatures, buckets)), "groups")
    pairs = stored(
        groups.select("centre", F.explode("members").alias("set")).where("set <> centre")
        .groupBy("set", "centre").agg(F.count("*").alias("n")),
        "pairs",
    )
    best = pairs.groupBy("set").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("centre"))
    heads = stored(_roles(best).join(classes, "set").withColumnRenamed("set", "expected"), "heads")

    def hashed(names: DataFrame) -> DataFrame:
        """The columns of ``names``, and size and hashes of each set.

        Only texts whose id has its bit set are read again, and only their sets are shuffled: texts are many times
        as many as the sets that are wanted.
        """
        wanted = stored(heads.select("expected", "doc").join(names.withColumnRenamed("set", "expected"), "expected"), "wanted")
        marked = _marked(wanted, "doc")
        shared = spark.sparkContext.broadcast(marked)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            for batch in batches:
                at = batch.column("at").to_numpy()
                kept = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                for begin in range(0, len(kept), HASH_ROWS):
                    part = batch.take(pa.array(kept[begin : begin + HASH_ROWS]))
                    sets = list(shingle_sets(part.column("text"), width))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc"), pa.array([set_id(x) if len(x) else None for x in sets], pa.int64()),
                            pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()),
                        ],
                        ["doc", "set", "size", "hashes"],
                    )

        own = named.select(
            F.col(id_col).alias("doc"), F.col(text_col).alias("text"), _bit(F.col(id_col), 8 * len(marked)).alias("at"))
        schema = T.StructType([wanted.schema["doc"], *T.StructType.fromDDL("set long, size long, hashes binary").fields])
        found = map_arrow(own, build, schema).join(wanted.withColumnRenamed("expected", "set"), ["doc", "set"])
        return stored(found.dropDuplicates(["doc", "set"]).drop("doc"), "sets")

    # Sketches go first: most sets that share a signature are not similar, and hashes are many times as long.
    sketches = members.select(
        F.col(id_col).alias("doc"), F.col("set").alias("expected"), F.col("n_shingles").alias("size"),
        F.col("__sketch").alias("sketch"),
    )
    traits = sketches.join(heads, ["doc", "expected"]).dropDuplicates(["doc", "expected"])
    traits = stored(traits.drop("doc").withColumnRenamed("expected", "set"), "sketches")
    close = stored(_links_to_centres(traits, "sketch", lambda *x: _may_be_similar(*x, num, den)), "close")
    exact = hashed(_roles(close.select(F.col("b").alias("set"), F.col("a").alias("centre"))))
    links = stored(_links_to_centres(
        exact, "hashes", lambda a, _, b, __: _similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), num, den)
    ), "links")
    near = Components(links)

    apart = near.label(near.label(pairs.select("set", "centre", F.col("set").alias("x"), F.col("centre").alias("y")), "x"), "y")
    apart = stored(apart.where("x <> y").select("centre", "set"), "apart")
    merged: list[Components] = []
    if not apart.isEmpty():
        # Groups of one centre are one: texts of a family are in dozens of them, but have few centres.
        centres = stored(apart.select("centre").distinct(), "open")
        listed = pairs.join(centres, "centre").select(F.col("centre").alias("name"), "set").union(
            centres.select(F.col("centre").alias("name"), F.col("centre").alias("set")))
        traits = traits.select("set", "size", "sketch")
        sets = None

        def labelled() -> DataFrame:
            frame = near.label(listed.withColumn("component", F.col("set")), "component")
            for step in merged:
                frame = step.label(frame, "component")
            return frame.join(traits, "set")

        def contracted(edges: DataFrame) -> Components:
            for step in [near, *merged]:
                edges = step.label(step.label(edges, "a"), "b")
            return Components(edges)

        for _ in range(STAR_ROUNDS):
            stars = stored(_stars(labelled(), num, den), "stars")
            listed = stars.select("name", F.col("a").alias("set")).distinct()
            once = stored(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "once")
            if once.isEmpty():
                break
            # Later rounds have no other members than the first.
            sets = sets or hashed(listed.select("set").distinct())
            merged.append(contracted(_links_of_pairs(once, sets, num, den)))
        else:
            sets = sets or hashed(listed.select("set").distinct())
            crossing = stored(_candidates(labelled().join(sets.select("set", "hashes"), "set"), num, den), "crossing")
            merged.append(contracted(crossing))
    found = near.label(classes.withColumn("component", F.col("set")), "component")
    for step in merged:
        found = step.label(found, "component")
    found = stored(found, "labels")
    smallest = stored(found.groupBy("component").agg(F.min("doc").alias("component_id")), "smallest")
    labels = found.join(smallest, "component").select("set", "component_id")
    labels = stored(labels, "components")
    known = F.when(F.col(id_col).isNotNull(), F.coalesce("component_id", id_col))
    return members.join(labels, "set", "left").select(*kept, "n_shingles", known.alias("component_id"))
