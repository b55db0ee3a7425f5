"""Token ids in Parquet list columns, in document order, with chosen encodings, row groups and pages."""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import annotate, map_arrow

#: Entries at which a cache of a Python worker is cut down. Bounds memory, never results.
CACHE_ENTRIES = 500_000

#: Longer words are not kept from block to block; a full cache keeps words up to the second length.
_LONGEST, _SHORT = 16, 6

#: Words of a long text that are encoded at once.
_STEP = 500_000

#: Bytes of text that make one batch of rows.
BLOCK_BYTES = 4 << 20

#: Printable characters before this one are Latin letters, digits and marks: composed already, and
#: lower-cased one by one.
_AFTER_LATIN = "\u0250"

#: Bytes from this one on begin characters of _AFTER_LATIN and the few before it.
_HIGH = 0xC9

#: The pattern of the tokenizer's file.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow after 255.

    The space is left out: it stands between parts, which hold none.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: 256 + k for k, b in enumerate(others) if b != 32}


#: True for ASCII letters (lower-case) and digits, and for marks that end them: all but the apostrophe, which
#: may begin a part of letters.
_LETTER = np.array([chr(b).isalnum() and not chr(b).isupper() and b < 128 for b in range(256)])
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])


def _spaced(low: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts in a row with a space before each mark that follows a letter, and their new offsets."""
    data = np.frombuffer(low, np.uint8)
    at = np.flatnonzero(_MARK[data])
    one, two = data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    # Two bytes: all from U+00C0 on are letters but the signs for times and divided by; U+0130 lower-cased ends in a dot above.
    latin = (one >= 0x80) & (two >= 0xC3) & (two < _HIGH)
    latin &= ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7)) | (two == 0xC4) & (one == 0xB0))
    at = at[_LETTER[one] | latin]
    out = np.full(len(data) + len(at), 32, np.uint8)
    own = np.ones(len(out), bool)
    own[at + np.arange(len(at))] = False
    out[own] = data
    # A mark that begins a text belongs to it, and so does the space before it.
    return out.tobytes(), offsets + np.searchsorted(at, offsets)


class WordEncoder:
    """A tokenizer of the tokenizers library, each distinct word of a block once.

    The library's pattern never crosses ASCII white space and drops it, so the
    ids of a text are those of its words one after the other. It never crosses
    from a letter to a mark either and lower-cases, so texts of Latin characters
    are lower-cased and get a space there first: then a word is one word in any
    case and before any mark. Words of plain
    Latin characters are lower-cased and split here, and their new parts go
    through the library's merges in one call: the last token of a part, and no
    other, ends in the model's suffix, so the ids of all parts can be told
    apart. All other words go through the whole library,
    with ``special_tokens`` also those that hold the text of an added token:
    then that text is the token, as by the library's default, else plain text.
    """

    def __init__(self, path: str, special_tokens: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_tokens
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        with open(path, "rb") as file:
            parts = json.load(file)
        added = [x["content"] for x in parts["added_tokens"]] if special_tokens else []
        self.added = regex.compile("|".join(map(regex.escape, added)), regex.I).search if added else None
        steps = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern") for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        suffix = parts["model"].get("end_of_word_suffix")
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and {"Regex": _PATTERN} in splits and suffix == "</w>"
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for x, k in vocabulary.items() if suffix and x.endswith(suffix)]] = True
        self.split = regex.compile(rf"{_PATTERN}|\n").findall
        self.tokens = [x.encode().lower() for x in added]
        self.latin = self.plain and "".join(added).isascii()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _merge(self, parts: list[str]) -> list[bytes]:
        """The ids of plain parts, lower-case and without white space, those of ASCII characters first."""
        text = " ".join(itertools.takewhile(str.isascii, parts))
        other = " ".join(itertools.dropwhile(str.isascii, parts)).encode().decode("latin-1").translate(self.letters)
        (found,) = self.merges.encode_batch_fast([f"{text} {other}"], add_special_tokens=False)
        ids = np.array(found.ids, "<i4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, words: list[bytes]) -> None:
        """Put the ids of new words into ``words``.

        Lists of texts and numbers only: the garbage collector would walk through nested ones again and again.
        """
        joined = b"\n".join(words).decode()
        added = self.added if self.added and self.added(joined) else None
        letters, lowered, mixed, split, whole, left = [], [], [], [], [], []
        for word, text, low in zip(words, joined.split("\n"), joined.lower().split("\n"), strict=True):
            plain = self.plain and text.isprintable() and (text.isascii() or max(text) < _AFTER_LATIN)
            if not plain or (added and added(text)):
                whole.append(word)
                left.append(text)
            elif low.isalpha():
                letters.append(word)
                lowered.append(low)
            else:
                mixed.append(word)
                split.append(low)
        # The parts of all mixed words in a row, each word's followed by a line break.
        flat = self.split("\n".join([*split, ""]))
        several = set(flat).difference(("\n",))
        needed = several.union(lowered)
        parts = sorted(needed.difference(self.parts), key=str.isascii, reverse=True)
        own = {x: self.parts[x] for x in needed.intersection(self.parts)}
        own.update(zip(parts, self._merge(parts), strict=True))
        known = own.__getitem__
        self.words.update(zip(letters, map(known, lowered), strict=True))
        begin = 0
        for word, end in zip(mixed, [k for k, x in enumerate(flat) if x == "\n"], strict=True):
            self.words[word] = b"".join(map(known, flat[begin:end]))
            begin = end + 1
        # A word of letters is kept as a word.
        self.parts.update((x, own[x]) for x in several if len(x) <= _LONGEST)
        found = self.tokenizer.encode_batch_fast(left, add_special_tokens=False)
        for word, ids in zip(whole, found, strict=True):
            self.words[word] = np.array(ids.ids, "<i4").tobytes()

    def _split(self, texts: list[bytes]) -> list[list[bytes]]:
        """The words of texts: those of Latin texts lower-cased and without marks behind letters.

        Texts with other characters or an added token are split at white space alone.
        """
        if not self.latin:
            return [x.split() for x in texts]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in texts], out=offsets[1:])
        low = b"".join(texts).lower()
        high = np.flatnonzero(np.frombuffer(low, np.uint8) >= _HIGH)
        other = set((np.searchsorted(offsets, high, "right") - 1).tolist())
        if any(x in low for x in self.tokens):
            other.update(k for k, x in enumerate(texts) if any(y in x.lower() for y in self.tokens))
        raw, bounds = _spaced(low, offsets)
        places = itertools.pairwise(bounds.tolist())
        return [texts[k].split() if k in other else raw[a:b].split() for k, (a, b) in enumerate(places)]

    def _ids(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of texts given as words. Caches are bounded between calls: long words go, then all but short ones."""
        new = list(set().union(*texts).difference(self.words))
        if new:
            self._learn(new)
        known = self.words.__getitem__
        found = [b"".join(map(known, x)) for x in texts]
        for word in new:
            if len(word) > _LONGEST:
                del self.words[word]
        for cache in (self.words, self.parts):
            if len(cache) >= CACHE_ENTRIES:
                short = {k: v for k, v in cache.items() if len(k) <= _SHORT}
                cache.clear()
                if len(short) < CACHE_ENTRIES // 2:
                    cache.update(short)
        return found

    def encode(self, text: bytes, tail: bytes = b"") -> bytes:
        """Ids as little-endian 32-bit integers, followed by ``tail``; a long text in steps."""
        words = text.split()
        steps = range(0, len(words), _STEP)
        return b"".join([x for k in steps for x in self._ids([words[k : k + _STEP]])]) + tail

    def encode_all(self, texts: list[bytes], tail: bytes = b"") -> list[bytes]:
        """``encode`` of each text; distinct words of all texts that are not long are encoded once."""
        short = iter(self._ids(self._split([x for x in texts if len(x) < BLOCK_BYTES])))
        return [next(short) + tail if len(x) < BLOCK_BYTES else self.encode(x, tail) for x in texts]


@functools.lru_cache(maxsize=2)
def _encoder(path: str, special_tokens: bool) -> WordEncoder:
    return WordEncoder(path, special_tokens)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 32 << 20,
                 page_bytes: int = 256 << 10, special_tokens: bool = False) -> None:
    """Write the ids of all texts to ``folder``, in ascending order of ``id_col`` over all files.

    ``folder/tokens`` has for each document: the id, part (number of its file's
    share), begin (tokens of the part before it), n_tokens and tokens. Tokens
    are dictionary-encoded, the other columns delta-encoded; row groups and
    pages have the given sizes, with page indexes, so a reader fetches the
    metadata columns, or the pages of some ids, alone. ``folder/parts`` has the
    tokens of all parts before each part. Each text, null as empty, is followed
    by ``end_id`` if given. With ``special_tokens`` the text of an added token
    becomes that token, as by the library's default; else it is text like any other. Rows with a null id come first; rows that share an
    id are in the order of their text's hash.
    """
    tail = b"" if end_id is None else np.array([end_id], "<i4").tobytes()
    order = [id_col, "order"]
    sorted_docs = (
        docs.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("order"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select(id_col, "text", F.spark_partition_id().alias("part"))
    )
    schema = T.StructType(
        sorted_docs.select(id_col, "part").schema.fields
        + T.StructType.fromDDL("begin long, n_tokens long, tokens array<int>").fields
    )

    def run(batches):
        encoder, begin = _encoder(tokenizer, special_tokens), 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            first = 0
            while first < len(batch):
                last, size = first, 0
                block: list[bytes] = []
                while last < len(batch) and (size < BLOCK_BYTES or not block):
                    block.append(texts[last].as_py() or b"")
                    size += len(block[-1])
                    last += 1
                ids = encoder.encode_all(block, tail)
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(first, last - first) for c in (id_col, "part")),
                        pa.array(begin + bounds[:-1]), pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values),
                    ],
                    [id_col, "part", "begin", "n_tokens", "tokens"],
                )
                begin += int(bounds[-1])
                first = last

    writer = map_arrow(sorted_docs, run, schema).write.option("compression", "zstd").option("parquet.writer.version", "v2")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 2 << 20)
    for column in (id_col, "part", "begin", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(f"{folder}/tokens")
    spark = docs.sparkSession
    totals = spark.read.parquet(f"{folder}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("part", F.coalesce(before, F.lit(0)).alias("base")).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write_tokens`` wrote: id, start (tokens of all documents before), n_tokens, tokens.

    Filters on the id reach the page index; columns that are not selected are not read.
    """
    tokens = spark.read.parquet(f"{folder}/tokens")
    parts = spark.read.parquet(f"{folder}/parts")
    return tokens.join(parts, "part").select(
        tokens.columns[0], (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "tokens"
    )


def with_crc32(frame: DataFrame, tokens_col: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """The input columns ``keep`` (default all) with ids_crc32, the unsigned CRC-32 of the ids as 32-bit integers."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column(tokens_col)
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
        raw, bounds = memoryview(values).cast("B"), lists.offsets.to_numpy()
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [pa.array(sums, pa.int64())]

    return annotate(frame, run, "ids_crc32 long", keep)
