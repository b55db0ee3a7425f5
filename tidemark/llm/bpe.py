"""Byte-level BPE by dynamic programming over prefixes."""

from __future__ import annotations

import base64
import functools
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.frames import WordCache, annotate, release

#: Entries of the caches of a Python worker: parts between spaces, matches of the pattern, prefixes; pairs of tokens.
#: Bounds memory, never results.
CACHE_PARTS = 300_000
CACHE_ENTRIES = 120_000
CACHE_PAIRS = 500_000

#: Characters of text whose new words are encoded together; words of more bytes are encoded one by one.
BLOCK_CHARS = 2 << 20
LONG_BYTES = 64

#: Bits of the number of token pairs that encoding words together remembers.
PAIR_BITS = 20

#: Prefixes of at most so many bytes are kept with their last token for all texts.
SHORT_BYTES = 9

#: A white space character before a space: then matches may span more than one space-led piece.
_SPACE_RUN = regex.compile(r"\s ")


class Vocabulary:
    """Token ranks, and whether two tokens may stand side by side in an encoding.

    BPE has the property that a sequence of tokens is the encoding of its bytes
    exactly if each pair of neighbours is the encoding of the pair's bytes. So
    each prefix has one valid last token: the token t that ends it such that
    the last token of the rest and t are such a pair.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.pieces: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.wide = max(self.pieces) + 1
        self.pairs: dict[int, bool] = {}
        self.lone: dict[int, bool] = {}
        self.short: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, token in ranks.items():
            self.automaton.add_word(piece.decode("latin-1"), token)
        self.automaton.make_automaton()

    def merge(self, text: bytes) -> list[int]:
        """Plain BPE of a few bytes: the pair of lowest rank is merged first."""
        none, rank = 2 * len(self.ranks), self.ranks.get
        parts = [text[k : k + 1] for k in range(len(text))]
        pairs = [rank(text[k : k + 2], none) for k in range(len(text) - 1)]
        while pairs and (best := min(pairs)) < none:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = rank(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = rank(parts[k] + parts[k + 1], none)
        return [self.ranks[x] for x in parts]

    def alone(self, token: int) -> bool:
        found = self.lone.get(token)
        if found is None:
            found = self.lone[token] = self.merge(self.pieces[token]) == [token]
        return found

    def side_by_side(self, left: int, right: int) -> bool:
        key = left * self.wide + right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return found


class PrefixTable:
    """Bytes with the valid last token of each prefix: the encoding of any prefix can be read off.

    Appending extends the table. After an edit only prefixes from the edit on
    are looked at, and only until the last tokens agree with the old ones for
    as many bytes as the longest token has; from there they are the old ones.
    """

    def __init__(self, vocabulary: Vocabulary, text: bytes = b"") -> None:
        self.vocabulary = vocabulary
        self.text = b""
        self.last: list[int] = []
        self.append(text)

    def append(self, more: bytes) -> None:
        """The tokens that end at each new byte come from the automaton of all tokens; the one that fits is kept."""
        self.text += more
        text, last, vocabulary = self.text, self.last, self.vocabulary
        done, short = len(last), vocabulary.short
        while done < min(SHORT_BYTES, len(text)) and (token := short.get(text[: done + 1])) is not None:
            last.append(token)
            done += 1
        if done == len(text):
            return
        wide, pairs, pieces = vocabulary.wide, vocabulary.pairs.get, vocabulary.pieces
        begin = max(0, done + 1 - vocabulary.longest)
        for at, token in vocabulary.automaton.iter(text.decode("latin-1"), begin):
            if at != done:
                continue
            size = len(pieces[token])
            if size > at:
                fits = vocabulary.alone(token)
            else:
                before = last[at - size]
                fits = pairs(before * wide + token)
                if fits is None:
                    fits = vocabulary.side_by_side(before, token)
            if fits:
                last.append(token)
                done += 1
                if done <= SHORT_BYTES:
                    if len(short) >= CACHE_ENTRIES:
                        short.clear()
                    short[text[:done]] = token
        if done < len(text):
            raise ValueError("the vocabulary lacks a single byte of the text")

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes begin to end; returns for how many prefixes work was done."""
        old, shift = self.last, len(new) - (end - begin)
        self.text = self.text[:begin] + new + self.text[end:]
        self.last = old[:begin]
        same = 0
        for at in range(begin + 1, len(self.text) + 1):
            self.last.append(self._last(at))
            inside = at > begin + len(new)
            same = same + 1 if inside and self.last[-1] == old[at - shift - 1] else 0
            if same >= self.vocabulary.longest:
                self.last += old[at - shift :]
                return at - begin
        return len(self.text) - begin

    def _last(self, end: int) -> int:
        vocabulary, begin = self.vocabulary, max(0, end - self.vocabulary.longest)
        letters = self.text[begin:end].decode("latin-1")
        for at, token in vocabulary.automaton.iter(letters):
            if at + 1 < len(letters):
                continue
            size = len(vocabulary.pieces[token])
            if vocabulary.alone(token) if size == end else vocabulary.side_by_side(self.last[end - size - 1], token):
                return token
        raise ValueError("the vocabulary lacks a single byte of the text")

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes (default all)."""
        at, out = len(self.text) if end is None else end, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.pieces[out[-1]])
        return out[::-1]


class WordTable:
    """Prefix tables of many words at once: the last tokens of all words' prefixes of one length are found together.

    The tokens that may end a prefix come longest first, and only words without a token yet look at the next one.
    Whether two tokens may stand side by side is remembered by a table of fixed size, where pairs displace others.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.fits = np.zeros(1 << PAIR_BITS, bool)
        self.lone = np.full(vocabulary.wide, -1, np.int8)
        self.sizes = np.zeros(vocabulary.wide, np.int64)
        self.sizes[list(vocabulary.pieces)] = [len(x) for x in vocabulary.pieces.values()]

    def _alone(self, tokens: np.ndarray) -> np.ndarray:
        for token in np.unique(tokens[self.lone[tokens] < 0]).tolist():
            self.lone[token] = self.vocabulary.alone(token)
        return self.lone[tokens] > 0

    def _side_by_side(self, keys: np.ndarray) -> np.ndarray:
        slots = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.fits[slots]
        new = np.flatnonzero(self.keys[slots] != keys)
        if len(new):
            unknown, where = np.unique(keys[new], return_inverse=True)
            merge, pieces, wide = self.vocabulary.merge, self.vocabulary.pieces, self.vocabulary.wide
            pairs = ((int(x) // wide, int(x) % wide) for x in unknown)
            found = np.array([merge(pieces[a] + pieces[b]) == [a, b] for a, b in pairs], bool)
            out[new] = found[where]
            # one slot may take several pairs: the key and its answer must come from the same one
            taken, chosen = np.unique(slots[new], return_index=True)
            self.keys[taken], self.fits[taken] = keys[new][chosen], out[new][chosen]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The encodings of non-empty words, as little-endian unsigned 32-bit integers."""
        vocabulary = self.vocabulary
        sizes = np.array([len(x) for x in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        # the character between words is in no token
        letters = "\u0100".join([x.decode("latin-1") for x in words])
        found = np.fromiter(itertools.chain.from_iterable(vocabulary.automaton.iter(letters)), np.int64)
        at, token = found[::2], found[1::2]
        size = self.sizes[token]
        begins = np.repeat(starts, sizes + 1)
        place = at - begins[at]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        turn = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        order = np.argsort((place * (LONG_BYTES + 1) + turn).astype(np.uint16), kind="stable")
        at, size, token, place, turn = (x[order] for x in (at, size, token, place, turn))
        cuts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (turn[1:] != turn[:-1])]))
        last = np.full(len(letters), -1, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
            open_ = a + np.flatnonzero(last[at[a:b]] < 0)
            whole = size[open_] > place[a]
            lone = open_[whole]
            lone = lone[self._alone(token[lone])]
            last[at[lone]] = token[lone]
            inner = open_[~whole]
            if len(inner):
                fits = self._side_by_side(last[at[inner] - size[inner]] * vocabulary.wide + token[inner])
                last[at[inner[fits]]] = token[inner[fits]]
        return self._read(last, starts, starts + sizes)

    def _read(self, last: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        word, end = np.arange(len(starts)), ends
        owners, tokens = [], []
        while len(word):
            token = last[end - 1]
            if (token < 0).any():
                raise ValueError("the vocabulary lacks a single byte of the text")
            owners.append(word)
            tokens.append(token)
            end = end - self.sizes[token]
            more = end > starts[word]
            word, end = word[more], end[more]
        order = np.argsort(np.concatenate(owners[::-1]), kind="stable")
        counts = np.bincount(np.concatenate(owners), minlength=len(starts))
        raw = np.concatenate(tokens[::-1])[order].astype("<u4").tobytes()
        bounds = np.concatenate([[0], np.cumsum(4 * counts)]).tolist()
        return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Encoder:
    """Texts to token ids: each match of the pattern through a prefix table, with caches by text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary = Vocabulary(ranks)
        self.find = regex.compile(pattern).findall
        self.words = WordCache(self._word, CACHE_ENTRIES)
        self.parts = WordCache(self._part, CACHE_PARTS)
        self.table = WordTable(self.vocabulary)

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        token = self.vocabulary.ranks.get(raw)
        if token is not None and self.vocabulary.alone(token):
            found = [token]
        else:
            found = PrefixTable(self.vocabulary, raw).tokens()
        return np.array(found, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """The ids of a space and what follows it up to the next one."""
        return b"".join(map(self.words.__getitem__, self.find(" " + part)))

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The encodings of words, those of new words of common length found together."""
        known, own = self.words, {}
        new = [x for x in words if x not in known and len(x) <= LONG_BYTES // 4]
        if new:
            own = dict(zip(new, self.table.encode([x.encode() for x in new]), strict=True))
        own.update((x, known[x]) for x in words.difference(own))
        known.update((x, own[x]) for x in new if len(x) <= known.longest and len(known) < 2 * known.entries)
        return own

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts are taken in blocks of about BLOCK_CHARS characters."""
        out: list[bytes] = []
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (size < BLOCK_CHARS or end == begin):
                size += len(texts[end])
                end += 1
            out += self._block(texts[begin:end])
            begin = end
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        """Where every space stands alone or begins a run of white space, no match crosses a space from the
        left, so the pieces that begin with a space are matched, and cached, one by one.
        """
        self.words.trim()
        self.parts.trim()
        known = self.parts
        heads, tails, needed, wanted = [], [], set(), {}
        for text in texts:
            head, *tail = [text] if _SPACE_RUN.search(text) else text.split(" ")
            heads.append(self.find(head))
            tails.append(tail)
            needed.update(heads[-1])
            for part in set(tail):
                if part not in known and part not in wanted:
                    wanted[part] = found = self.find(" " + part)
                    needed.update(found)
        words = self._learn(needed)
        room = 2 * known.entries - len(known)
        for part, found in wanted.items():
            known[part] = b"".join([words[x] for x in found])
        out = [
            b"".join([*map(words.__getitem__, head), *map(known.__getitem__, tail)])
            for head, tail in zip(heads, tails, strict=True)
        ]
        for k, part in enumerate(wanted):
            if k >= room or len(part) > known.longest:
                del known[part]
        return out

    def forget(self) -> None:
        """Empty the caches, so that an idle Python worker holds little more than the vocabulary."""
        for cache in (self.words, self.parts, self.vocabulary.pairs, self.vocabulary.short):
            cache.clear()
        self.table = WordTable(self.vocabulary)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.pieces.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file (base64 token and rank on each line), once in each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Encoder(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", packed: bool = False,
           keep: list[str] | None = None, lasting: bool = True) -> DataFrame:
    """The input columns ``keep`` (default all) with ids and n_tokens; such columns are replaced.

    Each match of ``pattern`` in the whole text is encoded on its own; there are
    no special tokens. A null or empty text has no tokens. ids is an array of
    int, or with ``packed`` the binary of little-endian unsigned 32-bit integers.
    Words stay cached from partition to partition; with ``lasting`` false they do not,
    for jobs whose other steps need the memory that idle Python workers would hold.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        own = encoder(path, pattern)
        out = own.encode_all([x or "" for x in batch.column(text_col).to_pylist()])
        sizes = np.array([len(x) // 4 for x in out], np.int64)
        if packed:
            return [pa.array(out, pa.binary()), pa.array(sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        values = np.frombuffer(b"".join(out), "<i4")
        return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)), pa.array(sizes)]

    def done() -> None:
        if not lasting:
            encoder(path, pattern).forget()
            release()

    return annotate(docs, run, f"ids {'binary' if packed else 'array<int>'}, n_tokens long", keep, done)


def decode(frame: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The input columns ``keep`` (default all) with decoded (binary), the bytes of all ids of ``ids_col``.

    ``ids_col`` is an array of int or packed as by ``encode``; null gives no bytes.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        own, out = encoder(path, pattern), []
        for x in batch.column(ids_col):
            ids = x.as_py() or b""
            out.append(own.decode(np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.array(ids, "<u4")))
        return [pa.array(out, pa.binary())]

    return annotate(frame, run, "decoded binary", keep)
