"""Language identification by prediction by partial matching with frozen context trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import LOWER_BYTES, annotate, draw, pieces, stored, utf8

#: What stands between texts, so that a text begins in a context of its own.
PAD = 10

UNKNOWN = "und"


class ContextTrees:
    """Byte context trees of all languages, as tables over the grams that training has seen.

    A gram of n bytes is a context of n - 1 bytes with its next byte. Each
    gram has a number, 0 meaning unseen, so the number of a longer gram follows
    from that of the gram one position earlier and the next byte. For every
    gram and language ``bits`` holds the exact code length of its last byte:
    with count c, context total t and q different bytes in the context, a seen
    byte costs -log2(c / (t + q)); an unseen one costs the escape
    -log2(q / (t + q)) and goes on in the context one byte shorter, at the end
    to 8 bits. Unseen contexts cost nothing to leave. A-Z count as a-z.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = 3) -> None:
        self.languages = sorted(samples)
        self.order = order
        pad = bytes([PAD]) * order
        runs = [
            LOWER_BYTES[np.frombuffer(pad + pad.join(samples[x]) + pad, np.uint8)] for x in self.languages
        ]
        seen = np.unique(np.concatenate([np.empty(0, np.uint8), *runs]))
        self.kinds = len(seen) + 1
        symbol = np.zeros(256, np.int32)
        symbol[seen] = np.arange(1, self.kinds)
        self.symbol = symbol[LOWER_BYTES]
        self.step: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        if self.languages:
            self._learn([symbol[x] for x in runs])

    def _learn(self, runs: list[np.ndarray]) -> None:
        grams, sizes = [x.astype(np.int64) for x in runs], self.kinds
        counts = np.stack([np.bincount(x, minlength=sizes) for x in grams], 1)
        total, kinds = counts.sum(0), (counts > 0).sum(0)
        out = -np.log2(kinds / (total + kinds))
        self.bits.append(_code(counts, total, kinds, np.broadcast_to(out + 8.0, counts.shape)))
        for _ in range(self.order):
            keys = [np.where(x[:-1] > 0, x[:-1] * self.kinds + r[len(r) - len(x) + 1 :], 0) for x, r in zip(grams, runs, strict=True)]
            known, where = np.unique(np.concatenate(keys), return_index=True)
            suffix = np.concatenate([x[1:] for x in grams])[where]
            step = np.zeros(sizes * self.kinds, np.int32)
            step[known] = np.arange(1, len(known) + 1)
            grams = [step[k].astype(np.int64) for k in keys]
            context = np.concatenate([[0], known // self.kinds])
            counts = np.stack([np.bincount(x, minlength=len(known) + 1) for x in grams], 1)
            total, kinds = (np.zeros((sizes, counts.shape[1])) for _ in range(2))
            np.add.at(total, context, counts)
            np.add.at(kinds, context, counts > 0)
            escape = np.zeros(total.shape)
            np.log2((total + kinds) / np.maximum(kinds, 1), out=escape, where=total > 0)
            lower = np.concatenate([np.zeros((1, counts.shape[1])), self.bits[-1][:, suffix].T])
            bits = _code(counts, total[context], kinds[context], escape[context] + lower)
            self.step.append(step)
            self.escape.append(np.ascontiguousarray(escape.T, np.float32))
            self.bits.append(bits)
            sizes = len(known) + 1

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The code length in bits of each text in each language."""
        sizes = np.diff(offsets)
        out = np.zeros((len(sizes), len(self.languages)))
        full = np.flatnonzero(sizes)
        if len(full) == 0 or not self.languages:
            return out
        gap = self.order
        begin = offsets[:-1] + gap * np.arange(1, len(sizes) + 1)
        text = np.full(len(data) + gap * (len(sizes) + 1), self.symbol[PAD], np.int32)
        text[np.arange(len(data)) + np.repeat(begin - offsets[:-1], sizes)] = self.symbol[data]
        grams = [text]
        for step in self.step:
            longer = np.zeros(len(text), np.int32)
            longer[1:] = step[grams[-1][:-1] * self.kinds + text[1:]]
            grams.append(longer)
        missing, unseen = [], np.flatnonzero(grams[-1] == 0)
        for n in range(self.order, 0, -1):
            missing.append(unseen)
            unseen = unseen[grams[n - 1][unseen] == 0]
        ends = np.stack([begin[full], (begin + sizes)[full]], 1).ravel()
        for k in range(len(self.languages)):
            bits = self.bits[-1][k][grams[-1]]
            for n, at in zip(range(self.order, 0, -1), missing, strict=True):
                bits[at] = 0 if n == self.order else bits[at]
                bits[at] += self.escape[n - 1][k][grams[n - 1][at - 1]]
                found = at if n == 1 else at[grams[n - 1][at] > 0]
                bits[found] += self.bits[n - 1][k][grams[n - 1][found]]
            out[full, k] = np.add.reduceat(bits, ends, dtype=np.float64)[::2]
        return out


def _code(counts: np.ndarray, total: np.ndarray, kinds: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    bits = np.array(unseen, np.float64)
    share = np.broadcast_to(total + kinds, counts.shape)
    np.log2(share / np.maximum(counts, 1), out=bits, where=counts > 0)
    return np.ascontiguousarray(bits.T, np.float32)


def train(labelled: DataFrame, order: int = 3, per_language: int = 400, max_bytes: int = 65_536,
          text_col: str = "text", lang_col: str = "lang") -> ContextTrees:
    """Trees from at most ``per_language`` different texts of each language, each of at most ``max_bytes`` bytes.

    The sample is bounded by these two documented parameters: the texts of the
    smallest hashes, copies counting as one. A language that has longer texts only
    learns from the first ``max_bytes`` of them. Rows without text or language do not count.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        (F.col(lang_col).isNotNull()) & (F.octet_length(text_col) > 0)
    )
    rows = rows.withColumn("draw", F.xxhash64("text")).withColumn("text", F.col("text").cast("binary"))
    # Hashes alone are shuffled here, however many copies a text has.
    keys = stored(rows.select("lang", "draw", (F.octet_length("text") > max_bytes).alias("long")).distinct(), "texts")
    counts = {x.lang: x for x in keys.groupBy("lang").agg(
        F.sum((~F.col("long")).cast("long")).alias("short"), F.count("*").alias("n")).collect()}
    languages = [(k, x.short == 0) for k, x in counts.items()]
    if not languages:
        return ContextTrees({}, order)
    wanted = keys.sparkSession.createDataFrame(languages, "lang string, long boolean")
    usable = keys.join(F.broadcast(wanted), ["lang", "long"])
    taken: dict[str, list[int]] = {k: [] for k in counts}
    for row in draw(usable, "lang", per_language).collect():
        taken[row.lang].append(row.draw)
    for k, x in counts.items():
        if len(taken[k]) < min(per_language, x.short or x.n):
            least = usable.where(F.col("lang") == k).orderBy("draw").limit(per_language)
            taken[k] = [row.draw for row in least.collect()]
    chosen = keys.sparkSession.createDataFrame(
        [(k, x) for k, own in taken.items() for x in own], "lang string, draw long")
    texts = rows.withColumn("text", F.substring("text", 1, max_bytes)).join(F.broadcast(chosen), ["lang", "draw"])
    sample: dict[str, list[bytes]] = {}
    for row in texts.groupBy("lang", "draw").agg(F.min("text").alias("text")).collect():
        sample.setdefault(row.lang, []).append(bytes(row.text))
    return ContextTrees({k: sorted(v) for k, v in sample.items()}, order)


def identify(docs: DataFrame, trees: ContextTrees, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The input columns ``keep`` (default all) with lang_pred and score; such columns are replaced.

    The language whose trees need the fewest bits for the whole text, the first
    by name between equals. The score is its share among the languages' 2^-bits,
    at the mean code length for a text of at most 64 bytes, so that it does not
    run to 1 with length alone. ``und`` with score 0 if the text is null or has
    no letter, or if no language is known.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def predict(batch: pa.RecordBatch) -> list[pa.Array]:
        model, column = shared.value, batch.column(text_col)
        data, offsets = utf8(column)
        names, scores = [], []
        for first, last in pieces(offsets):
            own = offsets[first : last + 1] - offsets[first]
            part = data[offsets[first] : offsets[last]]
            letters = _lettered(part, own)
            bits = model.lengths(part, own)
            sizes = np.maximum(np.diff(own), 1)
            if model.languages:
                best = bits.argmin(1)
                lead = (bits - bits.min(1, keepdims=True)) * (np.minimum(sizes, 64) / sizes)[:, None]
                score = np.where(letters, 1 / np.exp2(-lead).sum(1), 0.0)
                names += [model.languages[x] if y else UNKNOWN for x, y in zip(best, letters, strict=True)]
            else:
                score = np.zeros(len(sizes))
                names += [UNKNOWN] * len(sizes)
            scores.append(score)
        return [pa.array(names, pa.string()), pa.array(np.concatenate([np.empty(0), *scores]))]

    return annotate(docs, predict, "lang_pred string, score double", keep)


_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    counts = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = counts[offsets[1:]] > counts[offsets[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode()))
    return out
