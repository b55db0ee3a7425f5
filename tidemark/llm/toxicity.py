"""Toxicity by votes of the nearest labelled examples under exact cosine of weighted TF-IDF vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import annotate, draw, map_arrow, stored

#: Entries of a Python worker's cache of words; a full cache is emptied. Bounds memory, never results.
CACHE_ENTRIES = 300_000

#: Lengths of word beginnings that may go with a label; ``^`` and ``$`` mark the ends of a word.
BEGINNINGS = (3, 4, 5, 6)

#: How much more than its TF-IDF a term weighs that goes with a label. Plain TF-IDF lets the many rare words
#: of a text outweigh the few that make it toxic.
LABEL_WEIGHT = 10.0

#: Chance alone gives a term this chi-squared once in about a million terms.
LEAST_CHI = 24.0

#: Examples of a block of the index.
BLOCK = 64

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def terms(chunk: str) -> list[str]:
    """The terms of a piece of lower-case text: its words and their beginnings."""
    out = []
    for word in _WORD.findall(chunk):
        out.append(f"^{word}$")
        out += [f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]
    return out


class Index:
    """Block-max inverted index of labelled examples.

    Examples are numbered so that like ones are neighbours and cut into blocks.
    A term's posting list is in order of the examples, so each block has a run
    of it, kept with its largest weight: the sum of these for a query's terms
    bounds the cosines of a block. The blocks of the highest bounds are scored
    first, then those whose bounds reach the k-th cosine found. Terms that many
    examples have are rows of a matrix instead: their share of the cosines is
    computed for all examples and many queries at once, and the bounds have it exactly.
    """

    #: Blocks that are scored before any is left out.
    FIRST = 4

    #: A term is a row of the matrix if this part of the examples has it, the most frequent terms first.
    DENSE, MOST_DENSE = 1 / 32, 512

    def __init__(self, examples: list[tuple[int, int, float, dict[int, float]]], size: int) -> None:
        """examples: id, label, weight of the vote, unit vector."""
        examples = sorted(examples, key=lambda x: (sorted(x[3]), x[0]))
        self.ids = [x[0] for x in examples]
        self.labels = [x[1] for x in examples]
        self.votes = [x[2] for x in examples]
        self.blocks = -(-len(examples) // BLOCK)
        places = np.repeat(np.arange(len(examples)), [len(x[3]) for x in examples])
        terms = np.array([t for x in examples for t in x[3]], np.int64)
        weights = np.array([w for x in examples for w in x[3].values()], np.float64)
        often = np.bincount(terms, minlength=size)
        rows = np.argsort(-often, kind="stable")[: self.MOST_DENSE]
        rows = rows[often[rows] > max(BLOCK, self.DENSE * len(examples))]
        #: The row of a term in the matrix; the number of rows for all other terms.
        self.row = np.full(size, len(rows), np.int32)
        self.row[rows] = np.arange(len(rows))
        self.matrix = np.zeros((len(rows), len(examples)))
        dense = self.row[terms] < len(rows)
        self.matrix[self.row[terms[dense]], places[dense]] = weights[dense]
        places, terms, weights = places[~dense], terms[~dense], weights[~dense]
        order = np.lexsort((places, terms))
        self.places, self.weights = places[order].astype(np.int32), weights[order]
        run = terms[order] * max(1, self.blocks) + self.places // BLOCK
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        #: Runs: where each begins and its length, its block and largest weight; where the runs of a term begin.
        self.begin, self.length = begin, np.diff(begin, append=len(run))
        self.block = self.places[begin] // BLOCK
        self.highest = np.maximum.reduceat(self.weights, begin) if len(begin) else np.empty(0)
        self.runs = np.searchsorted(terms[order][begin], np.arange(size + 1))

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k examples of the highest positive cosine, ties to the smaller id: (cosine, place)."""
        places = np.fromiter(query, np.int64, len(query))
        return next(self.nearest_each([(places, np.fromiter(query.values(), np.float64, len(query)))], k))

    def nearest_each(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[list[tuple[float, int]]]:
        """``nearest`` of each query, given by its places and weights."""
        for first in range(0, len(queries), BLOCK):
            some = queries[first : first + BLOCK]
            heads = np.zeros((len(some), len(self.matrix) + 1))
            for head, (terms, weights) in zip(heads, some, strict=True):
                head[self.row[terms]] = weights
            for (terms, weights), base in zip(some, heads[:, :-1] @ self.matrix, strict=True):
                yield self._nearest(terms, weights, base, k) if len(terms) and self.ids else []

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, base: np.ndarray, k: int) -> list[tuple[float, int]]:
        """``nearest`` from the cosines' share of the matrix."""
        first, sizes = self.runs[terms], self.runs[terms + 1] - self.runs[terms]
        runs, weights = _ranges(first, sizes), np.repeat(weights, sizes)
        block = self.block[runs]
        bounds = np.maximum.reduceat(base, np.arange(0, len(base), BLOCK))
        bounds = bounds + np.bincount(block, weights * self.highest[runs], self.blocks)
        start = np.argsort(-bounds, kind="stable")[: self.FIRST]
        chosen = np.zeros(self.blocks, bool)
        chosen[start] = True
        scores = base + self._scores(runs, weights, chosen[block])
        if self.blocks > len(start):
            # The shares of blocks that are not scored yet are no more than their cosines.
            least = np.partition(scores, -k)[-k] - 1e-9 if len(scores) >= k else 0.0
            more = (bounds >= least) & (bounds > 0) & ~chosen
            if more.any():
                scores += self._scores(runs, weights, more[block])
        found = np.flatnonzero(scores > 0)
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k] - 1e-9]
        best = sorted(((-round(x, 12), self.ids[p], p) for x, p in zip(scores[found].tolist(), found.tolist(), strict=True)))
        return [(-score, place) for score, _, place in best[:k]]

    def _scores(self, runs: np.ndarray, weights: np.ndarray, take: np.ndarray) -> np.ndarray:
        """The cosines of all examples as far as the taken runs make them."""
        runs = runs[take]
        sizes = self.length[runs]
        at = _ranges(self.begin[runs], sizes)
        return np.bincount(self.places[at], np.repeat(weights[take], sizes) * self.weights[at], len(self.ids))


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes`` consecutive numbers from each of ``first``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


class Scorer:
    """An index with what else a score needs: weights of terms, and the share of label 1 without terms."""

    def __init__(self, index: Index, idf: np.ndarray, without: float, k: int) -> None:
        self.index, self.idf, self.without, self.k = index, idf, without, k

    def scores(self, texts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[tuple[int, float, int]]]]:
        """Score and evidence of each text, given by the places of its terms and their counts."""
        for near in self.index.nearest_each([(x, _weights(x, self.idf, n)) for x, n in texts], self.k):
            yield self._judge(near)

    def _judge(self, near: list[tuple[float, int]]) -> tuple[float, list[tuple[int, float, int]]]:
        index = self.index
        if not near:
            return self.without, []
        votes = [similarity**2 * index.votes[x] for similarity, x in near]
        positive = sum(v for v, (_, x) in zip(votes, near, strict=True) if index.labels[x])
        evidence = [(index.ids[x], similarity, index.labels[x]) for similarity, x in near]
        return positive / sum(votes), evidence


def _weights(places: np.ndarray, idf: np.ndarray, counts: np.ndarray | float) -> np.ndarray:
    raw = idf[places] * counts
    return raw / np.sqrt(raw @ raw) if len(raw) else raw


def unit(places: list[int], idf: np.ndarray, counts: list[int] | None = None) -> dict[int, float]:
    """The vector of length 1 of terms with their counts (1 if not given), each times its weight."""
    weights = _weights(np.array(places, np.int64), idf, 1.0 if counts is None else np.array(counts, np.float64))
    return dict(zip(places, weights.tolist(), strict=True))


def _sample(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> DataFrame:
    """Ids and labels of at most ``per_class`` rows of each label, by the hash of the id."""
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    )
    return draw(known.withColumn("draw", F.xxhash64("id")), "label", per_class).select("id", "label")


def _label_terms(texts: DataFrame) -> list[str]:
    """The words and beginnings of words that go with either label by the chi-squared statistic over the sample.

    Of terms that are beginnings of one another only the best is taken.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter[str] = Counter()
        positive: Counter[str] = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found = {x for y in (text or "").lower().split() for x in terms(y)}
                every.update(found)
                if label:
                    positive.update(found)
        names = list(every)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([every[x] for x in names], pa.int64()),
                pa.array([positive[x] for x in names], pa.int64()),
            ],
            ["term", "n", "n1"],
        )

    sizes = texts.agg(F.count("*"), F.sum("label")).first()
    total, ones = sizes[0], sizes[1] or 0
    a, n = F.col("n1").cast("double"), F.col("n").cast("double")
    b = n - a
    cross = a * (total - ones - b) - b * (ones - a)
    chi = total * cross * cross / (n * (total - n) * float(max(1, ones)) * float(max(1, total - ones)))
    rows = (
        map_arrow(texts, count, "term string, n long, n1 long")
        .groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
        .where((F.col("n") >= 5) & (F.col("n") < total))
        .select("term", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI)
        .orderBy(F.desc("chi"), F.length("term"), "term").collect()
    )
    chosen: list[str] = []
    taken: set[str] = set()
    parts: set[str] = set()
    for x in rows:
        own = [x.term[:n] for n in range(1, len(x.term) + 1)]
        if x.term not in parts and taken.isdisjoint(own):
            chosen.append(x.term)
            taken.add(x.term)
            parts.update(own)
    return chosen


def _words(texts: DataFrame) -> list[str]:
    """All words of the sample, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(_WORD.findall((text or "").lower()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    return sorted(x.word for x in map_arrow(texts.select("text"), run, "word string").distinct().collect())


def text_terms(docs: DataFrame, names: list[str], text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` with places, the numbers of the named terms that each whole text has, and their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(names)
    numbers: dict[str, int] = {}
    known: dict[str, tuple[int, ...]] = {}
    #: Lengths of the named beginnings; all others need no look-up.
    lengths: list[int] = []

    def places_of(word: str) -> tuple[int, ...]:
        own = [f"^{word}$", *[f"^{word[:n]}" for n in lengths if len(word) >= n]]
        found = tuple([numbers[x] for x in own if x in numbers])
        if len(word) <= 64:
            known[word] = found
        return found

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        if not numbers:
            numbers.update((x, k) for k, x in enumerate(shared.value))
            named = {len(x) - 1 for x in numbers if not x.endswith("$")}
            lengths[:] = [n for n in BEGINNINGS if n in named]
        places, counts = [], []
        for text in batch.column(text_col):
            if len(known) >= CACHE_ENTRIES:
                known.clear()
            found: dict[int, int] = {}
            for word, n in Counter(_WORD.findall((text.as_py() or "").lower())).items():
                own = known.get(word)
                for x in places_of(word) if own is None else own:
                    found[x] = found.get(x, 0) + n
            places.append(list(found))
            counts.append(list(found.values()))
        return [pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]

    return annotate(docs, run, "places array<int>, counts array<int>", keep)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The values of each list; none of them is null."""
    offsets = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(), offsets[1:-1] - offsets[0]) if len(column) else []


def _document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """How many rows have each place, summed up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("places").flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["place", "n"])

    rows = map_arrow(vectors.select("places"), run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(size)
    for x in rows.collect():
        out[x.place] = x.n
    return out


def score_toxicity(docs: DataFrame, labelled: DataFrame, per_class: int = 2000, k: int = 15,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id_col, score (0 to 1), and evidence: the nearest examples with cosine and label.

    ``labelled`` has id_col and label_col (0 or 1); other labels and null ids
    do not count, and of an id with both labels 1 holds. Examples are at most
    ``per_class`` rows of each label, chosen by the hash of the id: the bounded
    sample that the model is fitted on. Terms are all words of these examples,
    with their counts in a text times their inverse document frequency over all
    of ``docs``. Words that go with a label weigh LABEL_WEIGHT times as much; so
    do beginnings of words that do, which are terms of their own. The score is
    the share of label 1 among the ``k`` examples of the highest cosine, each
    voting with the squared cosine times the rows its class has for each example.
    Texts without any word of the examples, null or empty ones too, get the share
    of label 1 among examples without words; without labelled rows all scores are 0.
    """
    spark = docs.sparkSession
    rows = docs.select(id_col, text_col)
    sample = stored(_sample(labelled, id_col, label_col, per_class), "examples")
    sizes = {x.label: x.n for x in labelled.where(F.col(label_col).isin(0, 1)).groupBy(
        F.col(label_col).cast("int").alias("label")).agg(F.countDistinct(id_col).alias("n")).collect()}
    # At most two times per_class rows.
    texts = rows.join(F.broadcast(sample), F.col(id_col) == F.col("id")).select(
        F.col("id"), "label", F.col(text_col).alias("text"))
    texts = stored(texts, "example-texts")
    strong = _label_terms(texts)
    # Terms that go with a label have the first numbers, so the index has examples that share them side by side.
    names = list(dict.fromkeys([*strong, *(f"^{x}$" for x in _words(texts))]))
    vectors = stored(text_terms(rows, names, text_col, [id_col]), "text-terms")
    frequency = _document_frequencies(vectors, len(names))
    idf = np.log((1 + vectors.count()) / (1 + frequency)) + 1
    idf[: len(strong)] *= LABEL_WEIGHT
    examples = vectors.join(F.broadcast(sample), F.col(id_col) == F.col("id")).select(
        "id", "label", "places", "counts").collect()
    taken = Counter(x.label for x in examples)
    votes = {x: sizes.get(x, 0) / max(1, taken[x]) for x in (0, 1)}
    empty = [0.0, 0.0]
    for x in examples:
        if not x.places:
            empty[x.label] += votes[x.label]
    index = Index(
        [(x.id, x.label, votes[x.label], unit(x.places, idf, x.counts)) for x in examples if x.places], len(names)
    )
    without = empty[1] / sum(empty) if sum(empty) else 0.0
    shared = spark.sparkContext.broadcast(Scorer(index, idf, without, k))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        scorer, scores, evidence = shared.value, [], []
        for score, near in scorer.scores(zip(_lists(batch.column("places")), _lists(batch.column("counts")), strict=True)):
            scores.append(score)
            evidence.append([{"id": a, "cosine": b, "label": c} for a, b, c in near])
        kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        return [pa.array(scores, pa.float64()), pa.array(evidence, kind)]

    return annotate(
        vectors, run, "score double, evidence array<struct<id: long, cosine: double, label: int>>", [id_col]
    )
