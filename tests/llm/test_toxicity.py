"""Toxicity: the index against plain cosines, the cases of a table, held-out accuracy."""

import random

import numpy as np

from tidemark.llm import toxicity


def test_index_is_exact():
    chance = random.Random(1)
    idf = np.array([chance.uniform(0.5, 4) for _ in range(40)])
    vectors = [toxicity.unit(sorted(chance.sample(range(40), chance.randint(1, 8))), idf) for _ in range(700)]
    vectors += vectors[:50]
    examples = [(1000 - k, k % 2, 1.0, x) for k, x in enumerate(vectors)]
    index = toxicity.Index(examples, 40)
    for _ in range(60):
        query = toxicity.unit(sorted(chance.sample(range(40), chance.randint(1, 6))), idf)
        scores = [(round(sum(query[t] * x.get(t, 0.0) for t in query), 12), -i) for i, _, _, x in examples]
        want = sorted((x for x in scores if x[0] > 0), reverse=True)[:9]
        got = [(s, -index.ids[p]) for s, p in index.nearest(query, 9)]
        assert [x[1] for x in got] == [x[1] for x in want] and np.allclose([x[0] for x in got], [x[0] for x in want])
    assert index.nearest({}, 9) == []


def test_table(spark):
    chance = random.Random(6)
    words = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("ra", "se", "ti") for c in ("n", "m", "x")]
    rows, labels = [], []
    for k in range(400):
        text = chance.choices(words, k=chance.randint(10, 40))
        toxic = k % 4 == 0
        if toxic:
            text += chance.choices(["vermin", "vermins", "dolt"], k=3)
        chance.shuffle(text)
        rows.append((k, " ".join(text)))
        if k < 300:
            labels.append((k, int(toxic)))
    labels += [(2, None), (None, 1), (3, 7), (999, 1), (5, 0)]
    rows += [(800, None), (801, ""), (802, "... !!"), (803, "Vermin, VERMIN! dolt"), (803, "quite clean words"), (None, "vermin vermin dolt")]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, score int, id int")
    known = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, toxic int, label int")
    got = toxicity.score_toxicity(docs, known, per_class=100).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    held = {x.doc_id: x.score >= 0.5 for x in got if x.doc_id is not None and 300 <= x.doc_id < 400}
    assert sum(held[k] == (k % 4 == 0) for k in held) >= 97
    low = [x.score for x in got if x.doc_id in (800, 801, 802)]
    assert max(low) < 0.2 and [x.score > 0.5 for x in got if x.doc_id is None] == [True]
    assert sorted(x.score > 0.5 for x in got if x.doc_id == 803) == [False, True]
    evidence = next(x.evidence for x in got if x.doc_id == 304)
    assert evidence and evidence[0].label == 1 and evidence[0].cosine > evidence[-1].cosine - 1e-12


def test_rare_words_count(spark):
    """Toxic texts of words that no other text has: their copies have all their words and find them."""
    rows = [(k, f"plain text number n{k} of clean words") for k in range(60)]
    rows += [(100 + k, f"rot{k}a bad{k}b vile{k}c vile{k}c") for k in range(3)]
    labels = [(x[0], int(x[0] >= 100)) for x in rows]
    rows += [(200 + k, x[1]) for k, x in enumerate(rows[-3:])] + [(300, "rot0a bad0b bad0b bad0b vile0c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for k in range(3):
        assert got[200 + k].score == 1 and got[200 + k].evidence[0].id == 100 + k
        assert abs(got[200 + k].evidence[0].cosine - 1) < 1e-9
    assert got[7].evidence[0].id == 7 and got[7].score < 0.5
    assert got[300].evidence[0].id == 100 and got[300].evidence[0].cosine < 0.95


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.score for x in toxicity.score_toxicity(docs, none).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs.limit(0), one).count() == 0


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import QUERIES

    path = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity"](spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    rows = got.where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(x.toxic, x.predicted): x["count"] for x in rows}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.03
