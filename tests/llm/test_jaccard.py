"""The Jaccard join against brute force: signatures, components, whole tables."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import jaccard
from tidemark.llm.components import Components
from tidemark.llm.jaccard import Signatures, near_duplicates, shingle_sets


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [x for x in lower.split(" ") if x]


def shingles(text, width=5):
    w = words_of(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def brute(rows, num=75, den=100):
    sets = [shingles(x) for _, x in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            named = rows[a][0] is not None and rows[b][0] is not None
            if named and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted(((d, len(s), d if d is None else least[find(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(frame):
    return sorted((tuple(x) for x in frame.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_similar_sets_share_a_signature():
    chance = np.random.default_rng(3)
    pool = chance.integers(0, 2**63, 60).astype(np.uint64)
    signatures = Signatures(75, 100, pool)
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 18, 19, 33, 60, 150, 700]:
        for _ in range(60):
            a = np.unique(chance.integers(0, 2**63, n).astype(np.uint64))
            if chance.random() < 0.5:
                a = np.unique(np.concatenate([a, chance.permutation(pool)[: n // 2 + 1]]))
            for common in range(len(a) * 3 // 4, len(a) + 1):
                most = common * 100 // 75 - len(a)  # others that b may have: 75 * (|a| + others) <= 100 * common
                if most < 0 or n > 60 and chance.random() > 0.1:
                    continue
                for others in {0, most, int(chance.integers(0, most + 1))}:
                    b = np.unique(np.concatenate([
                        chance.permutation(a)[:common], chance.integers(0, 2**63, others).astype(np.uint64)]))
                    assert np.intersect1d(signatures.of(a), signatures.of(b)).size, (n, common, others)


def test_shingle_counts():
    texts = ["a b c d e f", "A  b\tc\nd e F a b c d e", "one two", "one two three four five", "", None, " \n", "É é x y z w"]
    got = [len(x) for x in shingle_sets(pa.array(texts), 5)]
    assert got == [len(shingles(x)) for x in texts]


def test_components(spark):
    chance = random.Random(4)
    edges = [(chance.randint(0, 400), chance.randint(0, 400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1060)]
    edges += [(2000, k) for k in range(2001, 2300)] + [(7, 7)]
    parent = {}

    def find(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    vertices = sorted(parent)
    frame = spark.createDataFrame([(k, k) for k in vertices], "v long, c long")
    got = Components(spark.createDataFrame(edges, "a long, b long")).label(frame, "c").select("v", "c").collect()
    assert sorted(map(tuple, got)) == [(k, find(k)) for k in vertices]


def test_table(spark, monkeypatch):
    chance = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = chance.choices(vocabulary, k=30)
    rows, doc = [], 0
    for size in (3, 5, 8, 12, 30, 60, 140):
        for _ in range(4):
            base = chance.choices(vocabulary, k=size)
            for _ in range(chance.choice([1, 4, 7])):
                copy = list(base)
                for _ in range(chance.choice([0, 0, 1, 2, 3])):
                    copy[chance.randrange(len(copy))] = chance.choice(vocabulary)
                doc += 1
                rows.append((doc, " ".join(copy)))
    rows += [(500 + k, " ".join(chance.choices(vocabulary, k=25) + passage + chance.choices(vocabulary, k=25))) for k in range(25)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Same Words"), (904, "same\twords"), (903, "same words"), (905, "same"),
             (None, rows[0][1]), (None, None), (1, "quite another text under the first id here")]
    chance.shuffle(rows)
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, `set` int, centre int").repartition(4)
    want = brute(rows)
    assert len({x[2] for x in want}) < len(rows)
    assert found(near_duplicates(docs)) == want
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 3)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 20)
    monkeypatch.setattr(jaccard, "PAIR_ROWS", 4)
    assert found(near_duplicates(docs)) == want


def test_families_without_their_origin(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for family in range(2):
        origin = [f"f{family}w{k}" for k in range(120)]
        for _ in range(35):
            copy = list(origin)
            for k in rng.sample(range(120), rng.randint(1, 4)):
                copy[k] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    for rounds in (0, 3):
        monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
        assert found(near_duplicates(docs)) == expected


def test_one_candidate_a_member(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, np.uint64)
    members = []
    for k in range(30):
        own = np.unique(np.concatenate([base[: 60 - k % 3], rng.integers(0, 2**63, k % 3, np.uint64)]))
        members.append((7, k, k, len(own), bytearray(jaccard.sketch(own))))
    listed = spark.createDataFrame(members, "name long, set long, component long, size long, sketch binary")
    rows = jaccard._stars(listed, 75, 100).collect()
    assert sorted(r["a"] for r in rows) == list(range(30))
    assert all(r["a"] != r["b"] and r["name"] == 7 for r in rows)
    pairs = {(r["a"], r["b"]) for r in jaccard._candidates(listed, 75, 100).collect()}
    assert len(pairs) == 30 * 29 // 2
    assert all((min(r["a"], r["b"]), max(r["a"], r["b"])) in pairs for r in rows)


def test_last_pairs_only_join(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, np.uint64)
    sets = [np.unique(np.concatenate([base[: 60 - k % 3], rng.integers(0, 2**63, k % 3, np.uint64)])) for k in range(30)]
    members = [(7, k, k, len(x), bytearray(jaccard.sketch(x)), bytearray(x.tobytes())) for k, x in enumerate(sets)]
    schema = "name long, set long, component long, size long, sketch binary, hashes binary"
    rows = jaccard._candidates(spark.createDataFrame(members, schema), 75, 100).collect()
    assert len(rows) == 29
    assert all(jaccard._similar(sets[r["a"]], sets[r["b"]], 75, 100) for r in rows)
    frame = spark.createDataFrame([(k, k) for k in range(30)], "v long, c long")
    joined = Components(spark.createDataFrame([tuple(r) for r in rows], "a long, b long")).label(frame, "c").collect()
    assert {r["c"] for r in joined} == {0}


def test_groups_of_one_centre_are_one(spark, monkeypatch):
    rng = random.Random(6)
    origin = [f"w{k}" for k in range(200)]
    rows = []
    for _ in range(20):
        copy = list(origin)
        for k in rng.sample(range(200), 12):
            copy[k] = f"x{rng.random()}"
        rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    listed, stars = [], jaccard._stars
    monkeypatch.setattr(jaccard, "_stars", lambda frame, *args: listed.append(frame.groupBy("set").count()) or stars(frame, *args))
    assert found(near_duplicates(docs)) == brute(rows)
    times = [r["count"] for r in listed[0].collect()]
    assert len(times) > 10
    assert max(times) <= 20


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(2, None), (3, "alone here")], "doc_id long, text string")
    assert found(near_duplicates(docs)) == [(2, 0, 2), (3, 1, 3)]


def test_sketches_bound_differences():
    chance = np.random.default_rng(8)
    for _ in range(200):
        n = int(chance.integers(0, 400))
        a = np.unique(chance.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], chance.integers(0, 2**63, n // 3).astype(np.uint64)]))
        x, y = jaccard._folded([jaccard.sketch(a), jaccard.sketch(b)])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    assert jaccard.sketch(a[:0]) == bytes(8)


def test_texts_are_not_joined(spark, monkeypatch):
    rng = random.Random(7)
    origin = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(origin[: k + 90] + [f"x{rng.random()}"])) for k in range(8)]
    rows += [(20 + k, f"another text {k} of some words that nothing else holds") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    joined, store = [], jaccard.stored

    def walk(plan):
        children = plan.children()
        for child in (children.apply(k) for k in range(children.size())):
            if plan.nodeName() == "Join":
                joined.append({child.output().apply(k).name() for k in range(child.output().size())})
            walk(child)

    def looked_at(frame, label):
        walk(frame._jdf.queryExecution().optimizedPlan())
        return store(frame, label)

    monkeypatch.setattr(jaccard, "stored", looked_at)
    assert found(near_duplicates(docs)) == brute(rows)
    assert any("hashes" in x for x in joined)
    assert not any("text" in x for x in joined)


def test_bits_of_wanted_ids(spark, monkeypatch):
    ids = spark.range(0, 3000, 3)

    def held(marked):
        at = [r["at"] for r in spark.range(3000).select(jaccard._bit(F.col("id"), 8 * len(marked)).alias("at")).collect()]
        return [k for k, x in enumerate(at) if marked[x >> 3] >> (x & 7) & 1]

    marked = jaccard._marked(ids, "id")
    assert len(marked) * 8 >= 64 * 1000
    assert set(range(0, 3000, 3)) <= set(held(marked)) and len(held(marked)) < 1100
    monkeypatch.setattr(jaccard, "MOST_BITS", 1 << 15)
    assert set(range(0, 3000, 3)) <= set(held(jaccard._marked(ids, "id")))
    assert not jaccard._marked(ids.where("id < 0"), "id").any()


def test_ids_of_other_types(spark, monkeypatch):
    rows = [(k, f"{'a text that is the same but for its last few words and so on ' * 3} {k}") for k in range(6)]
    docs = spark.createDataFrame([(f"d{k}", x) for k, x in rows], "doc_id string, text string")
    monkeypatch.setattr(jaccard, "BITS_PER_ID", 1)
    assert {r["component_id"] for r in near_duplicates(docs).collect()} == {"d0"}
