"""Suffix sorting and substring dedup against brute force."""

import random

import numpy as np

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import cut_repeats
from tidemark.llm.suffix_sort import BlindTrie, deep_shallow_order


def test_blind_trie():
    chance = random.Random(1)
    for alphabet in (b"ab", bytes(range(256))):
        keys = [bytes(chance.choices(alphabet, k=9)) for _ in range(300)]
        trie = BlindTrie()
        for k, key in enumerate(keys):
            trie.insert(key, k)
        groups = trie.groups()
        assert [keys[x[0]] for x in groups] == sorted(set(keys))
        assert all(len({keys[k] for k in x}) == 1 for x in groups)
        assert sorted(k for x in groups for k in x) == list(range(300))


def test_order():
    chance = random.Random(2)
    for length in (5, 8, 24, 31, 50):
        parts = [bytes(chance.choices(b"ab\x00\xff", k=60)) for _ in range(3)]
        text = b"".join(chance.choices(parts, k=8))
        starts = np.arange(len(text) - length + 1)
        order, new = deep_shallow_order(np.frombuffer(text, np.uint8), starts, length)
        strings = [text[k : k + length] for k in order]
        assert strings == sorted(strings) and sorted(order.tolist()) == starts.tolist()
        assert new.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


def brute(rows, length):
    first, out = {}, []
    for doc, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            if doc is not None:
                key = data[p : p + length]
                first[key] = min(doc, first.get(key, doc))
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if doc is not None and first[data[p : p + length]] < doc:
                gone[p : p + length] = b"\x01" * length
        spans = [k for k in range(len(data) + 1) if (k < len(data) and gone[k]) != (k > 0 and gone[k - 1])]
        kept = bytes(b for b, x in zip(data, gone, strict=True) if not x)
        out.append((doc, len(data), list(zip(spans[::2], spans[1::2], strict=True)), kept))
    return sorted(out, key=str)


def found(docs, **more):
    rows = cut_repeats(docs, **more).collect()
    return sorted(((x[0], x[1], [tuple(y) for y in x[2]], bytes(x[3])) for x in rows), key=str)


def test_cases(spark, monkeypatch):
    chance = random.Random(5)
    pool = ["".join(chance.choices("abcdé ", k=chance.choice([20, 49, 50, 51, 70, 120]))) for _ in range(25)]
    rows = [(k, "".join(chance.choices(pool, k=chance.randint(0, 4)))) for k in range(60)]
    rows += [(70, None), (71, ""), (72, "x" * 49), (73, "x" * 400), (74, "y" + "x" * 300), (75, "ab" * 100), (76, "ab" * 40)]
    rows += [(None, pool[0] * 2), (80, pool[1] * 2), (80, pool[1] * 2), (80, pool[1] + pool[2]), (5, pool[3] * 2)]
    chance.shuffle(rows)
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, batch int, spans string")
    assert found(docs.repartition(3)) == brute(rows, 50)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 1 << 30)
    assert found(docs, length=30, gram=12) == brute(rows, 30)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert cut_repeats(docs).count() == 0
