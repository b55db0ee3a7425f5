"""Decontamination: tilings against a plain version, and the cases of a table."""

import random

from tidemark.llm.tiling import drop_leaks, find_leaks, tiles


def plain_tiles(pattern, text, least):
    """Greedy string tiling by comparing all places."""
    marked_p, marked_t, out = set(), set(), 0
    while True:
        best = []
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while (
                    p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n]
                    and p + n not in marked_p and t + n not in marked_t
                ):
                    n += 1
                if n >= least:
                    best.append((n, p, t))
        if not best:
            return out
        longest = max(x[0] for x in best)
        for n, p, t in sorted(x for x in best if x[0] == longest):
            if not marked_p & set(range(p, p + n)) and not marked_t & set(range(t, t + n)):
                marked_p |= set(range(p, p + n))
                marked_t |= set(range(t, t + n))
                out += n


def test_tiles():
    chance = random.Random(7)
    for _ in range(150):
        pattern = chance.choices(range(4), k=chance.randint(3, 14))
        text = chance.choices(range(4), k=chance.randint(0, 25))
        found = tiles(pattern, text, 3)
        for p, t, n in found:
            assert pattern[p : p + n] == text[t : t + n] and n >= 3
        for side in (0, 1):
            places = [k for x in found for k in range(x[side], x[side] + x[2])]
            assert len(places) == len(set(places))
        assert sum(x[2] for x in found) >= 0.8 * plain_tiles(pattern, text, 3)
    words = list(range(100, 160))
    assert tiles(words, [1, 2, *words, 3], 4) == [(0, 2, 60)]
    moved = words[40:] + [-1] + words[:25] + [-2] + words[25:40]
    assert sorted(x[2] for x in tiles(words, moved, 4)) == [15, 20, 25]


def test_rest_of_an_occluded_match_is_marked():
    item = list(range(16))
    text = [*item[4:11], 90, 91, *item[:6], 92]
    assert sorted(tiles(item, text, 4)) == [(0, 10 - 1, 4), (4, 0, 7)]
    chance = random.Random(8)
    for _ in range(300):
        pattern = chance.choices(range(5), k=chance.randint(3, 18))
        text = chance.choices(range(5), k=chance.randint(0, 30))
        assert sum(x[2] for x in tiles(pattern, text, 3)) == plain_tiles(pattern, text, 3)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def test_table(spark):
    w = ITEM.split()
    moved = " ".join(w[8:]) + " and then something else " + " ".join(w[:8])
    far = " filler words of a long text" * 30_000
    rows = [
        (1, "Before. " + ITEM.upper().replace(" ", ",  ") + " after"), (2, moved), (3, " ".join(w[:7])),
        (4, " ".join(w[:9])), (5, None), (6, ""), (7, far + " " + ITEM + far), (1, "clean words only here"),
        (None, ITEM), (8, " x ".join(w)), (9, ITEM + " " + ITEM),
    ]
    docs = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, coverage int, item_id string")
    items = [(10, ITEM), (11, ITEM), (12, None), (13, ""), (14, "too short"), (15, "unseen words in a question of seven")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(docs.drop("item_id"), bench)
    pairs = sorted({(x.doc_id or -1, x.item_id) for x in got.collect()})
    assert pairs == [(d, i) for d in (-1, 1, 2, 4, 7, 9) for i in (10, 11)]
    spans = {x.doc_id: x.spans for x in got.where("item_id = 10").collect()}
    text = dict((k, v) for k, v in rows[:7])
    assert text[7].encode()[spans[7][0].begin : spans[7][0].end].decode() == ITEM
    assert len(spans[2]) == 2 and got.where("doc_id = 2").first().coverage == 1.0
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id, x.text == "clean words only here") for x in kept.collect()) == [
        (1, True), (3, False), (5, False), (6, False), (8, False)]


def test_scripts_marks_and_short_items(spark):
    items = [(1, "机器学习模型的训练数据。"), (2, "การเรียนรู้ของเครื่อง"), (3, "the “quoted” words — are «here» now"),
             (4, "Zürich"), (5, "deux mots"), (6, "データ"), (7, "... !")]
    rows = [(1, "他们说机器学习模型的训练数据，很重要"), (2, "คือการเรียนรู้ของเครื่องมาก"), (3, 'The "quoted" words - are "here"\u00a0now'),
            (4, "in Zürich."), (5, "les deux\u00a0mots, ici"), (6, "このデータは"), (7, "Zürichs deux autres mots. ... !"), (8, "x" * 300 + "，"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(docs, bench).collect()
    assert sorted((x.doc_id, x.item_id, x.coverage) for x in got) == [(k, k, 1.0) for k in range(1, 7)]
    spans = {x.doc_id: x.spans for x in got}
    assert rows[0][1].encode()[spans[1][0].begin : spans[1][0].end].decode() == "机器学习模型的训练数据"
    assert sorted(x.doc_id for x in drop_leaks(docs, bench).collect()) == [7, 8, 9]


def test_empty_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEM), (2, "other words that are clean here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, none).count() == 0 and drop_leaks(docs, none).count() == 2
    many = spark.createDataFrame([(k, f"{ITEM} number{k}") for k in range(12)], "item_id long, text string")
    assert find_leaks(docs.limit(0), many).count() == 0
    monkeypatch.setattr("tidemark.llm.tiling.BLOCK_BYTES", 600)
    assert sorted(x.item_id for x in find_leaks(docs, many).collect()) == list(range(12))
    assert [x.doc_id for x in drop_leaks(docs, many).collect()] == [2]
