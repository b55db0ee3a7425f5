"""Language ID: exact code lengths against a direct version, and the cases of a table."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import language

TEXTS = {
    "en": [b"the house and the garden", b"with the other thing and this", b"they are the ones"],
    "de": [b"das haus und der garten", b"mit der anderen sache und diese", b"sie sind die einen"],
    "fr": [b"la maison et le jardin", b"avec les autres choses et cela", "ils étaient là".encode()],
}


def direct(samples, text, order):
    """Code lengths by counting contexts in a dictionary, one byte after the other."""
    out = {}
    for name, own in samples.items():
        pad = b"\n" * order
        run = (pad + pad.join(own) + pad).lower()
        counts = defaultdict(Counter)
        for n in range(order + 1):
            for k in range(n, len(run)):
                counts[run[k - n : k]][run[k]] += 1
        bits, full = 0.0, pad + text.lower()
        for k in range(order, len(full)):
            for n in range(order, -1, -1):
                found = counts.get(full[k - n : k])
                if not found:
                    continue
                total, kinds = sum(found.values()), len(found)
                if full[k] in found:
                    bits -= math.log2(found[full[k]] / (total + kinds))
                    break
                bits -= math.log2(kinds / (total + kinds))
            else:
                bits += 8
        out[name] = bits
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths(order):
    trees = language.ContextTrees(TEXTS, order)
    texts = [b"The garden of the house", b"", b"q", b"zz~~\x01 qx", "été und the".encode(), b"a" * 300]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    got = trees.lengths(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for row, text in zip(got, texts, strict=True):
        want = direct(TEXTS, text, order)
        assert np.allclose(row, [want[x] for x in trees.languages], rtol=1e-5)


def test_table(spark):
    rows = [(k, x.decode(), name) for k, (name, x) in enumerate((n, x) for n, own in TEXTS.items() for x in own)]
    rows += [(20, None, "en"), (21, "", "de"), (22, "12 345 !?", None), (23, "日本語", None), (24, "the and the", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language.train(docs)
    assert trees.languages == ["de", "en", "fr"]
    clash = docs.selectExpr("doc_id", "text", "'x' AS score", "1 AS draw")
    got = {x.doc_id: x for x in language.identify(clash, trees).collect()}
    assert [got[k].lang_pred for k in range(9)] == [x[2] for x in rows[:9]]
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (20, 21, 22))
    assert got[23].lang_pred in trees.languages and got[24].lang_pred == "en" and got[24].draw == 1
    assert all(0 <= x.score <= 1 for x in got.values())
    long = spark.createDataFrame([(1, "the garden " * 300_000)], "doc_id long, text string")
    assert language.identify(long, trees).first().lang_pred == "en"


def test_sample_is_of_different_texts(spark, monkeypatch):
    """Copies of one text take one place, whatever its hash; long texts are cut where there are no others."""
    copied = [f"das haus und der garten nummer {k}" for k in range(2)]
    own = [f"sie sind die einen und anderen {k}" for k in range(60)]
    copies = spark.range(20_000).selectExpr("concat('das haus und der garten nummer ', id % 2) AS text", "'de' AS lang")
    others = [(x, "de") for x in own] + [("same words", "en")] * 900 + [("les choses " * 20, "fr"), ("la maison " * 20, "fr")]
    docs = copies.union(spark.createDataFrame(others, "text string, lang string"))
    samples = []
    plain = language.ContextTrees
    monkeypatch.setattr(language, "ContextTrees", lambda x, order: samples.append(x) or plain(x, order))
    language.train(docs, per_language=400, max_bytes=100)
    assert sorted(samples[0]["de"]) == sorted(x.encode() for x in copied + own) and samples[0]["en"] == [b"same words"]
    assert sorted(samples[0]["fr"]) == [(b"la maison " * 20)[:100], (b"les choses " * 20)[:100]]
    language.train(docs, per_language=30, max_bytes=100)
    assert len(set(samples[1]["de"])) == len(samples[1]["de"]) == 30


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    trees = language.train(docs)
    assert language.identify(docs, trees).first().lang_pred == "und"
    assert language.identify(docs.limit(0), trees).count() == 0


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import QUERIES

    path = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_id"](spark, path).join(spark.read.parquet(f"{path}/documents.parquet"), "doc_id")
    right = got.selectExpr("held_out", "CAST(lang_pred = lang AS INT) AS ok").groupBy("held_out").avg("ok").collect()
    assert len(right) == 2 and min(x[1] for x in right) > 0.98
