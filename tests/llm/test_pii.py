"""Personal data: base spans against plain patterns, learning against a plain version, spellings by cases."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    number = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(number))]
        return 16 <= len(number) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
    return kind == "email" or 8 <= len(number) <= 15


def base_spans(text):
    return [
        (kind, m.start(), m.end()) for kind in pii.KINDS for m in re.finditer(BASE[kind], text or "") if passes(kind, m[0])
    ]


def found(spark, texts):
    frame = spark.createDataFrame([(i, x, "old", 1) for i, x in enumerate(texts)], "doc_id long, text string, spans string, base int")
    rows = pii.find_pii(frame.repartition(3)).orderBy("doc_id").collect()
    return [[(s.kind, s.begin, s.end, s.base) for s in r.spans] for r in rows]


def noise(chance):
    parts = [
        "a", "é", "x.y", "@", "@", ".", ".", " ", "-", "+", "+1", "(555)", "555-", "1234", "4", "12", "::", "ff:", "1.2", ".3",
        " at ", " dot ", "[at]", "(dot)", "com", "😀", "\n", "4111111111111111", "0" * 9, "255", "256", "_", ",", "00", "%",
    ]
    return "".join(chance.choices(parts, k=chance.randint(0, 30)))


def test_base_spans(spark):
    chance = random.Random(4)
    texts = [noise(chance) for _ in range(3000)] + [
        None, "", "a@b", "a@b.c", "a@b.c_d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "1.2.3.400.5.6.7", "0001.2.3.255", "1.2.3.99999999999",
        "4111 1111 1111 1111", "4111-1111-1111-1111 2", "75 4111111111111111", "+1 (555) 555-1234 4111111111111111", "+1234567",
        "+12 " + "(" * 50 + "3", "::ffff:12.3.4.5", "joe (at) mail.com@x.org", "a@b.c" * 40,
    ]
    got = found(spark, texts)
    assert [[s[:3] for s in x if s[3]] for x in got] == [base_spans(x) for x in texts]
    for spans, text in zip(got, texts, strict=True):
        order = [(pii.KINDS.index(k), b, e) for k, b, e, _ in spans]
        assert order == sorted(order)
        assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(order, order[1:], strict=False))
        assert all(0 <= b < e <= len(text) for _, b, e, _ in spans)


def test_long_texts(spark):
    """Plain patterns take the square of a run's length; the counts are known."""
    texts = {
        "x" * 300_000: 0, "1" * 300_000: 0, "1." * 100_000: 25_000, "a@" * 100_000: 0, "+1" + " (" * 100_000: 0,
        "a.b." * 80_000 + "@": 0, "+1 (212) 555-0199 " * 2000: 2000, "é a.b@c.de " * 3000: 3000, "1 " * 100_000: 0,
        "f:" * 100_000: 0,
    }
    got = found(spark, list(texts))
    assert [sum(s[3] for s in x) for x in got] == list(texts.values())
    assert [s[:3] for s in got[2]] == [("ip", 8 * i, 8 * i + 7) for i in range(25_000)]
    assert [s[:3] for s in got[7]] == [("email", 11 * i + 2, 11 * i + 10) for i in range(3000)]


def test_other_spellings(spark):
    plain = [f"mail ann.{i}@mail{i}.example.com or call +1 (212) 555-{1000 + i}, card 4111 1111 1111 1111, ip 88.7.6.{i}." for i in range(60)]
    other = {
        "write to joe.doe [at] mail (dot) example.com now": ("email", "joe.doe [at] mail (dot) example.com"),
        "email: joe at mail dot org.": ("email", "joe at mail dot org"),
        "phone: (212) 555-0187.": ("phone", "(212) 555-0187"),
        "call 0049 30 1234 5678 now": ("phone", "0049 30 1234 5678"),
        "host 2001:db8:0:1:2:3:4:5 is up": ("ip", "2001:db8:0:1:2:3:4:5"),
        "from 2001:db8::7 on.": ("ip", "2001:db8::7"),
        "No 74 4111111111111111 it is": ("card", "4111111111111111"),
        "call +1 (212) 555-0144 4111111111111111 ok": ("phone", "+1 (212) 555-0144"),
    }
    clean = ["version 999.1.2.3 of 2024", "look at the dot matrix", "std::vector a::b", "id 1234567890123 in a list", "",
             'token = "a41234567890123456789f"', "2024-12-24 10:11:12", "3 + 4 = 7, 1,000.00"]
    got = found(spark, plain + list(other) + clean)
    for text, spans, (kind, part) in zip(other, got[60:], other.values(), strict=False):
        assert (kind, text.index(part), text.index(part) + len(part), False) in spans, text
    assert dict(zip(clean, got[60 + len(other):], strict=True)) == dict.fromkeys(clean, [])


def plain_em(rows, rounds):
    """rows: votes, n. The same steps as loops."""
    m, w = len(pii.VOTERS), pii.PRIOR_WEIGHT
    real, yes, no = 0.5, [pii.PRIOR[0]] * m, [pii.PRIOR[1]] * m

    def chance(votes):
        a = real * math.prod(yes[j][v + 1] for j, v in enumerate(votes))
        b = (1 - real) * math.prod(no[j][v + 1] for j, v in enumerate(votes))
        return a / (a + b)

    for _ in range(rounds):
        soft = [(v, n, n * chance(v)) for v, n in rows]
        total, sure = sum(n for _, n, _ in soft), sum(r for *_, r in soft)

        def share(j, x, prior, weights, all_):
            return (sum(r for (v, *_), r in zip(soft, weights, strict=True) if v[j] == x) + prior[x + 1] * w) / (all_ + w)

        good, bad = [r for *_, r in soft], [n - r for _, n, r in soft]
        real = (sure + w / 2) / (total + w)
        yes = [[share(j, x, pii.PRIOR[0], good, sure) for x in (-1, 0, 1)] for j in range(m)]
        no = [[share(j, x, pii.PRIOR[1], bad, total - sure) for x in (-1, 0, 1)] for j in range(m)]
    return real, yes, no, chance


def test_learning_equals_plain_version(spark):
    chance = random.Random(8)
    rows = []
    for _ in range(40):
        good = chance.random() < 0.7
        votes = [chance.choice([1, 1, 1, 0, -1]) * (1 if good else -1) for _ in pii.VOTERS]
        rows.append((votes, [chance.randint(0, 1) for _ in range(pii.N_TRAITS)], float(chance.randint(1, 50))))
    frame = spark.createDataFrame([(rows,)], "rows array<struct<votes:array<int>,traits:array<int>,n:double>>")
    got = frame.select("rows", pii.reliabilities(F.col("rows"), 5).alias("s")).select(
        "s", pii.classifier(F.col("rows"), F.col("s"), 7).alias("w")
    ).first()
    real, yes, no, posterior = plain_em([(v, n) for v, _, n in rows], 5)
    assert got.s.real == pytest.approx(real) and real > 0.5
    assert got.s.yes == [pytest.approx(x) for x in yes] and got.s.no == [pytest.approx(x) for x in no]

    weights, total = [0.0] * (1 + len(pii.VOTERS) + pii.N_TRAITS), sum(n for *_, n in rows)
    for _ in range(7):
        error = [
            n * (posterior(v) - 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, [1, *v, *t], strict=True)))))
            for v, t, n in rows
        ]
        weights = [
            w + sum(e * [1, *v, *t][j] for e, (v, t, _) in zip(error, rows, strict=True)) / total - 1e-3 * w
            for j, w in enumerate(weights)
        ]
    assert got.w == pytest.approx(weights)


def test_empty_table_and_native_plan(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame([(1, "a@b.cd")] * 2, "doc_id long, text string")
    frame = pii.find_pii(docs, keep=["doc_id"])
    assert [len(r.spans) for r in frame.collect()] == [1, 1]
    candidates = docs.select(F.concat(*(pii.candidates(F.col("text"), k) for k in pii.KINDS)).alias("__found"))
    for df in (frame, candidates, pii.learn(candidates)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_query_digest(spark):
    spans = spark.createDataFrame([([("email", 0, 5), ("phone", 7, 20)],), ([],)], "s array<struct<kind:string,begin:bigint,end:bigint>>")
    texts = [r[0] for r in spans.select(pii.spans_text(F.col("s"))).collect()]
    assert sorted(texts) == ["", "email:0:5,phone:7:20"]
    assert hashlib.sha256(b"").hexdigest() == spans.where("size(s) = 0").select(F.sha2(pii.spans_text(F.col("s")), 256)).first()[0]
