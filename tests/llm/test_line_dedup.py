"""Line dedup against a brute-force version, by batches and through compaction."""

import hashlib
import random

from tidemark.llm.line_dedup import LineRuns, dedup_lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars=10):
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                first[key(line)] = min(doc, first.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < min_chars or first[key(x)] == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


def test_cases(spark):
    rows = [
        (3, "A shared line here\nunique line three\n\nshort"),
        (1, "  a SHARED line HERE\t\nshort"),
        (2, "a shared line here\na shared line here\nshort"),
        (2, "another text of two\na shared line here"),
        (2, "another text of two\na shared line here"),
        (None, "a shared line here"),
        (5, None),
        (6, ""),
        (7, "\n\n"),
        (8, "ÄÖÜ non ascii line\näöü non ascii line"),
        (9, "ÄÖÜ non ascii line"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(dedup_lines(docs)) == brute(rows)


def test_random_texts_in_batches(spark):
    chance = random.Random(3)
    lines = [f"line number {k} of a pool" for k in range(30)] + ["x", "", "short one"]
    rows = [(k, "\n".join(chance.choices(lines, k=chance.randint(0, 9)))) for k in chance.sample(range(99), 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for batches, fanout in ((1, 2), (5, 2)):
        assert rows_of(dedup_lines(docs, batches, fanout)) == brute(rows)


def test_runs_are_levelled_and_first_batch_wins(spark):
    runs = LineRuns(spark, fanout=2)
    frames = []
    for k in range(5):
        batch = spark.createDataFrame([(9 - k, f"the common line\nline of batch {k} alone")], "doc_id long, text string")
        frames.append(runs.add(batch))
    assert [x[0] for x in frames[0].select("n_dropped").collect()] == [0]
    assert all(x.select("n_dropped").first()[0] == 1 for x in frames[1:])
    assert sorted(level for level, _ in runs.runs) == [0, 2]
    hashes = [tuple(x) for _, run in runs.runs for x in run.select("h1", "h2").collect()]
    assert len(hashes) == len(set(hashes)) == 6


def test_empty_table_clashing_columns_and_long_text(spark):
    schema = "doc_id long, text string, n_lines string, h1 int, `key` int, place int"
    assert dedup_lines(spark.createDataFrame([], schema)).count() == 0
    long = "\n".join(f"line {k % 7000} of a long text" for k in range(20_000))
    rows = [(1, long, "a", 1, 2, 3), (2, long, "b", 4, 5, 6)]
    got = {x.doc_id: x for x in dedup_lines(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].n_lines, got[1].n_dropped, got[2].n_dropped, got[2].text) == (20_000, 0, 20_000, "")
    assert hashlib.sha256(got[1].text.encode()).digest() == hashlib.sha256(long.encode()).digest()
    assert (got[2].h1, got[2]["key"], got[2].place) == (4, 5, 6)
