"""The pipeline's stages against brute force on a small fixture, and its registration."""

import base64
import inspect

import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from test_jaccard import brute as groups
from test_line_dedup import brute as lines


def fixture(spark, path):
    english = "the house and the garden with the other thing and this is what they are "
    rows = [
        (1, f"{english}\nfirst own line of the house\nshort", "en"),
        (2, f"{english}\nsecond own line and the garden", "en"),
        (3, "the thing is that this house with a garden and the other one are here for all of them", "en"),
        (4, "the thing is that this house with a garden and the other one are here for all of us", "en"),
        (5, "das haus und der garten mit der anderen sache sind hier", "de"),
        (6, "und hier alpha beta gamma delta epsilon zeta eta theta mit der sache", "de"),
        (7, None, "en"), (8, "", None), (9, "123 456 !!", "en"), (10, "ein", "de"), (None, "the other house and garden", "en"),
        (5, "das haus und der garten mit der anderen sache sind hier", "de"),
    ]
    docs = spark.createDataFrame(
        [(k, x, y, "s", len(x) if x else None) for k, x, y in rows],
        "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    items = [(1, "Alpha beta gamma delta epsilon zeta eta theta"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages(spark, path):
    fixture(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        before = [tuple(x) for x in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), stage(spark, docs, path).schema)
        frames.append((before, [tuple(x) for x in docs.collect()]))
    assert all(len(x[1][0]) == len(columns) for x in frames[:-1])
    before, after = frames[0]
    assert sorted(after, key=str) == sorted((x for x in before if x[0] not in (7, 8, 9)), key=str)
    before, after = frames[1]
    want = lines([x[:2] for x in before])
    assert sorted([x[:2] for x in after], key=str) == sorted([x[:2] for x in want], key=str)
    assert all(x[4] == len(x[1]) for x in after)
    before, after = frames[2]
    keep = {k for k, _, component in groups([x[:2] for x in before]) if k == component or k is None}
    # Document 5 is there twice.
    assert sorted(after, key=str) == sorted({x for x in before if x[0] in keep}, key=str)
    assert 4 not in keep and 3 in keep
    before, after = frames[3]
    assert sorted(after, key=str) == sorted((x for x in before if x[0] != 6), key=str)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert docs.columns == [*columns, "ids", "n_tokens"]
    for x in docs.collect():
        assert x.ids == library.encode_ordinary(x.text) and x.n_tokens == len(x.ids)


def test_repeated_ids_are_told_apart_by_their_texts(spark, path):
    same = "one two three four five six seven eight nine ten eleven twelve"
    other = "quite another text about the house and the garden over there"
    rows = [(3, same), (7, same), (7, other), (9, other + " x"), (9, other + " x"), (11, "alone in the world of words here"),
            (11, "alone in the world of words here"), (12, None), (12, None), (13, ""), (None, same), (None, same)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{path}/d")
    left = corpus_pipeline.one_of_each(spark, spark.read.parquet(f"{path}/d"), path)
    want = [(3, same), (7, other), (11, rows[5][1]), (12, None), (12, None), (13, ""), (None, same), (None, same)]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)


def test_documents_stay_if_no_language_is_known(spark, path):
    rows = [(1, "some text", None), (2, None, None), (3, "12 !", None), (4, "\n日本 1", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(tuple, corpus_pipeline.known_language(spark, docs, path).collect())) == [rows[0], rows[3]]


def test_run_and_empty_table(spark, path, tmp_path):
    fixture(spark, path)
    got = __spark_entry__.queries()["pipeline"](spark, path)
    assert {x.doc_id for x in got.collect()} == {None, 1, 2, 3, 5, 10}
    empty = str(tmp_path / "empty")
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_registered():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in queries) == 1
    assert set(sql) <= set(queries)
    assert "limit(" not in inspect.getsource(corpus_pipeline) and len(corpus_pipeline.STAGES) == 5
