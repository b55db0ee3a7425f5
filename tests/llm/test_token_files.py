"""Token files: same ids as the library, order, offsets, encodings and page indexes."""

import glob
import struct
import zlib

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from tidemark.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    "Plain words, with marks!", "", None, " lead\tand\ntail ", "Größe É é É x y ́z", "日本語 text", "don't we'll 12 3.4",
    "<|endoftext|> in text", "a" * 500, "ΟΔΟΣ Σ ς", "many words here " * 50, "\x1c\x1d sep \x85 next",
]


def test_round_trip(spark, path):
    ids = [5, 3, 99, None, 1, 8, 2, 7, 6, 4, 10, 11]
    rows = list(zip(ids, TEXTS, strict=True)) + [(3, "same id, other text"), (5, TEXTS[0])]
    docs = spark.createDataFrame([(*x, "t", 1) for x in rows], "doc_id long, text string, tokens string, part int")
    token_files.write_tokens(docs.repartition(3), path, PATH, end_id=1)
    got = token_files.with_crc32(token_files.read_tokens(spark, path)).collect()
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = sorted((x or -1, tokenizer.encode(y or "", add_special_tokens=False).ids + [1]) for x, y in rows)
    assert sorted((x.doc_id or -1, list(x.tokens)) for x in got) == want
    end = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == end and x.n_tokens == len(x.tokens)
        assert x.ids_crc32 == zlib.crc32(struct.pack(f"<{len(x.tokens)}i", *x.tokens))
        end += x.n_tokens
    order = [x.doc_id or -1 for x in sorted(got, key=lambda x: x.start)]
    assert order == sorted(order)


def test_query_gives_the_library_default(spark, path):
    from tidemark.llm.queries import QUERIES

    texts = [*TEXTS, "a <|endoftext|> b", "x<|startoftext|>y<|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "é<|endoftext|>日本"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    want, start = [], 0
    for k, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((k, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}i", *ids))))
        start += len(ids)
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    got = QUERIES["op9_token_files"](spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_format(spark, path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('some words of text ', 40) AS text")
    token_files.write_tokens(docs, path, PATH, row_group_bytes=1 << 16, page_bytes=1 << 12)
    files = [pq.ParquetFile(x) for x in glob.glob(f"{path}/tokens/*.parquet")]
    assert sum(x.metadata.num_rows for x in files) == 3000
    group = files[0].metadata.row_group(0)
    columns = {group.column(k).path_in_schema.split(".")[0]: group.column(k) for k in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["tokens"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_column_index
    some = token_files.read_tokens(spark, path).where("doc_id BETWEEN 100 AND 109").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 10 and "tokens:array" not in plan and "GreaterThanOrEqual(doc_id,100)" in plan


def test_empty_table(spark, path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert token_files.with_crc32(token_files.read_tokens(spark, path)).count() == 0


def test_full_cache_changes_nothing(monkeypatch):
    texts = [(x or "").encode() for x in TEXTS]
    want = list(map(token_files.WordEncoder(PATH).encode, texts))
    assert token_files.WordEncoder(PATH).encode_all(texts * 2) == want * 2
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 2)
    monkeypatch.setattr(token_files, "_STEP", 3)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 40)
    own = token_files.WordEncoder(PATH)
    assert own.plain and [own.encode(x) for x in texts * 2] == want * 2
    assert own.encode_all(texts * 2, b"tail") == [x + b"tail" for x in want * 2]


def test_each_word_of_a_text_as_the_library():
    words = [f"{a}{b}{c}" for a in ("don't", "</w>", "É!x", "''s", "<|", "ß", "Ÿ", "9w", "\x7f") for b in ("", "'re", "</w>", "œ")
             for c in ("", "W", "--", "日", "|>", "\xad", "ŉ")]
    for special in (False, True):
        own = token_files.WordEncoder(PATH, special)
        some = [*words, "<|endoftext|>", "a<|startoftext|>b"]
        want = [own.tokenizer.encode(x, add_special_tokens=False).ids for x in (" ".join(some), *some)]
        got = own.encode_all([x.encode() for x in (" ".join(some), *some)])
        assert [list(struct.unpack(f"<{len(x) // 4}i", x)) for x in got] == want


def test_each_plain_character_as_the_library():
    own = token_files.WordEncoder(PATH)
    for code in range(0x21, 0x260):
        for text in (chr(code), f"aB{chr(code)}{chr(code)}9x'S"):
            want = own.tokenizer.encode(text, add_special_tokens=False).ids
            assert list(struct.unpack(f"<{len(want)}i", own.encode(text.encode()))) == want, hex(code)


def test_a_word_is_learnt_once_in_any_case_and_before_any_mark():
    own = token_files.WordEncoder(PATH, True)
    own.encode_all([b"Some words, some WORDS. (words) some", "Größe; größe!".encode()])
    assert own.words.keys() == {b"some", b"words", "größe".encode(), b",", b".", b"(words", b")", b";", b"!"}


def test_marks_behind_letters_as_the_library():
    ends = ["a", "Z", "7", "é", "É", "×", "÷", "ÿ", "Ā", "ȿ", "«", "ª", "²", "\xa0", "\x85", "\xad", "'", "'S", "İ", "ſ", "ɐ", "日", "h\u0331", "H\u0331", "Σ", ""]
    marks = [",", ".'s", "''", "'S.", "_-_", "<|", "<|endoftext|>", "<|ENDOFTEXT|>x", "<|\u017ftartoftext|>.", "!É", "=\u0338", "\x00.", "\n,"]
    texts = [f"{mark}{b}{end}{mark}{end}{b}" for end in ends for mark in marks for b in ("", " ", "Q")]
    for special in (False, True):
        own = token_files.WordEncoder(PATH, special)
        want = [own.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        for got in (own.encode_all([x.encode() for x in texts]), [y for x in texts for y in own.encode_all([x.encode()])]):
            assert [list(struct.unpack(f"<{len(x) // 4}i", x)) for x in got] == want


def test_texts_without_new_words():
    own = token_files.WordEncoder(PATH)
    assert own.encode_all([b"word"]) == own.encode_all([b"word"])
    assert own.encode_all([]) == [] and own.encode_all([b"", b""], b"tail") == [b"tail"] * 2
