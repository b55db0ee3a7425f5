"""Byte-level BPE against the reference library, round trips, appends and edits."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tidemark.llm import bpe
from tidemark.llm.frames import map_arrow

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

TEXTS = [
    "", " ", "  ", "   a", "a  b", "a   b \n c", "\n \n", "x\n", "tab\tand  two", "it's we'll THEY'RE 'S", "12345 67",
    "Größe, naïve café — déjà vu", "日本語のテキスト", "emoji 🙂🙃 end", "a b  c", "<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaa" * 40,
    "The quick brown fox.\nNext line  here\n\n\ttail ", " lead", "\r\n\r\nx", "mixed123abc!!!???", "\x00\x01 \x7f",
]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n):
    chance = random.Random(11)
    pool = ["the", "Tion", " ", "  ", "\n", "ing", "é", "ß", "1", "99", "'s", ",", "!!", "\t", "日", "lowei", "and"]
    return ["".join(chance.choices(pool, k=chance.randint(0, 60))) for _ in range(n)]


def test_same_ids_as_the_library(library):
    own = bpe.encoder(PATH, PATTERN)
    for text in TEXTS + random_texts(400):
        ids = np.frombuffer(own.encode(text), "<u4")
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    own = bpe.Encoder(bpe.encoder(PATH, PATTERN).vocabulary.ranks, PATTERN)
    for text in TEXTS + random_texts(20):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_appends_prefixes_and_edits(library):
    vocabulary = bpe.encoder(PATH, PATTERN).vocabulary
    chance = random.Random(2)

    def plain(text):
        return library._core_bpe.encode_single_piece(text)

    table = bpe.PrefixTable(vocabulary)
    for part in (b"internat", b"ionalis", b"ation", b" of the w", b"orld"):
        table.append(part)
        assert table.tokens() == plain(table.text)
    assert table.tokens(9) == plain(table.text[:9])
    text = b"".join(chance.choices([b"tion", b"er", b"an", b"\xc3\xa9", b" the"], k=400))
    for _ in range(25):
        table = bpe.PrefixTable(vocabulary, text)
        a = chance.randint(0, len(text))
        b = min(len(text), a + chance.randint(0, 9))
        new = b"".join(chance.choices([b"x", b"ing", b""], k=3))
        work = table.replace(a, b, new)
        assert table.text == text[:a] + new + text[b:] and table.tokens() == plain(table.text)
        assert work <= len(table.text) - a
    table = bpe.PrefixTable(vocabulary, text)
    assert table.replace(10, 12, b"zz") < 400


def test_tables(spark):
    rows = [(k, x, "ids?", 5) for k, x in enumerate([*TEXTS, None])] + [(0, "twice", "", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `key` int")
    ids = bpe.encode(docs, PATH, PATTERN)
    got = ids.collect()
    assert len(got) == len(rows) and all(x.n_tokens == len(x.ids) and x["key"] for x in got)
    for packed in (False, True):
        back = bpe.decode(bpe.encode(docs, PATH, PATTERN, packed=packed), PATH, PATTERN).collect()
        assert all(bytes(x.decoded) == (x.text or "").encode() for x in back)
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def test_words_together(monkeypatch):
    ranks = bpe.encoder(PATH, PATTERN).vocabulary.ranks
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(11)
    letters = "abcdeinorstu" * 3 + "áñß漢字🙂'.,\n"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(60)) for _ in range(20)]
    texts += ["", " ", "  two  spaces ", "a" * 3000, "Z" + "é" * 500, texts[0]]
    expected = [library.encode_ordinary(x) for x in texts]
    for bits in (2, 20):
        monkeypatch.setattr(bpe, "PAIR_BITS", bits)
        for block in (1, 1000, 1 << 21):
            monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
            own = bpe.Encoder(ranks, PATTERN)
            for _ in range(2):
                assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == expected


def test_caches_are_empty_after_a_partition_if_they_shall_not_last(spark):
    own_pattern = f"(?:){PATTERN}"  # an encoder that no other test has filled
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('some unseenwordsof', id, ' text') AS text").coalesce(1)
    kept = bpe.encode(docs, PATH, PATTERN).collect()
    assert sorted(bpe.encode(docs, PATH, own_pattern, lasting=False).collect()) == sorted(kept)

    def held(batches):
        own = bpe.encoder(PATH, own_pattern)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(own.words) + len(own.parts) + len(own.vocabulary.pairs)] * len(batch)})

    # Both steps in one worker after the other: the caches of its encoder hold nothing of the step before.
    assert map_arrow(spark.range(1).coalesce(1), held, "n long").distinct().collect()[0].n == 0

    own = bpe.encoder(PATH, PATTERN)
    before = own.encode("some unseenwordsof 7 text")
    assert own.words and own.parts
    own.forget()
    assert not own.words and not own.parts and own.encode("some unseenwordsof 7 text") == before
