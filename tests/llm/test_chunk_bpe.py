import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from apexframe.llm import chunk_bpe as B

FILE = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def tokens():
    return B.codec(open(FILE, encoding="utf-8").read())


def expected(library, rows):
    out = []
    for row_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((row_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, B.digests(df).collect()), key=str)


PASSAGE = " ".join(f"shared{i} passage, it's number {i * i}!" for i in range(400))
EDGES = [
    (1, None), (2, ""), (3, " "), (4, "\n\n \t"), (5, PASSAGE), (6, "before " + PASSAGE + " after"), (7, PASSAGE + PASSAGE), (None, PASSAGE), (8, PASSAGE), (8, PASSAGE),
    (8, "other text of the same id"), (9, "a<|endoftext|>b<|endoftext|><|endoftext|> " + PASSAGE + "<|endoftext|>"), (10, "é" * 3000 + PASSAGE), (11, "漢字" * 2000), (12, "漢字" * 2000 + "x"),
    (13, "x" * 20_000), (14, "y" + "x" * 20_000), (15, "   " * 3000 + PASSAGE + "   " * 3000), (16, " 　 a b\r\n" * 500), (17, " 　 a b\r\n" * 501), (18, "<|endoftext|>"),
    (19, "a\x00b 🦆🦆" * 300), (20, "z a\x00b 🦆🦆" * 300),
]


def test_edge_rows(make, library):
    assert got(B.chunk_encoding(make(EDGES), FILE)) == expected(library, EDGES)


def test_empty_table(make):
    assert B.chunk_encoding(make([]), FILE).count() == 0


def test_whole_table(spark, library):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert got(B.chunk_encoding(documents, FILE)) == expected(library, [(r.doc_id, r.text) for r in documents.collect()])


def test_chunks_are_found_again(tokens):
    a, b = B._chunks(PASSAGE, tokens), B._chunks("something before: " + PASSAGE + " - and after", tokens)
    assert len(a) > 5 and len(set(a) & set(b)) >= len(a) - 2
    data = ("é漢🦆 " * 5000).encode()
    ends = [0, *B.cuts(data)]
    assert all(data[i:j].decode() for i, j in zip(ends, ends[1:])) and ends[-1] == len(data)


def test_joins_anywhere_are_repaired(library, tokens):
    rng = random.Random(1)
    alphabet = ["a", "the", " ", "  ", "\n", "'s", "'", "12", ".", "é", "漢", " ", "🦆", "ing", " I'll", "\t", "!!", "　", "B"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
        places = sorted({rng.randint(0, len(text)) for _ in range(rng.randint(0, 5))} | {0, len(text)})
        data, ends = text.encode(), [len(text[:p].encode()) for p in places]
        pieces = [(i, j, tokens.encode(data[i:j])) for i, j in zip(ends, ends[1:])]
        assert B.joined(data, pieces, tokens).tolist() == library.encode(text, add_special_tokens=False).ids, (text, places)


def test_wrong_pieces_widen_the_window(library, tokens):
    """Guards that do not come out as they were widen the window until they do."""
    text = "one two three four five six seven eight nine ten"
    data, bad = text.encode(), np.array([tokens.encode(c.encode())[0] for c in text[:24]], dtype=tokens.kind)
    pieces = [(0, 24, bad), (24, len(data), tokens.encode(data[24:]))]
    assert B.joined(data, pieces, tokens).tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_refused(make):
    with pytest.raises(ValueError):
        B.chunk_encoding(make([(1, "a")]), public_tokenizers.path("word_bpe_49k.json"))


def test_equal_hashes_of_different_chunks_do_no_harm(library, tokens):
    wrong = {h: tokens.encode(b"something else") for h in B._chunks(PASSAGE, tokens)}
    assert B.encode(PASSAGE, tokens, wrong).tolist() == library.encode(PASSAGE, add_special_tokens=False).ids


def test_texts_are_shuffled_once(spark, make):
    docs, name = make([(i, f"{i} " + PASSAGE) for i in range(20)]), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as with tables that are too large to be sent around
    try:
        encoded = B.chunk_encoding(docs, FILE)
        assert len(encoded.collect()) == 20
        assert "ReusedExchange" in encoded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
