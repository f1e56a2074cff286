"""Byte-level BPE against the tiktoken library, and the exact way back."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from gramwise.llm import bytebpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "  \n two  blanks\n ", "Don't I'LL we've", "été Straße 日本語 🙂👍 ½", "x" * 50_000, "a\x1cb\x85c d", "<|endoftext|>", "y" * 300 + " " * 3000]


@pytest.fixture(scope="module")
def both():
    own = bytebpe.ByteBPE(PATH, PATTERN, most=500, most_pieces=300)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_perfect_hash_is_minimal(both):
    table = both[0].whole
    assert sorted(table.values) == list(range(len(both[0].tokens))) and len(table.keys) == len(both[0].tokens)
    assert all(table.get(key) == k for k, key in enumerate(both[0].tokens[:2000]))
    assert table.get(b"surely no token of this file") == -1
    assert bytebpe.PerfectHash([]).get(b"x") == -1


def test_ids_equal_the_library(both):
    own, library = both
    rng, letters = random.Random(5), " \n\t\r'abstAB1२½é  \x1c\x85日🙂.,!_-  "
    texts = [*TEXTS, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000))]
    for text in texts:
        ids = own.encode(text).tolist()
        assert ids == library.encode_ordinary(text or "")
        assert own.decode(ids) == (text or "").encode()


def test_operator_on_a_table(spark, both):
    docs = spark.createDataFrame([*[(k, t, 0) for k, t in enumerate(TEXTS)], (None, "no id", 0), (1, "an id again", 0)], "doc_id long, text string, ids int")
    want = []
    for r in docs.collect():
        ids = both[1].encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = bytebpe.encoding_digests(docs, PATH, PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    encoded = bytebpe.encode_documents(docs, PATH, PATTERN)
    back = bytebpe.decode_documents(encoded, PATH, PATTERN).collect()
    assert sorted((str(r["doc_id"]), bytes(r["data"]).decode()) for r in back) == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert bytebpe.encoding_digests(docs.limit(0), PATH, PATTERN).count() == 0
