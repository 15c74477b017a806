import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, queries

PATH = queries.BYTE_BPE


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_match_the_library(encoder, library):
    r = random.Random(6)
    for k in range(3000):
        s = "".join(r.choice("ab tT'sredé\n\t\x1c\x85　 0123ñß###&&&漢😀́٣—\x00") for _ in range(r.randrange(40)))
        s = s + "<|endoftext|>" + s[:5] + "<|endo" if k % 7 == 0 else s * 20 if k % 11 == 0 else s
        ids = library.encode(s, add_special_tokens=False).ids
        assert encoder.encode(s) == ids
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert encoder.decode_joined(encoder.joined(s)).decode() == encoder.decode(ids)


def test_every_token_and_long_pieces(encoder, library):
    for raw in encoder.number:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids
    long = "x" * 20000 + "ab" * 3000 + "=" * 5000
    assert encoder.encode(long) == library.encode(long, add_special_tokens=False).ids


def test_rows(spark, library):
    rows = [(1, "Hello  world <|endoftext|>", 5), (2, None, 5), (3, "", 5), (4, "ß" * 3000, 5), (1, "Hello  world <|endoftext|>", 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    encoded = bpe.encode_documents(df, PATH)
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=str) == want
    assert sorted(((r["doc_id"], r["text"]) for r in bpe.decode_documents(encoded, PATH).collect()), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encoding_digests(df, PATH).collect()}
    assert digests == {(i, len(ids), sha(",".join(map(str, ids))), sha(t or "")) for (i, t, _), ids in zip(rows, [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows])}
    assert bpe.encoding_digests(df.limit(0), PATH).collect() == []


def test_query_equals_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op4_encode_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
