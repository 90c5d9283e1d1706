"""Encoding against the libraries' own, and the round trip."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from statloom.llm import bpe as B
from statloom.llm import packing
from statloom.llm.queries import op3_byte_bpe, op9_packing

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MERGES = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["'s", "s", "re", "ll", "'ve", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "!", "-", "　", "中", "😀", "\r\n", "\x1c", "\x85", "’", "'d", "'LL"]
BITS += ["x" * 70, "​", "<|endoftext|>", "\0"]


@pytest.fixture(scope="module")
def ranks_reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def merges_reference():
    tokenizer = Tokenizer.from_file(MERGES)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def texts():
    draw = random.Random(7)
    made = ["".join(draw.choices(BITS, k=draw.randint(0, 14))) for _ in range(1500)]
    return [None, "", "a" * 3000, " " * 2000, "!" * 2000, "abcde " * 2000, "'" * 50, *made, *made[:20]]


def ids(row):
    return memoryview(bytes(row)).cast("I").tolist()


@pytest.mark.parametrize("kind", ["ranks", "merges"])
def test_ids_are_the_librarys_and_come_back(spark, kind, ranks_reference, merges_reference):
    codec, reference = (B.ByteBpe.from_ranks(RANKS), ranks_reference) if kind == "ranks" else (B.ByteBpe.from_merges(MERGES), merges_reference)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "k int, text string").withColumn("extra", F.lit(1)).repartition(3)
    out = {r["k"]: r for r in B.decode(B.encode(df, codec), codec).collect()}
    plain = {r["k"]: r["decoded"] for r in B.decode(B.encode(df, codec, offsets=None), codec, offsets=None).collect()}
    for k, text in rows:
        assert ids(out[k]["ids"]) == reference(text or ""), repr(text)
        assert bytes(out[k]["decoded"]).decode() == (text or "") == bytes(plain[k]).decode()
        assert out[k]["extra"] == 1


def test_offsets_are_where_tokens_begin(spark):
    codec = B.ByteBpe.from_ranks(RANKS)
    row = B.encode(spark.createDataFrame([("naïve words",)], "text string"), codec).collect()[0]
    tokens = codec.tokens()
    assert ids(row["offsets"]) == [sum(len(tokens[j]) for j in ids(row["ids"])[:i]) for i in range(len(ids(row["ids"])))]


def test_scan_of_any_length_is_the_fold_of_its_steps():
    scanner, draw = B.Scanner(), random.Random(3)
    text = "".join(draw.choices(["a", "'", "s", " ", "\n", "1", "!"], k=70_000))
    points = [ord(c) for c in text]
    found = set(scanner.pieces(B.np.array(points, "u4"), B.np.array([0])).tolist())
    import regex

    assert found == {m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)}


def test_taken_names_are_refused(spark):
    with pytest.raises(ValueError):
        B.encode(spark.createDataFrame([("a", 1)], "text string, IDS int"), B.ByteBpe.from_ranks(RANKS))


def test_query_op3(spark, ranks_reference):
    import hashlib
    import struct

    documents = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op3_byte_bpe(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        text = documents[r["doc_id"]]
        own = ranks_reference(text)
        assert r["n_tokens"] == len(own)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("tokens", [0, 1, 2, 7, 1023, 1024, 1025, 5000])
def test_piece_lengths(tokens):
    found = packing.piece_lengths(tokens, 1024)
    assert sum(found) == tokens and all(x & (x - 1) == 0 and x <= 1024 for x in found)
    assert found == sorted(found, reverse=True) and len([x for x in found if x < 1024]) == len({x for x in found if x < 1024})


def test_packing_of_odd_rows(spark, merges_reference):
    rows = [(None, None), (1, ""), (1, ""), (2, "word " * 3000), (3, "<|endoftext|>a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sequence", F.lit("x"))
    codec = B.ByteBpe.from_merges(MERGES)
    found = packing.pack(df, codec).collect()
    assert len({r["sequence_id"] for r in found}) == len(found) and all(r["offset"] == 0 for r in found)
    assert [(r["doc_id"], r["length"]) for r in found if r["doc_tokens"] == 1] == [(None, 1), (1, 1), (1, 1)]
    for doc, text in rows[3:]:
        own = sorted((r["start"], ids(r["ids"])) for r in found if r["doc_id"] == doc)
        assert [i for _, piece in own for i in piece] == [*merges_reference(text), 0]
    assert packing.pack(df.limit(0), codec).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df.withColumn("length", F.lit(1)), codec, keep=("doc_id", "length"))


def test_query_op9(spark, merges_reference):
    import struct
    import zlib

    documents = {r["doc_id"]: merges_reference(r["text"] or "") + [0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    seen = {k: 0 for k in documents}
    for r in op9_packing(spark, FOLDER).orderBy("doc_id", "start").collect():
        own = documents[r["doc_id"]]
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(own)
        piece = own[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
        seen[r["doc_id"]] += r["length"]
    assert seen == {k: len(v) for k, v in documents.items()}
